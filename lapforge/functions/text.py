"""Text normalisation, similarity and URL helpers."""

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from lapforge.functions.memory import give_back


def _ascii(value: str) -> str:
    return unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode("ascii")


# White space that str.strip takes off, as far as it is ASCII.
BLANKS = " \t\n\v\f\r\x1c\x1d\x1e\x1f"


@F.pandas_udf(T.StringType())
def fold_marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Spark has no compatibility decomposition. Workers live on from task to task, so memory goes back with each one's end."""
    try:
        for s in batches:
            yield s.map(lambda v: None if v is None else _ascii(v.strip().lower()))
    finally:
        give_back()


def fold_ascii(c: Column) -> Column:
    """Lower case, accents dropped, non-ASCII dropped. Texts that are ASCII already stay out of the Python workers."""
    marked = c.rlike(r"[^\x00-\x7F]")
    return F.when(marked, fold_marked(F.when(marked, c))).otherwise(F.lower(F.btrim(c, F.lit(BLANKS))))


def norm_text(c: str | Column) -> Column:
    """Comparable form of a name: folded, punctuation to blanks, blanks squeezed; null gives ''."""
    folded = F.coalesce(fold_ascii(F.col(c) if isinstance(c, str) else c), F.lit(""))
    return F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " "))


def slug(c: str | Column, max_len: int = 40) -> Column:
    """File-system safe name: folded, words joined by '-', cut at max_len, 'unknown' when empty."""
    folded = F.coalesce(fold_ascii(F.col(c) if isinstance(c, str) else c), F.lit(""))
    joined = F.regexp_replace(F.regexp_replace(folded, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.substring(F.when(joined == "", F.lit("unknown")).otherwise(joined), 1, max_len)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of a to b (not symmetric); 0 when either is empty."""
    matcher = SequenceMatcher(None)
    current, out = None, []
    for x, y in zip(a, b):
        if not x or not y:
            out.append(0.0)
            continue
        if y != current:
            matcher.set_seq2(y)
            current = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def page_id(url: str | Column, marker: str = "/wiki/") -> Column:
    """Decoded part of the URL path after the marker; null when the URL has no such part.

    A '+' stays a '+', as in path decoding; form decoding would turn it into a blank.
    """
    path = F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("PATH"))
    page = F.regexp_extract(path, f"{re.escape(marker)}(.*)$", 1)
    found = F.when(F.instr(path, marker) > 0, F.regexp_replace(page, r"\+", "%2B"))
    return F.try_url_decode(found)


def joined_variants(c: str | Column) -> Column:
    """Aggregate: sorted distinct trimmed non-empty values joined by '|'."""
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.array_join(F.array_sort(F.collect_set(F.when(text != "", text))), "|")


def encoded_name(column: str) -> str:
    """Name of the target-encoded twin of a categorical column."""
    return column.replace("_key", "").replace("_number", "") + "_avg_laptime"
