"""Document fingerprints: a Merkle tree over sections, paragraphs and their phrases. Native expressions only.

Phrases are the leaves. A phrase ends with the first ASCII punctuation mark among its first REACH code
points; without one, with the first word end that BORDER names, and without that after REACH code points. So an edit moves
the borders of at most a few phrases, and no leaf of a text without punctuation grows. A paragraph is a line; a section is
a run of paragraphs that ends after one whose hash starts with 0 .. 3, so that a section's borders depend on its content
and an edit does not move the borders behind it. Each node's hash is that of its children's hashes in order; the root of
equal texts is equal, and `locate` goes down from a differing root to sections, paragraphs and phrases.

A fingerprint is `root:section;section;...`, a section `hash=paragraph,paragraph,...`, a paragraph its phrases' hashes,
LEAF hexadecimal digits each, one after the other.
"""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapforge.llm.common import free_name
from lapforge.session import lookup

MARKS = ".,;:!?"
REACH, SHORTEST = 48, 12
BORDER = "[dgkmpy][ \t]"  # a word end after one of these letters, at SHORTEST code points or later
PHRASE = f"[^{MARKS}]{{0,{REACH - 1}}}+[{MARKS}]|[^{MARKS}]{{{SHORTEST},{REACH - 2}}}?{BORDER}|[^{MARKS}]{{1,{REACH}}}"
LEAF, SECTION = 8, 16
ROWS_PER_CHUNK = 4000


def tree(text: Column) -> Column:
    """Paragraphs of a text: array of (hash, leaves), leaves being its phrases' short hashes. Null text: that of empty text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    hashed = F.transform(lines, lambda line: F.transform(F.regexp_extract_all(line, F.lit(PHRASE), F.lit(0)), lambda p: F.md5(p)))
    return F.transform(hashed, lambda leaves: F.struct(
        F.md5(F.array_join(leaves, ",")).alias("hash"),
        F.transform(leaves, lambda x: F.substring(x, 1, LEAF)).alias("leaves")))


def sections(paragraphs: Column) -> Column:
    """Runs of paragraphs, each ending after one with a border hash: array of arrays."""
    n = F.size(paragraphs)
    numbers = F.sequence(F.lit(1), n)
    borders = F.filter(numbers, lambda i: (F.substring(F.element_at(paragraphs, i)["hash"], 1, 1) < "4") | (i == n))
    return F.transform(borders, lambda border, k: F.slice(
        paragraphs, F.when(k == 0, 1).otherwise(F.get(borders, k - 1) + 1), border - F.when(k == 0, 0).otherwise(F.get(borders, k - 1))))


def fingerprint(paragraphs: Column) -> Column:
    """The fingerprint as one string, from tree()."""
    nodes = F.transform(sections(paragraphs), lambda run: F.struct(
        F.md5(F.array_join(F.transform(run, lambda p: p["hash"]), ",")).alias("hash"),
        F.array_join(F.transform(run, lambda p: F.array_join(p["leaves"], "")), ",").alias("below")))
    root = F.md5(F.array_join(F.transform(nodes, lambda s: s["hash"]), ","))
    return F.concat(root, F.lit(":"), F.array_join(F.transform(nodes, lambda s: F.concat(
        F.substring(s["hash"], 1, SECTION), F.lit("="), s["below"])), ";"))


def leaf_set(paragraphs: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: p["leaves"])))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once, also where body reads it inside of lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _paragraphs(section_list: Column, missing: Column) -> Column:
    """All paragraphs of a fingerprint's sections in order: section, whether the section is among `missing`, joined leaves."""
    return F.flatten(F.transform(section_list, lambda s, i: _let(
        F.array_contains(missing, s), lambda differs: F.transform(F.split(F.substring_index(s, "=", -1), ","), lambda p: F.struct(
            i.alias("section"), differs.alias("differs"), p.alias("leaves"))))))


def _leaves(joined: Column) -> Column:
    return F.regexp_extract_all(joined, F.lit(f".{{{LEAF}}}"), F.lit(0))


def _of_differing(paragraphs: Column) -> Column:
    return F.transform(F.filter(paragraphs, lambda p: p["differs"]), lambda p: p["leaves"])


def branches(a: Column, b: Column) -> Column:
    """Where fingerprint a has what b lacks: array of (section, paragraph, phrases), numbered from 0 in a's text.

    Equal roots end the search. Otherwise only sections that b lacks are opened, in them only paragraphs that b's own
    differing sections lack, and in those the phrases that b's differing paragraphs lack. `phrases` is empty where a
    paragraph has b's phrases in another order or number. A node counts once however often it is repeated, and its place
    does not count: sections that only moved, or repeats that went, show at the root alone. A null fingerprint gives null.
    """
    def go(x):
        sa, sb = x["a"], x["b"]
        return _let(F.struct(_paragraphs(sa, F.array_except(sa, sb)).alias("a"), _paragraphs(sb, F.array_except(sb, sa)).alias("b")), paragraphs)

    def paragraphs(x):
        return _let(F.struct(F.array_except(_of_differing(x["a"]), _of_differing(x["b"])).alias("a"),
                             F.array_except(_of_differing(x["b"]), _of_differing(x["a"])).alias("b")), lambda only: phrases(x["a"], only))

    def phrases(all_of_a, only):
        gone = F.array_except(F.flatten(F.transform(only["a"], _leaves)), F.flatten(F.transform(only["b"], _leaves)))
        numbered = F.transform(all_of_a, lambda p, k: F.struct(p["section"], k.alias("paragraph"), p["differs"], p["leaves"]))
        return _let(gone, lambda lost: F.transform(
            F.filter(numbered, lambda p: p["differs"] & F.array_contains(only["a"], p["leaves"])),
            lambda p: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph"), _positions(_leaves(p["leaves"]), lost).alias("phrases"))))

    parts = F.struct(*(F.split(F.substring_index(c, ":", -1), ";").alias(n) for c, n in ((a, "a"), (b, "b"))))
    none = F.from_json(F.lit("[]"), "array<struct<section:int,paragraph:int,phrases:array<int>>>")
    return F.when(a.isNull() | b.isNull(), None).when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), none).otherwise(_let(parts, go))


def _positions(leaves: Column, wanted: Column) -> Column:
    hits = F.transform(leaves, lambda x, i: F.when(F.array_contains(wanted, x), i))
    return F.filter(hits, lambda i: i.isNotNull())


def locate(df: DataFrame, before: str, after: str) -> DataFrame:
    """df with the places of an edit between two fingerprints: `removed` (places in the text before) and `added` (after).

    Equal fingerprints give two empty lists, a null one nulls. Columns of these names that df already has are replaced.
    """
    a, b = F.col(before), F.col(after)
    return df.withColumns({"removed": branches(a, b), "added": branches(b, a)})


def likeness(a: Column, b: Column) -> Column:
    """Shared leaves of two leaf sets, twice, over the leaves of both: 1 if equal (also if both are empty), 0 if disjoint.
    A phrase counts once however often a text repeats it."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def edited(text: Column, following: Column) -> Column:
    """text with its last half (rounded down, in code points) replaced by as much of the start of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def with_next(df: DataFrame, key: str, text: str, out: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """df with `out`: the text of the row with the next smaller key; after the last, that of the first.

    Rows are dealt by key into chunks of about rows_per_chunk. A chunk's window also holds a copy of the first row of
    the next chunk that has any, so whole rows are shuffled once. Rows with a null key come last; rows that repeat a
    key go by a hash of their text. A table of one row is its own next.
    """
    chunk, extra, tie, head, of, before, nth = (free_name(df, c) for c in ("chunk", "extra", "tie", "head", "of", "before", "nth"))
    k = F.col(key)
    span = df.agg(F.min(k).alias("lo"), F.max(k).alias("hi"), F.count("*").alias("n")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    chunks = max(1, math.ceil(span["n"] / rows_per_chunk))
    width = max(1, math.ceil((hi - lo + 1) / chunks))
    dealt = df.withColumn(chunk, F.coalesce(F.floor((F.lit(hi) - k) / F.lit(width)), F.lit(chunks + 1)).cast("long"))
    dealt = dealt.withColumn(tie, F.xxhash64(text))
    # keys only: the first key of each chunk, and the chunk before it (before the first one: the last)
    heads = dealt.groupBy(chunk).agg(F.max(k).alias(head))
    everyone = W.orderBy(chunk).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.withColumn(before, F.coalesce(F.lag(chunk).over(W.orderBy(chunk)), F.last(chunk).over(everyone)))
    heads = lookup(heads.select(F.col(head), F.col(before), F.col(chunk).alias(of)))
    first = dealt.join(heads, k.eqNullSafe(F.col(head)) & (F.col(chunk) == F.col(of)))
    ahead = W.partitionBy(before).orderBy(tie)
    first = first.withColumn(nth, F.row_number().over(ahead)).where(F.col(nth) == 1).withColumn(chunk, F.col(before))
    first = first.select(*dealt.columns).withColumn(extra, F.lit(1))
    rows = dealt.withColumn(extra, F.lit(0)).unionByName(first)
    order = W.partitionBy(chunk).orderBy(extra, k.desc_nulls_last(), tie)
    return rows.withColumn(out, F.lead(text).over(order)).where(F.col(extra) == 0).drop(chunk, extra, tie)


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with `out`, one row per row of df. Null text counts as empty text, repeated rows get equal prints, and a column
    named `out` is replaced."""
    return df.withColumn(out, fingerprint(tree(F.col(text_col))))
