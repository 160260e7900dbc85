"""Fingerprints: equality, the located edit, and the next document of every document."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lapforge.llm import merkle
from helpers import frame, odd_texts


def prints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("fingerprint", F.lit("old"))
    return [r["fingerprint"] for r in merkle.fingerprints(df).orderBy("i").collect()]


def test_equal_texts_and_only_they_have_equal_prints(spark):
    texts = [t for _, t, _ in odd_texts()] + ["a.b", "a.\nb", "a\n.b", "ab.", "\n", "\n\n", "a. b", "a . b"]
    got = prints(spark, texts)
    for a, x in zip(texts, got):
        for b, y in zip(texts, got):
            assert ((a or "") == (b or "")) == (x == y)


def test_a_changed_paragraph_is_located(spark):
    lines = [f"line {k}, with two phrases." for k in range(40)]
    other = lines[:17] + ["something else, here."] + lines[18:]
    a, b = prints(spark, ["\n".join(lines), "\n".join(other)])
    assert a.split(":")[0] != b.split(":")[0]
    pa, pb = (x.split(":")[1].replace("=", ";").split(";") for x in (a, b))
    pa, pb = ([p for s in x[1::2] for p in s.split(",")] for x in (pa, pb))
    assert [k for k, (x, y) in enumerate(zip(pa, pb)) if x != y] == [17] and len(pa) == len(pb) == 40
    sa, sb = (x.split(":")[1].split(";") for x in (a, b))
    assert len(set(sa) - set(sb)) <= 2 and len(sa) > 3


def plain_places(x, y):
    """What text x has and y lacks, over sets of whole lines and of their phrases."""
    mine, theirs = x.split("\n"), y.split("\n")
    phrases = lambda line: re.findall(merkle.PHRASE, line)
    known = {p for line in theirs if line not in mine for p in phrases(line)}
    return [(k, [i for i, p in enumerate(phrases(line)) if p not in known]) for k, line in enumerate(mine) if line not in theirs]


LINES = [f"line {k}, with two phrases." for k in range(60)]
EDITS = {
    "change": LINES[:17] + ["line 17, with other phrases."] + LINES[18:],
    "insert": LINES[:30] + ["one more line, here.", "and another."] + LINES[30:],
    "delete": LINES[:8] + LINES[11:],
    "far apart": ["first, new."] + LINES[1:59] + ["last, new."],
    "none": LINES,
    "all": ["nothing of it."],
    "empty": [""],
}


@pytest.mark.parametrize("name", list(EDITS))
def test_an_edit_is_located(spark, name):
    old, new = "\n".join(LINES), "\n".join(EDITS[name])
    a, b = prints(spark, [old, new])
    df = spark.createDataFrame([(a, b, "x")], "a string, b string, removed string")
    row = merkle.locate(df, "a", "b").first()
    for got, x, y in ((row["removed"], old, new), (row["added"], new, old)):
        assert [(p["paragraph"], p["phrases"]) for p in got] == plain_places(x, y)
        sections = [p["section"] for p in got]
        assert sections == sorted(sections)


def test_locate_of_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, "x:y=z")], "a string, b string")
    assert merkle.locate(df, "a", "b").first()["removed"] is None
    assert merkle.locate(df.limit(0), "a", "b").count() == 0


def test_texts_without_punctuation_share_leaves_after_an_edit(spark):
    words = [hashlib.md5(str(k).encode()).hexdigest()[:3 + k % 6] for k in range(3000)]
    texts = [" ".join(words), "".join(words), "、".join(words), "字" * 10 + "".join(chr(0x4E00 + 7 * k % 20000) for k in range(4000))]
    moved = [" ".join(["new"] + words), "x"]
    for text in texts:
        df = spark.createDataFrame([(text, "other text " * 3000)], "t string, f string")
        leaves = [merkle.leaf_set(merkle.tree(c)) for c in (F.col("t"), merkle.edited(F.col("t"), F.col("f")))]
        assert df.select(merkle.likeness(*leaves)).first()[0] > 0.5
    df = spark.createDataFrame([(texts[0], moved[0])], "t string, f string")
    assert df.select(merkle.likeness(*(merkle.leaf_set(merkle.tree(F.col(c))) for c in "tf"))).first()[0] > 0.95


@pytest.mark.parametrize("rows_per_chunk", [1, 4, 1000])
def test_next_document(spark, rows_per_chunk):
    rows = [(i, t or "", s) for i, t, s in odd_texts()]
    got = merkle.with_next(frame(spark, rows), "doc_id", "text", "next_text", rows_per_chunk).collect()
    by = sorted(rows, reverse=True)
    after = {x[0]: by[(k + 1) % len(by)][1] for k, x in enumerate(by)}
    assert len(got) == len(rows) and all(r["next_text"] == after[r["doc_id"]] for r in got)


def test_next_of_nulls_repeats_one_row_and_none(spark):
    rows = [(5, "a", "s"), (5, "a", "s"), (None, "b", "s"), (3, "c", "s")]
    got = merkle.with_next(frame(spark, rows), "doc_id", "text", "next_text", 2).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["next_text"]) for r in got) == [(0, "b", "a"), (3, "c", "b"), (5, "a", "a"), (5, "a", "c")]
    assert [r["next_text"] for r in merkle.with_next(frame(spark, rows[:1]), "doc_id", "text", "next_text").collect()] == ["a"]
    assert merkle.with_next(frame(spark, rows[:1]).limit(0), "doc_id", "text", "next_text").count() == 0


def test_edited_text_and_likeness(spark):
    df = spark.createDataFrame([("abcdé", "xyz"), ("abcdef", "x"), ("", "x"), ("a", "x")], "t string, f string")
    got = [r[0] for r in df.select(merkle.edited(F.col("t"), F.col("f"))).collect()]
    assert got == ["abcxy", "abcx", "", "a"]
    sets = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in sets.select(merkle.likeness(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0]
    assert hashlib.sha256("abcxy".encode()).hexdigest() == df.select(F.sha2(merkle.edited(F.col("t"), F.col("f")).cast("binary"), 256)).first()[0]
