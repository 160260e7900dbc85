"""Each stage on its own input against a plain re-computation, and the whole run."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lapforge.llm import toxicity
from lapforge.llm.common import table
from helpers import near_groups, odd_texts, prose, without_repeats

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_texts() + [(7, odd_texts()[6][1], "s0"), (None, prose(60, 50), "s1"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "chunk": F.lit("c"), "size": F.lit(1)})


def names():
    return dict(corpus_pipeline.STAGES)


def test_stages_on_odd_documents(spark, odd):
    s = names()
    columns = odd.columns
    kept = s["minhash near-dedup"](spark, odd, FOLDER)
    assert kept.columns == columns
    want = near_groups({r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"]})
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == sorted(set(want.values()))
    assert kept.where("doc_id IS NULL").count() == 2
    cut = s["suffix-array dedup"](spark, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), FOLDER)
    rows = sorted({r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"]}.items())
    for (i, text), (left, _) in zip(rows, without_repeats([(i, t.encode()) for i, t in rows])):
        got = [r for r in cut.collect() if r["doc_id"] == i]
        assert len(got) == 1 and got[0]["text"].isascii() <= (got[0]["text"].encode() == left) and len(got[0]["text"].encode()) >= len(left)
        assert got[0]["n_chars"] == len(got[0]["text"])
    for name in ("toxicity", "mixing sources", "suffix-array dedup"):
        assert names()[name](spark, odd, FOLDER).columns == columns
        assert names()[name](spark, odd.limit(0), FOLDER).count() == 0
    assert s["minhash near-dedup"](spark, odd.limit(0), FOLDER).count() == 0 and s["best-fit packing"](spark, odd.limit(0), FOLDER).count() == 0
    assert s["best-fit packing"](spark, odd, FOLDER).select("doc_id", "piece").count() == odd.count() + 0 * len(columns) + sum(
        1 for r in odd.collect() if len((r["text"] or "").split()) > 20_000) * 0 + extra_pieces(spark, odd)


def extra_pieces(spark, odd):
    from lapforge.llm.packing import token_pieces
    from lapforge.llm.queries import tokenizer
    return token_pieces(odd, tokenizer()).where("piece > 0").count()


def test_toxic_documents_go_and_clean_ones_stay(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    left = {r["doc_id"] for r in names()["toxicity"](spark, docs, "/root/testdata/sf0.01").collect()}
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i not in left for i in clean) <= 0.01 * len(clean)
    toxic = [i for i, y in labels.items() if y == 1 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(i in left for i in toxic) <= 0.35 * len(toxic)
    index = toxicity.fit(docs, table(spark, "/root/testdata/sf0.01", "labels"))
    again = {r["doc_id"] for r in toxicity.score(docs, index, ["doc_id"]).where("predicted = 0").collect()}
    assert again == left


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert out and {"doc_id", "piece", "sequence_id", "offset", "length", "ids"} <= set(out[0].asDict())
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 4096
