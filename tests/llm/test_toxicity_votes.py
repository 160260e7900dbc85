"""Exact search against all cosines; held-out accuracy; odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapforge.llm import toxicity
from helpers import frame, odd_texts, prose


def test_block_max_search_is_exact():
    r = random.Random(8)
    idf = np.array([1 + r.random() * 5 for _ in range(30)])
    rows = []
    for i in range(700):
        t = tuple(sorted(r.sample(range(30), r.randrange(1, 6))))
        rows.append((i, i % 2, t, tuple(r.randrange(1, 4) for _ in t)))
    index = toxicity.Index({}, idf, rows)
    full = np.zeros((len(index.doc), 30))
    for (t, n), i in index.own.items():
        full[i, list(t)] = index.weights(t, n)
    for _ in range(60):
        t = tuple(sorted(r.sample(range(30), r.randrange(1, 5))))
        n = tuple(r.randrange(1, 3) for _ in t)
        q = np.zeros(30)
        q[list(t)] = index.weights(t, n)
        scores = full @ q
        want = np.sort(scores[scores > 0])[::-1][:15]
        assert np.allclose(np.sort(index.nearest(t, n)[1])[::-1], want)


def corpus(n=900):
    r, rows, labels = random.Random(9), [], []
    for i in range(n):
        toxic = int(r.random() < 0.12)
        bad = [f"{r.choice(['vile', 'nasty', 'awful'])}{r.choice(['', 'ly', 'ish'])}" for _ in range(3 * toxic)]
        words = prose(10_000 + i, 60, 200).split(" ") + bad
        r.shuffle(words)
        rows.append((i, " ".join(words).capitalize() + ".", "s"))
        labels.append((i, toxic if i % 11 else None, "x"))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    return docs, known, toxicity.fit(docs, known), dict((i, y) for i, y, _ in labels)


def test_held_out_accuracy_and_evidence(fitted):
    docs, known, index, truth = fitted
    out = {r["doc_id"]: r for r in toxicity.score(docs, index, docs.columns).collect()}
    asked = [(i, y) for i, y in truth.items() if y is not None and zlib.crc32(str(i).encode()) % 3 == 1]
    wrong = [i for i, y in asked if out[i]["predicted"] != y]
    assert len(asked) > 150 and len(wrong) <= 0.02 * len(asked), wrong
    assert all(0 <= r["score"] <= 1 and (r["predicted"] == 1) == (r["score"] >= 0.7) for r in out.values())
    assert all(e["doc_id"] in truth for r in out.values() for e in r["evidence"]) and any(r["evidence"] for r in out.values())


def test_held_out_labels_do_not_matter(spark, fitted):
    docs, known, index, _ = fitted
    other = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.score(docs, index, ["doc_id"]).collect()
    b = toxicity.score(docs, toxicity.fit(docs, other), ["doc_id"]).collect()
    assert {r["doc_id"]: r["score"] for r in a} == {r["doc_id"]: r["score"] for r in b}


def test_odd_rows_and_empty_tables(spark, fitted):
    docs, known, index, _ = fitted
    odd = frame(spark, odd_texts() + [(None, "vile vilely", "s"), (4, "one two", "s2")])
    got = toxicity.score(odd, index, odd.columns)
    assert set(got.columns) == set(odd.columns) | {"evidence"} and got.count() == len(odd_texts()) + 2
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    assert scores[1] == scores[2] == scores[3] == index.base()
    assert toxicity.score(odd.limit(0), index, ["doc_id"]).count() == 0
    none = toxicity.fit(docs, known.limit(0))
    assert {r["predicted"] for r in toxicity.score(odd, none, ["doc_id"]).collect()} == {0}
    assert toxicity.fit(odd.limit(0), known).base() < 0.7


def test_the_sample_is_bounded(spark, fitted):
    docs, known, _, _ = fitted
    assert sum(toxicity.fit(docs, known, examples=50).count) <= 50
