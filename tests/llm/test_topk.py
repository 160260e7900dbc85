"""Largest inner products against the whole matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapforge.llm.topk import open_pairs, top_products


def brute(vectors, queries, k):
    out = []
    for q, x in queries:
        scored = sorted(((-max(min(int(np.dot(x, y)), 2**63 - 1), -2**63), i) for i, y in vectors if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def made(n, d, seed, spread):
    r = np.random.RandomState(seed)
    v = r.normal(size=(n, d)) * np.exp(spread * r.normal(size=(n, 1)))
    v[n // 2:n // 2 + n // 4] = v[n // 2]  # a third as copies of one vector
    v[:3] = 0
    return [(i * 3, [int(c) for c in np.floor(64 * x)]) for i, x in enumerate(v)]


@pytest.mark.parametrize("spread,bucket,block", [(0.0, 50, 7), (1.0, 40, 1000), (0.3, 10_000, 10), (2.0, 8, 8)])
def test_same_as_all_products(spark, spread, bucket, block):
    rows = made(300, 12, 5, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<int>").withColumn("bucket", F.lit("x")).withColumn("floor", F.lit("x"))
    got = top_products(df, df.where("vec_id % 20 = 0"), 7, bucket_rows=bucket, query_rows=block)
    want = brute(rows, [(i, x) for i, x in rows if i % 20 == 0], 7)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want


def test_odd_rows(spark):
    rows = [(1, [1, 2]), (2, None), (3, [1, None]), (None, [1, 1]), (4, [5]), (5, []), (20, [2, 1]), (40, [-1, -1]), (60, [0, 0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<int>")
    good = [(i, x) for i, x in rows if i and x and len(x) == 2 and None not in x]
    got = top_products(df, df.where("vec_id % 20 = 0"), 20)
    assert sorted(map(tuple, got.collect())) == brute(good, [x for x in good if x[0] % 20 == 0], 20)
    assert top_products(df.limit(0), df, 3).count() == 0 and top_products(df, df.limit(0), 3).count() == 0


def test_mixed_numbers_of_components_meet_their_own_kind(spark):
    rows = [r for d in (1, 3, 5) for r in [(i * 20 + d, v) for i, v in made(60, d, d, 0.5)]] + [(1000, []), (1001, []), (1020, [7, 7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    asked = df.where("vec_id % 3 <> 1")
    got = sorted(map(tuple, top_products(df, asked, 4, bucket_rows=15, query_rows=6).collect()))
    want = []
    for d in (0, 1, 2, 3, 5):
        own = [r for r in rows if len(r[1]) == d]
        want += brute(own, [r for r in own if r[0] % 3 != 1], 4)
    assert got == sorted(want)


def test_large_components_are_exact(spark, tmp_path):
    r = np.random.RandomState(3)
    rows = [(i, [int(x) for x in r.randint(-2**29, 2**29, 4)]) for i in range(1, 60)] + [(60, [2**62, 2**62, 0, 0]), (61, [2**62, -2**62, 1, 1]), (62, [3, 1, 4, 1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    exact = [(i, np.array(x, object)) for i, x in rows]
    got = sorted(map(tuple, top_products(df, df, 5, bucket_rows=20, query_rows=9).collect()))
    assert got == brute(exact, exact, 5)
    floats = spark.createDataFrame([(20, [4e7, 1.0]), (1, [4e7, -1.0]), (2, [1e30, 0.0]), (3, [float("nan"), 1.0]), (40, [0.5, 0.25])], "vec_id long, embedding array<double>")
    floats.write.parquet(f"{tmp_path}/embeddings.parquet")
    from lapforge.llm.queries import QUERIES
    best = QUERIES["op2_norm_bucket_topk"](spark, str(tmp_path)).where("query_id = 20").orderBy("rank").collect()
    assert [x["vec_id"] for x in best] == [2, 1, 40] and best[1]["score"] == (64 * 40_000_000) ** 2 - 64 * 64


def test_pairs_that_cannot_reach_a_floor_are_not_shuffled(spark):
    long_ = [(i, float(1000 - i), i // 10) for i in range(100)]
    dealt = spark.createDataFrame(long_, "id long, length double, bucket int").withColumn("d", F.lit(2))
    armed = spark.createDataFrame([(0, 0.0), (0, 990.0), (1, 955.0), (2, float("inf"))], "block long, need double").withColumn("d", F.lit(2))
    got = {(x["block"], x["bucket"]) for x in open_pairs(armed, dealt).collect()}
    assert got == {(0, b) for b in range(1, 10)} | {(1, b) for b in range(1, 5)}
