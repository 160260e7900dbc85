"""Exact top-k by inner product with vectors grouped by length.

Vectors are dealt into buckets of about equal length (norm), longest first. A first pass over the longest bucket gives
each query a floor: no vector below its k-th score can be in the answer. A second pass meets every query block with
every bucket. For a query q and a bucket whose longest vector has length L, the cosine of an answer is at least
floor / (|q| L): where that bound is low, the bucket's vectors (sorted by length) are cut at floor / |q|; where it is
high, the few largest coordinates of q give an interval for each of the same coordinates of v / |v|, and only vectors
within all of them go on. What is left is verified by the whole product, so nothing is approximate.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lapforge.llm.common import stored
from lapforge.session import lookup

BUCKET_ROWS = 8192
QUERY_ROWS = 2048
FOCUS = 6
COSINE_FOR_COORDINATES = 0.3
SLACK = 1e-9
EXACT = 2.0 ** 52  # products of lengths below this are exact in doubles
HIGHEST = 2 ** 63 - 1


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= at)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))


def _candidates(q: np.ndarray, floor: float, length: float, lengths: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, str]:
    """Vectors of a bucket (sorted by length, longest first) that can reach floor with q, and which way they were found."""
    bound = floor / (length * lengths[0]) if floor > 0 and lengths[0] > 0 else 0.0
    if bound > 1 + SLACK:
        return np.empty(0, np.int64), "none"
    if floor > 0:
        within = int(np.searchsorted(-lengths, -(floor / length) * (1 - SLACK), side="right"))
    else:
        within = len(lengths)
    if bound < COSINE_FOR_COORDINATES:
        return np.arange(within), "length"
    bound = min(bound, 1.0)
    q = q / length
    focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
    room = math.sqrt(max(0.0, 1 - bound * bound))
    ok = np.ones(within, bool)
    for f in focus:
        middle, half = q[f] * bound, math.sqrt(max(0.0, 1 - q[f] * q[f])) * room
        # the far end is 1 where the interval around q[f] would wrap past the pole
        high = 1.0 if q[f] >= bound else middle + half
        low = -1.0 if -q[f] >= bound else middle - half
        ok &= (unit[:within, f] <= high + SLACK) & (unit[:within, f] >= low - SLACK)
    return np.flatnonzero(ok), "coordinate"


def _products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of whole-number vectors whose lengths are too large for doubles."""
    return v.astype(object) @ q.astype(object) if len(q) else np.zeros(len(v), object)


def _searched(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k of one bucket for each query of one block."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(vectors):
        vectors = vectors.sort_values(["length", "id"], ascending=[False, True])
        whole, ids, lengths = np.stack(vectors["v"].to_numpy()).astype(np.int64), vectors["id"].to_numpy(), vectors["length"].to_numpy()
        v = whole.astype(np.float64)
        unit = np.asfortranarray(v / np.maximum(lengths, SLACK)[:, None])  # read by column
        q_whole, own = np.stack(queries["v"].to_numpy()).astype(np.int64), queries["id"].to_numpy()
        q, floors, reach = q_whole.astype(np.float64), queries["floor"].to_numpy(), queries["length"].to_numpy()
        for i in range(len(q)):
            floor = -math.inf if np.isnan(floors[i]) else floors[i]
            if reach[i] == 0:  # every product is 0
                near = np.arange(len(v)) if floor <= 0 else np.empty(0, np.int64)
            else:
                near, _ = _candidates(q[i], floor, reach[i], lengths, unit)
            near = near[ids[near] != own[i]]
            if not len(near):
                continue
            if reach[i] * lengths[0] < EXACT:
                scores = v[near] @ q[i]
                near, scores = (near, scores) if floor == -math.inf else (near[scores >= floor], scores[scores >= floor])
                top = _best(scores, ids[near], k)
                found = np.rint(scores[top]).astype(np.int64)
            else:
                scores = [max(min(int(x), HIGHEST), -HIGHEST - 1) for x in _products(whole[near], q_whole[i])]
                top = sorted(range(len(near)), key=lambda x: (-scores[x], ids[near[x]]))[:k]
                found = np.array([scores[x] for x in top], np.int64)
            out["query_id"].append(np.full(len(top), own[i]))
            out["vec_id"].append(ids[near][top])
            out["score"].append(found)
    return pd.DataFrame({c: np.concatenate(x) if x else np.empty(0, np.int64) for c, x in out.items()})


def _dealt(vectors: DataFrame, bucket_rows: int) -> DataFrame:
    """(id, v, d, length, bucket): the vectors of each number of components d in buckets of about bucket_rows, longest first.

    A histogram of lengths is summed from the longest and cut every bucket_rows; vectors of one length that overfill a bucket
    are dealt over the buckets they cover.
    """
    cell = F.floor(F.least(F.col("length"), F.lit(EXACT)) / 4)
    fine = vectors.withColumn("cell", cell).groupBy("d", "cell").agg(F.count("*").alias("in_cell"))
    above = F.sum("in_cell").over(W.partitionBy("d").orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1))
    cells = fine.withColumn("above", F.coalesce(above, F.lit(0)))
    place = F.col("above") + F.pmod(F.xxhash64("id", "v"), F.col("in_cell"))
    return vectors.withColumn("cell", cell).join(cells, ["d", "cell"]).select("id", "v", "d", "length", F.floor(place / bucket_rows).cast("int").alias("bucket"))


def open_pairs(armed: DataFrame, dealt: DataFrame) -> DataFrame:
    """(d, block, bucket): the blocks of queries that a bucket's longest vector can reach the floor of, past the first bucket.

    A query with floor f needs a length of f / |q| at least; a block needs its smallest. All other pairs are never shuffled.
    """
    least = armed.groupBy("d", "block").agg(F.min("need").alias("need"))
    tops = dealt.where("bucket > 0").groupBy("d", "bucket").agg(F.max("length").alias("top"))
    return least.join(tops, "d").where(F.col("need") * (1 - SLACK) <= F.col("top")).select("d", "block", "bucket")


def top_products(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
                 bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k largest inner products with other ids, ties to the smaller id.

    Components are whole numbers of up to 64 bits. Products that doubles hold are taken in doubles, larger ones in unbounded
    integers; a score beyond 64 bits counts as the largest (smallest) such number. Queries meet the vectors with as many components
    as they have. Left out: null ids, null vectors, vectors with null components. A repeated id: every vector of it counts.
    Queries meet vectors block by block; a block is bounded by bucket_rows and query_rows. Empty tables: no rows. Other
    columns are not used.
    """
    def clean(df):
        whole = F.col(vector_col).isNotNull() & ~F.coalesce(F.exists(vector_col, lambda x: x.isNull()), F.lit(True))
        v = df.where(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v"))
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        return v.select("id", "v", F.size("v").alias("d"), F.sqrt(square).alias("length"))

    dealt = stored(_dealt(clean(vectors), bucket_rows), "vectors")
    asked = stored(clean(queries), "queries")
    blocks = asked.groupBy("d").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
    blocks = lookup(blocks)  # one row for each number of components
    schema = "query_id long, vec_id long, score long"

    def met(left, right):
        keys = ("d", "block", "bucket")
        return left.groupBy(*keys).cogroup(right.select("id", "v", "length", *(F.col(c).alias(f"of_{c}") for c in keys)).groupBy(*(f"of_{c}" for c in keys))).applyInPandas(
            lambda a, b: _searched(a, b, k), schema)

    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(hits):
        return hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    unset = asked.join(blocks, "d").select("id", "v", "d", "length", F.lit(None).cast("double").alias("floor"),
                                           F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("bucket"))
    longest = dealt.where("bucket = 0").join(blocks, "d").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    seeds = stored(best(met(unset, longest)), "seeds")
    if not dealt.where("bucket > 0").limit(1).count():
        return seeds.select("query_id", "rank", "vec_id", "score")
    floors = seeds.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    need = F.when(F.col("floor").isNull() | (F.col("floor") <= 0), F.lit(0.0)).when(F.col("length") > 0, F.col("floor") / F.col("length")).otherwise(F.lit(float("inf")))
    armed = asked.join(floors.groupBy("id").agg(F.max("floor").alias("floor")), "id", "left").withColumn("need", need)
    # queries of like needs share a block, so that a block's least need says much of all; many of one need are dealt out
    total = max(1, math.ceil(asked.count() / query_rows))
    ranged = stored(armed.repartitionByRange(total, "d", "need").withColumn("part", F.spark_partition_id()), "armed")
    shares = lookup(ranged.groupBy("d", "part").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("shares")))
    turn = F.pmod(F.xxhash64("id"), F.col("shares")).cast("long")
    armed = ranged.join(shares, ["d", "part"]).select("id", "v", "d", "length", "floor", "need", (F.col("part") * 1_000_000 + turn).alias("block"))
    pairs = lookup(open_pairs(armed, dealt))
    rest = met(armed.join(pairs, ["d", "block"]), dealt.join(pairs.select(F.col("d").alias("pd"), F.col("bucket").alias("pb"), "block"),
                                                            (F.col("d") == F.col("pd")) & (F.col("bucket") == F.col("pb"))))
    return best(seeds.drop("rank").unionByName(rest)).select("query_id", "rank", "vec_id", "score")
