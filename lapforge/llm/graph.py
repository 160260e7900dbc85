"""Connected components by alternating stars, each round stored in the shared folder."""

from pyspark.sql import DataFrame, functions as F

from lapforge.llm.common import stored


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches.

    Large stars move a node's larger neighbours to its smallest one, small stars its smaller ones; the rounds grow with
    the logarithm of the longest path. A node with very many edges is summed before the shuffle and split by the join.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, "edges")
    before = _state(e)
    while before[0]:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
