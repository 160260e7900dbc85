"""What the operators share: stored intermediate tables, gapless numbering, corpus words and hashes."""

import math
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lapforge.functions.memory import give_back
from lapforge.session import fresh_path, lookup, shared_folder

# White space of the word definition used throughout: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
TEXT_TURN = 8 << 20  # bytes of text that a task works on at a time
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Shuffle files of the actions inside go as soon as the action ends; for actions whose result is a table."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str = "stored", partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the folder all executors share. Cuts the lineage: a lost executor costs no earlier step."""
    spark = df.sparkSession
    path = fresh_path(spark, f"llm-{name}")
    with short_lived_shuffles(spark):
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, pattern: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(path) or []:
        fs.delete(status.getPath(), True)


def drop_stored(spark: SparkSession) -> None:
    """Remove this application's intermediate tables. Call it once results are written."""
    delete_folder(spark, f"{shared_folder(spark)}/llm-*")


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Enough partitions for rows_each rows in a task, at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_each))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it if df has such a column already (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def running(df: DataFrame, group: list[str], order: list[Column], spread: Column, value: Column, out: str,
            chunk_rows: int = 200_000) -> DataFrame:
    """df with `out`: the sum of value over the rows of the same group that come before this one (0 for the first).

    Groups of any size: rows of a group are dealt over chunks by `spread` (a hash of the row), and a group's chunks
    follow one another, each in the given order. Sums per (group, chunk) are the only thing that is gathered: one row
    per chunk_rows rows, and one per group.
    """
    chunk, first, own = free_name(df, "chunk"), free_name(df, "first_value"), free_name(df, "own_value")
    df = df.withColumn(own, value.cast("long"))
    largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    chunks = max(1, math.ceil(largest / chunk_rows))
    df = df.withColumn(chunk, F.pmod(spread, F.lit(chunks)).cast("int"))
    upto = W.partitionBy(*group, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(own).over(upto), F.lit(0))
    if chunks == 1:
        return df.withColumn(out, inside).drop(chunk, own)
    sums = df.groupBy(*group, chunk).agg(F.sum(own).alias(first))
    before = F.sum(first).over(W.partitionBy(*group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1))
    starts = sums.withColumn(first, F.coalesce(before, F.lit(0)))
    starts = starts.select(*(F.col(c).alias(f"{first}_{c}") for c in [*group, chunk]), first)
    same = [F.col(c).eqNullSafe(F.col(f"{first}_{c}")) for c in group] + [F.col(chunk) == F.col(f"{first}_{chunk}")]
    df = df.withColumn(out, inside).join(lookup(starts), same, "left")
    return df.withColumn(out, F.col(out) + F.col(first)).drop(chunk, own, *starts.columns)


def numbered(df: DataFrame, group: list[str], order: list[Column], spread: Column, out: str,
             chunk_rows: int = 200_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, however many rows a group has."""
    return running(df, group, order, spread, F.lit(1), out, chunk_rows)


# ---- hashing of bytes and numbers inside tasks ----

MULTIPLIER = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def tidy(task):
    """The same mapInArrow function, which gives back memory when a task ends."""
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()
    return run


def tidy_group(apply):
    """The same applyInArrow function, which gives back memory after large groups."""
    def run(table):
        large = table.nbytes > 1 << 20
        try:
            return apply(table)
        finally:
            if large:
                give_back()
    return run


def turns(batch, column: str, most: int | None = None):
    """The rows of an Arrow batch in slices of about `most` bytes of text (a longer text alone). Spark bounds batches by rows, so one may
    hold all texts of a task; what a task makes of its texts is then held for a slice at a time. Nothing is copied."""
    import pyarrow as pa
    import pyarrow.compute as pc
    size = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    turn = (np.cumsum(size) - size) // (most or TEXT_TURN)
    edges = np.flatnonzero(np.append(True, turn[1:] != turn[:-1]))[:len(turn)]
    for a, b in zip(edges, np.append(edges[1:], len(turn))):
        yield batch.slice(a, b - a)


def bytes_of(batch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column of an Arrow batch; null is empty."""
    import pyarrow as pa
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
