"""Exploration: null ratios, cardinalities, value counts, gaps, summaries."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lapforge.functions.timing import sector_delta
from lapforge.operators.ordered import quantiles
from lapforge.operators.shape import first_per_key


def null_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of nulls per column, in one pass."""
    cols = list(columns or df.columns)
    one = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    return one.unpivot([], cols, "column_name", "null_ratio")


def cardinalities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Counts per value; nulls are a value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum of one column."""
    value = df.select(F.col(column).cast("double").alias("value")).where("value IS NOT NULL")
    basic = value.agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                      F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = quantiles(value, [], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    q = basic.withColumn("_q", quartiles.select(F.struct("p25", "p50", "p75")).scalar())
    return q.select("count", "mean", "std", "min", "_q.p25", "_q.p50", "_q.p75", "max")


def describe_sector_delta(laps: DataFrame) -> DataFrame:
    return describe(laps.withColumn("delta", sector_delta()), "delta")


def gap_histogram(hours: DataFrame, key: str = "station_id", time: str = "weather_hour_utc") -> DataFrame:
    """How often each gap to the previous row occurs, in seconds, per key in time order.

    Equal times are counted first (each repeat is a gap of 0), so the window sees distinct hours
    only: a key's window is bounded by the calendar, however many rows it has.
    """
    distinct = hours.where(F.col(time).isNotNull()).groupBy(key, time).agg(F.count(F.lit(1)).alias("n"))
    previous = F.lag(time).over(Window.partitionBy(key).orderBy(time))
    seconds = (F.unix_timestamp(F.col(time)) - F.unix_timestamp(previous)).alias("gap_seconds")
    steps = distinct.select(seconds, F.lit(1).cast("long").alias("n")).where("gap_seconds IS NOT NULL")
    repeats = distinct.where("n > 1").select(F.lit(0).cast("long").alias("gap_seconds"), (F.col("n") - 1).alias("n"))
    return steps.unionByName(repeats).groupBy("gap_seconds").agg(F.sum("n").alias("n"))


def max_lap_gaps(laps: DataFrame, order: Sequence[str], first: int = 10) -> DataFrame:
    """Largest step between consecutive lap numbers among the first rows of each session and driver.

    The rank limit bounds each group before the shuffle; the steps come from a sorted array.
    """
    place = F.row_number().over(Window.partitionBy("session_key", "driver_number").orderBy(*order))
    head = laps.withColumn("_rank", place).where(F.col("_rank") <= first)
    numbers = head.groupBy("session_key", "driver_number").agg(F.array_sort(F.collect_set("lap_number")).alias("laps"))
    steps = F.zip_with(F.slice("laps", 2, first), F.slice("laps", F.lit(1), F.greatest(F.size("laps") - 1, F.lit(0))), lambda b, a: b - a)
    return numbers.select("session_key", "driver_number", F.array_max(steps).alias("max_gap")).where("max_gap IS NOT NULL")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once. A join and not a window: a key with very many
    copies is then split by AQE and never sorted in one task."""
    return df.join(repeated_keys(df, keys).drop("n"), list(keys), "left_semi")


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, order)
