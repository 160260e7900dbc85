"""Weather hours kept as a table by station and year, so that a join reads only the folders its laps ask for."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lapforge.constants import WEATHER_COLS
from lapforge.sources.landing import one_row_per_hour

PARTS = ["station_id", "year"]
# Declared, because a station id such as 007 would be taken for a number if it were read off the folder names.
SCHEMA = T.StructType([T.StructField("weather_hour_utc", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in WEATHER_COLS),
                       T.StructField("station_id", T.StringType()), T.StructField("year", T.IntegerType())])


def write_hours(hours: DataFrame, path: str) -> None:
    """One row per station and hour under station_id=<s>/year=<y>, in order of time.

    Only the stations and years in hours are replaced: a later delivery leaves the others alone. Missing columns are null;
    rows without a station or hour are left out. Small parts share a task and large ones are split.
    """
    have = [F.col(c).cast("double").alias(c) if c in hours.columns else F.lit(None).cast("double").alias(c) for c in WEATHER_COLS]
    known = hours.where("station_id IS NOT NULL AND weather_hour_utc IS NOT NULL").select(F.col("station_id").cast("string"), "weather_hour_utc", *have)
    rows = one_row_per_hour(known).withColumn("year", F.year("weather_hour_utc"))
    rows.hint("rebalance", *PARTS).sortWithinPartitions(*PARTS, "weather_hour_utc").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def stored_hours(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def is_stored(hours: DataFrame) -> bool:
    """Whether hours come by station and year, one row per hour."""
    return set(PARTS) <= set(hours.columns)


def hours_in_use(hours: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored hours of the (station_id, year) pairs in wanted.

    The pairs are broadcast and prune the folders before they are listed for reading. The condition on year takes nothing
    away; without one on the pairs' side the optimiser does not think pruning worth while.
    """
    pairs = wanted.select(F.col("station_id").cast("string").alias("station_id"), F.col("year").cast("int").alias("year")).where("year > 0")
    return hours.join(pairs, PARTS, "left_semi")
