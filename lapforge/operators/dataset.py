"""The lap-level dataset and its quality summary."""

from pyspark.sql import DataFrame, functions as F

from lapforge.constants import DATASET_COLS, ID_COLS, LAP_KEY, SOURCE_FILE, SPORT_COLS, TARGET, WEATHER_COLS
from lapforge.operators.shape import any_present, conform, typed

SORT_COLS = ["year", "meeting_key", "session_key", "driver_number", "lap_number"]


def dataset_columns(laps: DataFrame) -> DataFrame:
    df = conform(laps, DATASET_COLS + [SOURCE_FILE])
    return typed(df, ints=ID_COLS, doubles=SPORT_COLS + WEATHER_COLS + [TARGET],
                 times=["date_start_session", "date_end_session", "lap_hour_utc"])


def build_dataset(laps: DataFrame) -> DataFrame:
    """Dataset columns of the laps that have a target and at least one weather value."""
    df = dataset_columns(laps)
    if TARGET in df.columns:
        df = df.where(F.col(TARGET).isNotNull())
    weather = [c for c in WEATHER_COLS if c in df.columns]
    return df.where(any_present(weather)) if weather else df


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key, as one row."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_duplicates_key"))


def quality_summary(laps: DataFrame) -> DataFrame:
    """One row over the unfiltered dataset columns."""
    df = dataset_columns(laps)
    weather = [c for c in WEATHER_COLS if c in df.columns]
    keys = [c for c in LAP_KEY if c in df.columns]
    rows = F.count(F.lit(1))
    # One pass: key counts carry the other counters, so the table is scanned and shuffled once.
    target = F.count_if(F.col(TARGET).isNull()) if TARGET in df.columns else rows
    some = F.count_if(F.array_contains(F.array(*[F.col(c).isNull() for c in weather]), True)) if weather else rows
    every = F.count_if(~any_present(weather)) if weather else rows
    per = df.groupBy(*keys).agg(rows.alias("n"), target.alias("t"), some.alias("a"), every.alias("b"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_cols"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates_key"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("missing_target"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("missing_weather_any"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("missing_weather_all"))
