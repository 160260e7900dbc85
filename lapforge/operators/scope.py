"""Session scope and circuits in use."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lapforge.constants import SCOPE_COLS
from lapforge.functions.text import joined_variants
from lapforge.operators.shape import conform, first_per_key, floor_hour, require, to_whole, typed


def build_scope(sessions: DataFrame, years: Sequence[int] | None = None, session_type: str = "Race") -> DataFrame:
    """Sessions of one type, one row per session_key, with the UTC hour they start in."""
    df = conform(sessions, SCOPE_COLS, required=["session_type", "meeting_key", "session_key", "year"])
    if years is not None:
        df = df.where(F.col("year").isin(list(years)))
    df = typed(df.where(F.col("session_type") == session_type), times=["date_start", "date_end"])
    if "date_start" in df.columns:
        df = df.withColumn("session_start_hour_utc", floor_hour("date_start"))
    ends = [c for c in ("year", "meeting_key", "date_start") if c in df.columns]
    return first_per_key(df, ["session_key"], ends + [c for c in df.columns if c not in ends and c != "session_key"])


def ends_before_start(scope: DataFrame) -> DataFrame:
    return scope.where(F.col("date_end") < F.col("date_start"))


def circuits_in_use(sessions: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """One row per circuit: most frequent names (ties go to the smaller), name variants, years."""
    require(sessions, ["circuit_key", "circuit_short_name", "country_name", "location"])
    if years:
        require(sessions, ["year"])
        sessions = sessions.where(F.col("year").isin(list(years)))
    df = sessions.withColumn("circuit_key", to_whole(F.col("circuit_key"), sessions.schema["circuit_key"].dataType)).dropna(
        subset=["circuit_key", "circuit_short_name"])
    # Names are counted per (circuit, name) first, so a circuit with very many sessions is
    # reduced to its few distinct names before it is gathered.
    names = ["circuit_short_name", "country_name", "location"]
    extra = ["year"] if "year" in df.columns else []
    seen = df.select("circuit_key", *[F.col(c).cast("string").alias(c) for c in names + extra]).unpivot(
        "circuit_key", names + extra, "field", "text").where("text IS NOT NULL")
    counted = seen.groupBy("circuit_key", "field", "text").agg(F.count(F.lit(1)).alias("n"))

    def most_frequent(field):
        return F.min_by("text", F.when(F.col("field") == field, F.struct(-F.col("n"), F.col("text")))).alias(field)

    def variants(field, name):
        return joined_variants(F.when(F.col("field") == field, F.col("text"))).alias(name)

    picks = [most_frequent(c) for c in names] + [variants("location", "location_variants")]
    if extra:
        picks.append(variants("year", "years_present"))
    return counted.groupBy("circuit_key").agg(*picks).orderBy(
        F.col("country_name").asc_nulls_last(), F.col("circuit_short_name").asc_nulls_last(), "circuit_key")


def latest_drivers(drivers: DataFrame) -> DataFrame:
    """One row per driver number: the record of the most recent session."""
    recent = [F.col("session_key").desc_nulls_last()] if "session_key" in drivers.columns else []
    order = recent + [c for c in drivers.columns if c not in ("driver_number", "session_key")]
    return first_per_key(drivers.dropna(subset=["driver_number"]), ["driver_number"], order)
