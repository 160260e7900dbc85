"""Session context on laps."""

from pyspark.sql import DataFrame, functions as F

from lapforge.constants import SCOPE_COLS
from lapforge.operators.shape import floor_hour, require, typed
from lapforge.session import lookup

_RENAMED = {"date_start": "date_start_session", "date_end": "date_end_session"}
NO_CONTEXT = "missing_session_meta"
MISMATCH = "meeting_key_mismatch"


def add_context(laps: DataFrame, scope: DataFrame, parity: bool = False) -> DataFrame:
    """Left join of the session's columns. A lap whose session is unknown keeps what it has.

    scope holds one row per session. meeting_key_mismatch compares the lap's own meeting with
    the session's; with parity=True the comparison comes after the overwrite and never differs.
    """
    require(laps, ["session_key"])
    require(scope, ["session_key"])
    laps = typed(laps, times=["date_start"])
    if "date_start" not in laps.columns:
        laps = laps.withColumn("date_start", F.lit(None).cast("timestamp"))
    brought = [c for c in SCOPE_COLS if c in scope.columns and c != "session_key"]
    side = lookup(scope.select("session_key", F.lit(True).alias("_known"), *[F.col(c).alias(f"_s_{c}") for c in brought]))
    joined = laps.join(side, "session_key", "left")
    known = F.col("_known").isNotNull()

    values = {c: F.col(c) for c in laps.columns}
    for c in brought:
        name = _RENAMED.get(c, c)
        own = F.col(name) if name in laps.columns else F.lit(None)
        values[name] = F.when(known, F.col(f"_s_{c}")).otherwise(own)
    values["lap_hour_utc"] = floor_hour("date_start")
    values[NO_CONTEXT] = ~known
    if "meeting_key" in brought and "meeting_key" in laps.columns:
        differs = F.lit(False) if parity else F.col("meeting_key") != F.col("_s_meeting_key")
        values[MISMATCH] = F.when(known & F.col("_s_meeting_key").isNotNull() & F.col("meeting_key").isNotNull(), differs)
    return joined.select(*[v.alias(n) for n, v in values.items()])


def context_report(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("n_in"), F.count_if(F.col(NO_CONTEXT)).alias("n_missing_session_meta"),
        F.count_if(F.col("date_start").isNull()).alias("n_missing_lap_date_start"),
        F.count_if(F.coalesce(F.col(MISMATCH), F.lit(False))).alias("n_meeting_key_mismatch"))


def circuits_per_session(enriched: DataFrame) -> DataFrame:
    """Sessions whose laps name more than one circuit; expected to be empty."""
    return enriched.groupBy("session_key").agg(
        F.min("circuit_key").alias("lowest"), F.max("circuit_key").alias("highest")).where("lowest <> highest")
