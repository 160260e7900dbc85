"""Data-quality checks: one row (check, observed, limit, passed) per check.

All checks of one table that are plain aggregates share a single pass over it.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lapforge.constants import SECTOR_COLS, SPEED_COLS, TARGET
from lapforge.functions.timing import sector_delta
from lapforge.operators.profile import max_lap_gaps, repeated_keys
from lapforge.operators.shape import columns_missing, union_named

REQUIRED = [
    "year", "meeting_key", "session_key", "circuit_key", "driver_number", "lap_number", "session_name", "session_type",
    "location", "country_name", "date_start_session", "st_speed", "i1_speed", "i2_speed", "duration_sector_1",
    "duration_sector_2", "duration_sector_3", "temp", "rhum", "pres", "lap_duration"]
NUMERIC = ["st_speed", "i1_speed", "i2_speed", "lap_duration", "temp", "pres"]
NULL_LIMITS = {"lap_duration": 0.01, "driver_number": 0.01, "circuit_key": 0.01, "st_speed": 0.10, "i1_speed": 0.20,
               "i2_speed": 0.20}
WEATHER_LIMITS = {"temp": (-10, 50), "rhum": (0, 100), "pres": (900, 1100)}

_OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
        "=": lambda a, b: a == b}


@dataclass(frozen=True)
class Check:
    name: str
    observed: Column
    op: str
    limit: float
    # Result when there is nothing to observe.
    when_empty: bool = True


def _share(cond: Column, among: Column) -> Column:
    return F.count_if(cond & among) / F.nullif(F.count_if(among), F.lit(0))


def aggregate_checks(df: DataFrame) -> list[Check]:
    have = set(df.columns)
    rows = F.count(F.lit(1))
    lap = F.col(TARGET)
    checks = [Check("rows", rows, ">", 1000)]
    for c in SPEED_COLS:
        x = F.col(c)
        checks += [Check(f"{c} min", F.min(c), ">=", 20, False), Check(f"{c} max", F.max(c), "<=", 380, False),
                   Check(f"{c} share 150-370", _share(x.between(150, 370), x.isNotNull()), ">=", 0.75, False)]
    checks += [
        Check("lap_duration min", F.min(lap), ">=", 50, False), Check("lap_duration max", F.max(lap), "<=", 1200, False),
        Check("lap_duration share 60-130", _share(lap.between(60, 130), lap.isNotNull()), ">=", 0.60, False),
        Check("lap_duration share above 300", F.avg((F.coalesce(lap, F.lit(0.0)) > 300).cast("int")), "<", 0.001)]
    for c, limit in NULL_LIMITS.items():
        checks.append(Check(f"{c} null ratio", F.avg(F.col(c).isNull().cast("int")), "<", limit))
    if have.issuperset(SECTOR_COLS):
        delta = sector_delta()
        checks.append(Check("sector sum within 2 s", _share(delta < 2.0, delta.isNotNull()), ">=", 0.85))
    for c, (low, high) in WEATHER_LIMITS.items():
        if c in have:
            checks += [Check(f"{c} min", F.min(c), ">=", low), Check(f"{c} max", F.max(c), "<=", high)]
    checks += [
        Check("driver_number min", F.min("driver_number"), ">", 0), Check("circuit_key min", F.min("circuit_key"), ">", 0),
        Check("lap_number min", F.min("lap_number"), ">=", 1), Check("year min", F.min("year"), ">=", 2023),
        Check("year max", F.max("year"), "<=", 2025)]
    return checks


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """All checks in one aggregate, then one row per check."""
    one = df.agg(*[c.observed.cast("double").alias(f"c{i}") for i, c in enumerate(checks)])
    rows = F.array(*[
        F.struct(F.lit(c.name).alias("check_name"), F.col(f"c{i}").alias("observed"),
                 F.concat(F.lit(c.op + " "), F.lit(str(float(c.limit)))).alias("limit_text"),
                 F.coalesce(_OPS[c.op](F.col(f"c{i}"), F.lit(float(c.limit))), F.lit(c.when_empty)).alias("passed"))
        for i, c in enumerate(checks)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def _constant(df: DataFrame, name: str, observed: float, op: str, limit: float) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(name, float(observed), f"{op} {float(limit)}", bool(_OPS[op](observed, limit)))],
        "check_name string, observed double, limit_text string, passed boolean")


def schema_checks(df: DataFrame) -> DataFrame:
    """Required columns and numeric types, read from the schema alone."""
    wrong = [c for c in NUMERIC if c in df.columns and not isinstance(df.schema[c].dataType, T.NumericType)]
    return union_named([_constant(df, "required columns missing", len(columns_missing(df, REQUIRED)), "=", 0),
                        _constant(df, "non-numeric measure columns", len(wrong), "=", 0)])


def key_checks(df: DataFrame, order: list[str]) -> DataFrame:
    """Laps whose (session, driver, lap) repeats, and the largest lap gap."""
    repeats = repeated_keys(df, ["session_key", "driver_number", "lap_number"])
    a = run_checks(repeats, [Check("repeated lap rows", F.coalesce(F.sum("n"), F.lit(0)), "=", 0)])
    b = run_checks(max_lap_gaps(df, order), [Check("largest lap gap", F.coalesce(F.max("max_gap"), F.lit(0)), "<=", 20)])
    return a.unionByName(b)


def dataset_checks(df: DataFrame, order: list[str]) -> DataFrame:
    return union_named([run_checks(df, aggregate_checks(df)), schema_checks(df), key_checks(df, order)])


def mapping_check(mapping: DataFrame, lat: str = "wikipedia_latitude", lon: str = "wikipedia_longitude") -> DataFrame:
    hole = F.col(lat).isNull() | F.col(lon).isNull()
    return run_checks(mapping, [Check("circuits without coordinates", F.count_if(hole), "=", 0)])


def pipeline_checks(summary: DataFrame, counts: DataFrame) -> DataFrame:
    """Thresholds on the dataset summary plus one non-empty check per loaded table."""
    on_summary = run_checks(summary, [
        Check("dataset rows", F.max("n_rows"), ">", 0, False),
        Check("duplicate lap keys", F.max("n_duplicates_key"), "=", 0),
        Check("missing targets", F.max("missing_target"), "=", 0)])
    tables = counts.select(
        F.concat(F.col("table"), F.lit(" rows")).alias("check_name"), F.col("rows").cast("double").alias("observed"),
        F.lit("> 0.0").alias("limit_text"), (F.col("rows") > 0).alias("passed"))
    return on_summary.unionByName(tables)


def all_passed(checks: DataFrame) -> bool:
    return checks.where(~F.col("passed")).limit(1).count() == 0
