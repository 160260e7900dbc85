"""Readers for landed files."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapforge import schemas
from lapforge.constants import LAP_KEY, SECTOR_COLS, SOURCE_FILE, SPEED_COLS, TARGET, WEATHER_COLS
from lapforge.functions.timing import hour_from_parts
from lapforge.operators.shape import first_per_key, limit_sessions, require, typed

SESSION_FILE = r"^laps_session_(\d+)\.(csv|parquet)$"


class NoData(RuntimeError):
    pass


def read_csv(spark: SparkSession, path, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_session_files(spark: SparkSession, folder: str, fmt: str = "csv", schema=None,
                       sessions: int = 0) -> DataFrame:
    """All laps_session_<key> files of a folder as one table with the key and the file name."""
    reader = spark.read.option("pathGlobFilter", f"laps_session_*.{fmt}")
    if fmt == "csv":
        reader = reader.option("header", True).schema(schema or schemas.LAP_RECORDS)
    name = F.col("_metadata.file_name")
    df = reader.format(fmt).load(folder).select("*", name.alias(SOURCE_FILE)).where(F.col(SOURCE_FILE).rlike(SESSION_FILE))
    key = F.regexp_extract(SOURCE_FILE, SESSION_FILE, 1).cast("long")
    return limit_sessions(df.withColumn("session_key", key), sessions)


def lap_records(spark: SparkSession, path, scope: DataFrame | None = None) -> DataFrame:
    """Typed laps from landed JSON arrays; year and meeting come from the scope where absent."""
    raw = spark.read.schema(schemas.LAP_RECORDS).option("multiLine", True).json(path)
    return type_laps(raw, scope)


LAP_TYPES = {"ints": LAP_KEY, "doubles": [TARGET, *SECTOR_COLS, *SPEED_COLS], "times": ["date_start"], "bools": ["is_pit_out_lap"]}


def type_laps(raw: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    laps = typed(raw, **LAP_TYPES)
    if scope is None:
        return laps
    known = scope.select("session_key", F.col("meeting_key").alias("_meeting"), F.col("year").alias("_year"))
    joined = laps.join(known, "session_key", "left")
    year = F.coalesce("year", "_year") if "year" in laps.columns else F.col("_year")
    return joined.withColumn("meeting_key", F.coalesce("meeting_key", "_meeting")).withColumn("year", year) \
        .drop("_meeting", "_year")


def sessions_without_laps(laps: DataFrame, scope: DataFrame) -> DataFrame:
    """Sessions in scope for which nothing was landed: one failed row each in the step report."""
    return scope.select("session_key").distinct().join(
        laps.select("session_key").distinct(), "session_key", "left_anti")


def session_records(spark: SparkSession, path) -> DataFrame:
    """Session records landed under year=<y> folders or carrying their own year."""
    return spark.read.schema(schemas.SESSION_RECORDS).option("multiLine", True).json(path)


def year_availability(sessions: DataFrame, years: Sequence[int]) -> DataFrame:
    """One row per requested year: OK with its row count, or EMPTY."""
    asked = sessions.sparkSession.createDataFrame([(int(y),) for y in years], "year long")
    counted = sessions.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    rows = F.coalesce("n", F.lit(0))
    return asked.join(counted, "year", "left").select(
        "year", rows.alias("rows"), F.when(rows > 0, "OK").otherwise("EMPTY").alias("status"))


def sessions_for_years(sessions: DataFrame, years: Sequence[int]) -> DataFrame:
    """Sessions of the requested years; a year with no rows at all is an error."""
    require(sessions, ["year"])
    kept = sessions.where(F.col("year").isin(list(years)))
    empty = [r["year"] for r in year_availability(kept, years).where("status = 'EMPTY'").collect()]
    if empty:
        raise NoData(f"no session rows for years {sorted(empty)}")
    return kept


def driver_records(spark: SparkSession, path, scope: DataFrame | None = None) -> DataFrame:
    drivers = spark.read.schema(schemas.DRIVER_RECORDS).option("multiLine", True).json(path)
    return drivers if scope is None else drivers.join(scope.select("session_key").distinct(), "session_key", "left_semi")


def station_hours(spark: SparkSession, path) -> DataFrame:
    """Hourly weather landed as <station>__<country>__<locality>/<year>.csv[.gz]."""
    raw = read_csv(spark, path, schemas.WEATHER_RECORDS)
    source = F.col("_metadata.file_path")
    return type_station_hours(raw.select(
        F.regexp_extract(source, r"/([^/_]+)__[^/]*/[^/]+$", 1).alias("station_id"), "*",
        F.col("_metadata.file_name").alias(SOURCE_FILE)))


def type_station_hours(raw: DataFrame) -> DataFrame:
    """Station, hour and numeric weather columns. Hours that do not exist are dropped: a null
    hour must never match a lap with a null hour."""
    require(raw, ["station_id", "year", "month", "day", "hour"])
    numeric = typed(raw, doubles=WEATHER_COLS)
    parts = [F.col(c).try_cast("int") for c in ("year", "month", "day", "hour")]
    present = [c for c in WEATHER_COLS if c in raw.columns]
    extra = [SOURCE_FILE] if SOURCE_FILE in raw.columns else []
    return numeric.select("station_id", hour_from_parts(*parts).alias("weather_hour_utc"), *present, *extra) \
        .where(F.col("weather_hour_utc").isNotNull())


def one_row_per_hour(hours: DataFrame) -> DataFrame:
    """A second row for the same station and hour would multiply laps; the smallest one stays."""
    key = ["station_id", "weather_hour_utc"]
    values = [c for c in hours.columns if c not in key]
    return first_per_key(hours, key, values or key)


def station_catalogue(spark: SparkSession, stations, names) -> tuple[DataFrame, DataFrame]:
    return read_csv(spark, stations, schemas.STATIONS), read_csv(spark, names, schemas.STATION_NAMES)


def overrides(spark: SparkSession, path) -> DataFrame:
    return read_csv(spark, path, schemas.OVERRIDES)


def register_star(spark: SparkSession, folder: str) -> list[str]:
    """Make the loaded tables queryable by name."""
    for name in schemas.STAR:
        spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(name)
    return list(schemas.STAR)
