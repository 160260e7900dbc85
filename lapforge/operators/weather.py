"""Hourly weather on laps through circuit -> page -> station."""

from pyspark.sql import DataFrame, functions as F

from lapforge.constants import WEATHER_COLS
from lapforge.functions.text import page_id
from lapforge.operators.shape import any_present, first_per_key, require
from lapforge.session import lookup
from lapforge.sources.landing import one_row_per_hour
from lapforge.sources.weather_store import hours_in_use, is_stored

URL = "wikipedia_circuit_url"


def circuit_stations(circuit_urls: DataFrame, url_stations: DataFrame) -> DataFrame:
    """circuit_key -> page URL -> station_id; circuits with a gap in the chain are absent."""
    require(circuit_urls, ["circuit_key", URL])
    require(url_stations, ["circuit_url", "station_id"])
    urls = circuit_urls.select(F.col("circuit_key").try_cast("long").alias("circuit_key"), URL).dropna()
    urls = first_per_key(urls, ["circuit_key"], [URL]).withColumn("circuit_id", page_id(URL))
    stations = first_per_key(
        url_stations.select(F.col("circuit_url").alias(URL), F.col("station_id").cast("string").alias("station_id")).dropna(),
        [URL], ["station_id"])
    return urls.join(stations, URL).select("circuit_key", URL, "circuit_id", "station_id")


def unmapped_circuits(laps: DataFrame, mapping: DataFrame) -> DataFrame:
    return laps.select("circuit_key").distinct().join(mapping, "circuit_key", "left_anti")


def needed_hours(laps: DataFrame, mapping: DataFrame) -> DataFrame:
    """The (station_id, year) pairs that laps ask weather of: a few rows per circuit."""
    years = laps.where("lap_hour_utc IS NOT NULL").select("circuit_key", F.year("lap_hour_utc").alias("year")).distinct()
    return years.join(mapping.select("circuit_key", "station_id"), "circuit_key").select("station_id", "year").distinct()


def attach_weather(laps: DataFrame, mapping: DataFrame, hours: DataFrame) -> DataFrame:
    """Laps of mapped circuits, left-joined to the station's hour.

    Stored hours (weather_store) are read by the folders that the laps' circuits and years need. Hours of another form are
    read whole, cut to the stations in use, and brought to one row per hour. Either usually leaves a table small enough to
    spare the laps a shuffle; lookup measures it.
    """
    require(laps, ["circuit_key", "lap_hour_utc"])
    mapping = lookup(mapping.select("circuit_key", URL, "station_id"))
    present = [c for c in WEATHER_COLS if c in hours.columns]
    if is_stored(hours):
        used = hours_in_use(hours, lookup(needed_hours(laps, mapping)))
    else:
        wanted = mapping.select("station_id").distinct()
        used = one_row_per_hour(hours.select("station_id", "weather_hour_utc", *present).join(wanted, "station_id", "left_semi"))
    used = lookup(used.select("station_id", F.col("weather_hour_utc").alias("lap_hour_utc"), "weather_hour_utc", *present))
    located = laps.join(mapping, "circuit_key")
    joined = located.join(used, ["station_id", "lap_hour_utc"], "left")
    for c in set(WEATHER_COLS) - set(present):
        joined = joined.withColumn(c, F.lit(None).cast("double"))
    return joined


def with_weather_only(joined: DataFrame) -> DataFrame:
    return joined.where(any_present(WEATHER_COLS))


def weather_report(joined: DataFrame) -> DataFrame:
    """Counters per session over the join before laps without weather are dropped."""
    missing = ~any_present(WEATHER_COLS)
    return joined.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("n_in"), F.count_if(~missing).alias("n_out"),
        F.count_if(missing).alias("n_missing_weather"), F.min("circuit_key").alias("circuit_key"),
        F.min("station_id").alias("station_id"))


def failed_sessions(laps: DataFrame, mapping: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """Sessions that yield nothing, with the reason: no station, no usable lap hour, or (given the
    weather hours) no weather year for a lap's year."""
    per = laps.groupBy("session_key").agg(
        F.min("circuit_key").alias("circuit_key"), F.count("lap_hour_utc").alias("_hours"))
    gaps = per.join(mapping.select("circuit_key", "station_id"), "circuit_key", "left").select(
        "session_key", F.when(F.col("station_id").isNull(), "circuit has no station").when(
            F.col("_hours") == 0, "no lap hour").alias("error")).where("error IS NOT NULL")
    if hours is None:
        return gaps
    needed = laps.where("lap_hour_utc IS NOT NULL").select(
        "session_key", "circuit_key", F.year("lap_hour_utc").alias("_year")).distinct()
    year = F.col("year") if is_stored(hours) else F.year("weather_hour_utc")
    have = hours.select("station_id", year.alias("_year")).distinct()
    lacking = needed.join(mapping.select("circuit_key", "station_id"), "circuit_key").join(
        have, ["station_id", "_year"], "left_anti").groupBy("session_key").agg(
        F.concat(F.lit("no weather for "), F.array_join(F.array_sort(F.collect_set(F.col("_year").cast("string"))), ","))
        .alias("error"))
    return gaps.unionByName(lacking)


def strict_sessions(joined: DataFrame, failed: DataFrame) -> DataFrame:
    """Drop every lap of a session that has any gap."""
    return joined.join(failed.select("session_key"), "session_key", "left_anti")
