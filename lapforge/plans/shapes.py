"""The given tables seen as timing data.

Each shape is one SQL text that Spark and DuckDB both run. Spark gets DataFrames for the
{placeholders}; the checking SQL gets the plain table names.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from lapforge.operators import scope, star
from lapforge.session import built_once, use_utc
from lapforge.sources import star_store, weather_store

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

LAPS = """
SELECT 1000 + l_suppkey + CASE WHEN l_orderkey % 83 = 0 THEN 1 ELSE 0 END AS meeting_key,
  l_suppkey AS session_key,
  l_partkey % 20 + 1 AS driver_number, l_orderkey % 60 + 1 AS lap_number,
  2023 + l_suppkey % 3 AS year, CAST(s_nationkey AS BIGINT) AS circuit_key,
  CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 89 = 0 THEN CAST(0 AS DOUBLE)
       ELSE l_extendedprice / 1000 END AS lap_duration,
  CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false ELSE NULL END AS is_pit_out_lap,
  CASE WHEN l_orderkey % 7  = 0 THEN NULL ELSE 250 + l_quantity END AS st_speed,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE 240 + l_quantity END AS i1_speed,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE 230 + l_quantity END AS i2_speed,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_extendedprice / 5000 + l_discount END AS duration_sector_1,
  CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE l_extendedprice / 2500 + l_tax END AS duration_sector_2,
  CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE l_extendedprice / 2500 + l_quantity / 25 END AS duration_sector_3,
  CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00'
    + (l_orderkey % 720) * INTERVAL '1' HOUR + l_linenumber * INTERVAL '7' MINUTE END AS date_start,
  l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax,
  CAST(l_shipdate AS DATE) AS ship_day
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
"""
LAP_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
             "ship_day"]

SESSIONS = """
SELECT 2023 + s_suppkey % 3 AS year, 1000 + s_suppkey AS meeting_key, s_suppkey AS session_key,
  s_name AS session_name, CASE WHEN s_suppkey % 10 = 9 THEN 'Qualifying' ELSE 'Race' END AS session_type,
  TIMESTAMP '2024-01-01 00:30:00' + s_suppkey * INTERVAL '1' HOUR AS date_start,
  TIMESTAMP '2024-01-01 00:30:00' + (s_suppkey + CASE WHEN s_suppkey % 31 = 0 THEN -1 ELSE 2 END) * INTERVAL '1' HOUR AS date_end,
  CASE WHEN s_suppkey % 2 = 0 THEN '03:00:00' ELSE '-05:30:00' END AS gmt_offset,
  CAST(s_nationkey AS BIGINT) AS circuit_key, n_name AS circuit_short_name,
  CASE WHEN s_suppkey % 4 = 0 THEN concat(' ', n_name, ' park') WHEN s_suppkey % 5 = 0 THEN NULL ELSE n_name END AS location,
  r_name AS country_name, substr(r_name, 1, 3) AS country_code, CAST(r_regionkey AS BIGINT) AS country_key
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

SESSIONS_TWICE = f"""
SELECT * FROM ({SESSIONS}) a UNION ALL
SELECT year, meeting_key, session_key, concat(session_name, ' (again)'), session_type,
  date_start + INTERVAL '3' HOUR, date_end + INTERVAL '3' HOUR, gmt_offset, circuit_key, circuit_short_name, location, country_name,
  country_code, country_key FROM ({SESSIONS}) b WHERE session_key % 7 = 0
"""

WEATHER = """
SELECT concat('ST', user_id % 25) AS station_id, date_trunc('hour', ts) AS weather_hour_utc,
  avg(CASE WHEN event_type = 'view' THEN value END) AS temp,
  avg(CASE WHEN event_type = 'click' THEN value END) AS rhum,
  avg(CASE WHEN event_type = 'purchase' THEN value END) AS pres,
  max(CASE WHEN event_type = 'view' THEN value END) AS wspd, max(CASE WHEN event_type = 'click' THEN value END) AS wdir,
  avg(CASE WHEN event_type = 'error' THEN value END) AS prcp, max(CASE WHEN event_type = 'purchase' THEN value END) AS cldc
FROM {events} GROUP BY 1, 2
"""

CIRCUIT_URLS = """
SELECT CAST(n_nationkey AS BIGINT) AS circuit_key, concat('https://pages.example.org/wiki/', n_name, '%20ring+1') AS wikipedia_circuit_url
FROM {nation} WHERE n_nationkey <> 23
"""
URL_STATIONS = """
SELECT concat('https://pages.example.org/wiki/', n_name, '%20ring+1') AS circuit_url, concat('ST', n_nationkey) AS station_id
FROM {nation} WHERE n_nationkey <> 24
"""

DRIVERS = """
SELECT CAST(p_partkey % 20 + 1 AS INT) AS driver_number, p_name AS full_name, p_name AS broadcast_name,
  upper(substr(p_name, 1, 3)) AS name_acronym, p_name AS first_name, p_type AS last_name, p_type AS country_code,
  p_brand AS team_name, substr(p_type, 1, 6) AS team_colour, CAST(NULL AS VARCHAR(10)) AS headshot_url,
  p_partkey AS session_key
FROM {part}
"""

STATIONS = """
SELECT concat('C', c_custkey) AS id, c_mktsegment AS country, (c_custkey * 37 % 18000) / CAST(100 AS DOUBLE) - 90 AS latitude,
  (c_custkey * 91 % 36000) / CAST(100 AS DOUBLE) - 180 AS longitude, c_acctbal / 10 AS elevation
FROM {customer}
"""
STATION_NAMES = """
SELECT concat('C', c_custkey) AS station, concat(c_name, ' en') AS name, 'en' AS language FROM {customer} WHERE c_custkey % 2 = 0
UNION ALL
SELECT concat('C', c_custkey) AS station, concat(c_name, ' de') AS name, 'de' AS language FROM {customer} WHERE c_custkey % 3 <> 1
"""
# Each supplier is a circuit somewhere on the globe.
CIRCUITS = """
SELECT s_name AS circuit_name, concat('https://pages.example.org/wiki/', s_name) AS circuit_url, n_name AS locality,
  r_name AS country, (s_suppkey * 1571 % 17000) / CAST(100 AS DOUBLE) - 85 AS latitude, (s_suppkey * 2719 % 35000) / CAST(100 AS DOUBLE) - 175 AS longitude
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""


# Laps with weather and a source file, as the dataset step would hand them on.
FACTS = f"""
SELECT *, date_trunc('hour', date_start) AS lap_hour_utc,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 15 + 100 * l_tax END AS temp,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 30 + 500 * l_discount END AS rhum,
  1000 + l_quantity AS pres, CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE l_quantity / 2 END AS wspd,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity * 7 END AS wdir,
  CASE WHEN l_orderkey % 4 = 0 THEN l_discount END AS prcp, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS cldc,
  concat('laps_session_', session_key, '.csv') AS __source_file
FROM ({LAPS}) l
"""

EVENTS = """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, event_type = 'error' AS failed FROM {events}
"""
LATENCY_BOUNDS = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0]


class Shapes:
    """Given tables and their timing views for one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        use_utc(spark)
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, sql: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in sql}
        return self.spark.sql(sql, **used)

    laps = cached_property(lambda self: self.view(LAPS))
    facts = cached_property(lambda self: self.view(FACTS))
    events = cached_property(lambda self: self.view(EVENTS))
    sessions = cached_property(lambda self: self.view(SESSIONS))
    sessions_twice = cached_property(lambda self: self.view(SESSIONS_TWICE))
    weather = cached_property(lambda self: self.view(WEATHER))

    @cached_property
    def stored_hours(self) -> DataFrame:
        """The weather by station and year, written once for an application."""
        path = built_once(self.spark, self.folder, "hours", lambda to: weather_store.write_hours(self.weather, to))
        return weather_store.stored_hours(self.spark, path)

    @cached_property
    def star(self) -> star_store.StoredStar:
        """The star schema as the load writes it, once for an application."""
        def write(to: str) -> None:
            star_store.write({"fact_laps": star.fact_laps(self.facts, LAP_ORDER), "dim_circuits": star.dim_circuits(self.sessions_twice),
                              "dim_drivers": star.dim_drivers(self.drivers), "dim_sessions": star.dim_sessions(scope.build_scope(self.sessions_twice))}, to, placed=True)
        return star_store.StoredStar(self.spark, built_once(self.spark, self.folder, "star", write))

    circuit_urls = cached_property(lambda self: self.view(CIRCUIT_URLS))
    url_stations = cached_property(lambda self: self.view(URL_STATIONS))
    drivers = cached_property(lambda self: self.view(DRIVERS))
    stations = cached_property(lambda self: self.view(STATIONS))
    station_names = cached_property(lambda self: self.view(STATION_NAMES))
    circuits = cached_property(lambda self: self.view(CIRCUITS))


def plain(sql: str) -> str:
    """The same text on plain table names."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
