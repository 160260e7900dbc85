"""Every registered query, each with the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lapforge.plans import shapes as S
from lapforge.plans.shapes import Shapes, plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def nudge(digits: int) -> float:
    """Added before rounding in both engines. Averages of few-decimal values often end in an exact
    half at the last digit, and the order of summation would then decide the rounding."""
    return 0.017 * 10.0 ** -digits


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register a function of Shapes under a name, with its checking SQL if there is one."""
    def add(fn):
        QUERIES[name] = lambda spark, folder: comparable(fn(Shapes(spark, folder)), digits)
        if sql is not None:
            ORACLES[name] = plain(sql)
        return fn
    return add


def comparable(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, decimals as doubles, times as text, arrays joined, intervals in seconds."""
    def show(f: T.StructField):
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.DecimalType, T.DoubleType, T.FloatType)):
            return (F.round(c.cast("double") + F.lit(nudge(digits)), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        if isinstance(t, T.DateType):
            return c.cast("string").alias(f.name)
        if isinstance(t, T.ArrayType):
            return F.array_join(c.cast("array<string>"), "|").alias(f.name)
        if isinstance(t, T.DayTimeIntervalType):
            parts = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}
            total = sum((F.extract(F.lit(p), c) * n for p, n in parts.items()), F.lit(0))
            return total.cast("long").alias(f.name)
        return c.alias(f.name)
    return df.select(*[show(f) for f in df.schema.fields])


def r(expr: str, name: str | None = None, digits: int = DIGITS) -> str:
    return f"(round({expr} + {nudge(digits):e}, {digits}) + 0.0)" + (f" AS {name}" if name else "")


def rounded(expr: str, name: str, digits: int) -> str:
    """A value the query itself rounds."""
    return r(f"round({expr}, {digits})", name)


def t(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')" + (f" AS {name}" if name else "")


def cols(names, fn=None, prefix: str = "") -> str:
    return ", ".join(f"{fn(prefix + n)} AS {n}" if fn else prefix + n for n in names)


def ctes(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts) + "\n"


LAPS = ("laps_v", S.LAPS)
SESSIONS = ("sessions_v", S.SESSIONS)
SESSIONS_TWICE = ("sessions_v", S.SESSIONS_TWICE)
WEATHER = ("wx_v", S.WEATHER)
FACTS_V = ("facts_v", S.FACTS)
EVENTS = ("events_v", S.EVENTS)
ORDER = ", ".join(S.LAP_ORDER)

SCOPE_SQL = """SELECT *, date_trunc('hour', date_start) AS session_start_hour_utc FROM (
  SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY year, meeting_key, date_start) AS rn
  FROM sessions_v WHERE session_type = 'Race') s WHERE rn = 1"""

RULE0 = ("rule0", """SELECT *, CASE WHEN lap_duration IS NULL THEN 'null_target' WHEN lap_duration <= 0 THEN 'nonpositive_target'
  WHEN coalesce(is_pit_out_lap, false) THEN 'pit_out' END AS first_rule FROM laps_v""")
BOUNDS = ("bounds", """SELECT * FROM (SELECT session_key, quantile_cont(lap_duration, 0.01) AS low_threshold,
  quantile_cont(lap_duration, 0.99) AS high_threshold, count(*) AS n FROM rule0 WHERE first_rule IS NULL GROUP BY session_key) q
  WHERE n >= 20 AND low_threshold < high_threshold""")
LABELLED = ("labelled", """SELECT a.*, low_threshold, high_threshold, coalesce(first_rule,
  CASE WHEN lap_duration < low_threshold OR lap_duration > high_threshold THEN 'outlier' END) AS removed_by
  FROM rule0 a LEFT JOIN bounds b ON a.session_key = b.session_key""")
CLEAN = ("clean", "SELECT * FROM labelled WHERE removed_by IS NULL")
SCOPE = ("scope", SCOPE_SQL)
CTX = ("ctx", """SELECT l.*, date_trunc('hour', l.date_start) AS lap_hour_utc, s.session_key IS NULL AS missing_session_meta,
  CASE WHEN s.session_key IS NOT NULL THEN l.meeting_key <> s.meeting_key END AS meeting_key_mismatch,
  coalesce(s.meeting_key, l.meeting_key) AS ctx_meeting, s.session_name, s.session_type, s.location, s.country_name,
  s.gmt_offset, s.date_start AS date_start_session, s.date_end AS date_end_session
  FROM clean l LEFT JOIN scope s ON l.session_key = s.session_key""")
MAPPING = ("mapping", """SELECT circuit_key, u.wikipedia_circuit_url, station_id FROM urls u JOIN stations_u s ON u.wikipedia_circuit_url = s.circuit_url""")
URLS = ("urls", S.CIRCUIT_URLS)
URL_STATIONS = ("stations_u", S.URL_STATIONS)
JOINED = ("joined", """SELECT c.*, m.station_id, m.wikipedia_circuit_url, w.temp, w.rhum, w.pres, w.wspd, w.wdir, w.prcp, w.cldc,
  coalesce(w.temp, w.rhum, w.pres, w.wspd, w.wdir, w.prcp, w.cldc) IS NULL AS no_weather
  FROM ctx c JOIN mapping m ON c.circuit_key = m.circuit_key
  LEFT JOIN wx_v w ON w.station_id = m.station_id AND w.weather_hour_utc = c.lap_hour_utc""")
PIPE = [LAPS, SESSIONS_TWICE, WEATHER, URLS, URL_STATIONS, RULE0, BOUNDS, LABELLED, CLEAN, SCOPE, CTX, MAPPING, JOINED]


def dec(c: str, scale: int) -> str:
    return f"CAST(CAST({c} AS VARCHAR) AS DECIMAL(10,{scale}))"


FACTS = ("facts", f"""SELECT CAST(meeting_key AS INTEGER) AS meeting_key, CAST(session_key AS INTEGER) AS session_key,
  CAST(driver_number AS INTEGER) AS driver_number, CAST(lap_number AS INTEGER) AS lap_number, CAST(year AS INTEGER) AS year,
  CAST(circuit_key AS INTEGER) AS circuit_key, lap_hour_utc,
  {", ".join(f"{dec(c, 2)} AS {c}" for c in ["st_speed", "i1_speed", "i2_speed"])},
  {", ".join(f"{dec(c, 3)} AS {c}" for c in ["duration_sector_1", "duration_sector_2", "duration_sector_3"])},
  {", ".join(f"{dec(c, 2)} AS {c}" for c in ["temp", "rhum", "pres", "wspd", "wdir", "prcp", "cldc"])},
  {dec("lap_duration", 3)} AS lap_duration, __source_file AS source_file
  FROM (SELECT *, row_number() OVER (PARTITION BY meeting_key, session_key, driver_number, lap_number ORDER BY {ORDER}) AS rn
        FROM facts_v) f WHERE rn = 1 AND lap_duration IS NOT NULL""")
DIM_DRIVERS = ("dim_drivers", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY driver_number ORDER BY session_key) AS rn
  FROM drivers_v) d WHERE rn = 1""")
DRIVERS_V = ("drivers_v", S.DRIVERS)
DIM_SESSIONS = ("dim_sessions", f"SELECT * FROM ({SCOPE_SQL}) s2")
DIM_CIRCUITS = ("dim_circuits", """SELECT * FROM (SELECT CAST(circuit_key AS INTEGER) AS circuit_key, circuit_short_name, location,
  country_name, country_code, row_number() OVER (PARTITION BY circuit_key ORDER BY year, meeting_key, session_key) AS rn
  FROM sessions_v) c WHERE rn = 1""")
