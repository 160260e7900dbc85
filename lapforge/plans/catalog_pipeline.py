"""Pipeline queries: sources, cleaning, context, weather, dataset, star schema, quality."""

from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.operators import clean, context, dataset, ordered, profile, quality, scope, shape, star, weather
from lapforge.plans import pipeline, shapes as S
from lapforge.plans.catalog import (BOUNDS, CLEAN, CTX, DIM_CIRCUITS, DIM_DRIVERS, DIM_SESSIONS, DRIVERS_V, FACTS, FACTS_V, JOINED,
                                    LABELLED, LAPS, MAPPING, ORDER, PIPE, RULE0, SCOPE, SESSIONS, SESSIONS_TWICE, URL_STATIONS,
                                    URLS, WEATHER, cols, ctes, query, r, rounded, t)
from lapforge.session import fresh_path, lookup
from lapforge.sources import landing, pages, retention, sinks

# ---- sources ------------------------------------------------------------------------------------

RAW_LAPS = """SELECT CAST(meeting_key AS VARCHAR(20)) AS meeting_key, CAST(session_key AS VARCHAR(20)) AS session_key,
  CASE WHEN l_orderkey % 29 = 0 THEN 'n/a' WHEN l_orderkey % 43 = 0 THEN 'NaN' WHEN l_orderkey % 47 = 0 THEN 'Infinity' WHEN l_orderkey % 53 = 0 THEN '1e300'
    WHEN l_orderkey % 59 = 0 THEN '7.9' WHEN l_orderkey % 61 = 0 THEN '12d' WHEN l_orderkey % 67 = 0 THEN ' 12.0 '
    ELSE CAST(driver_number AS VARCHAR(20)) END AS driver_number,
  CAST(lap_number AS VARCHAR(20)) AS lap_number,
  CASE WHEN l_orderkey % 31 = 0 THEN 'DNF' WHEN l_orderkey % 71 = 0 THEN 'NaN' WHEN l_orderkey % 73 = 0 THEN '80.5f' ELSE CAST(lap_duration AS VARCHAR(40)) END AS lap_duration,
  CASE WHEN l_orderkey % 37 = 0 THEN '2024-02-30 10:00:00' ELSE '2024-02-28 10:00:00' END AS date_start,
  CASE WHEN is_pit_out_lap THEN 'true' WHEN NOT is_pit_out_lap THEN 'false' END AS is_pit_out_lap,
  CAST(st_speed AS VARCHAR(40)) AS st_speed FROM ({laps}) x""".replace("{laps}", S.LAPS)

@query("typed_lap_records", ctes(("raw", RAW_LAPS), ("known", f"SELECT * FROM ({S.SESSIONS}) k WHERE session_type = 'Race'")) + f"""
SELECT CAST(raw.session_key AS BIGINT) AS session_key, any_value(known.year) AS year, count(*) AS n,
  count(CASE WHEN trim(driver_number) IN ('n/a', 'NaN', 'Infinity', '1e300', '7.9', '12d') THEN NULL ELSE driver_number END) AS n_driver,
  sum(CASE WHEN trim(driver_number) IN ('n/a', 'NaN', 'Infinity', '1e300', '7.9', '12d') THEN 0 WHEN trim(driver_number) = '12.0' THEN 12
    ELSE CAST(driver_number AS BIGINT) END)::BIGINT AS sum_driver, count(CASE WHEN lap_duration <> 'NaN' THEN TRY_CAST(lap_duration AS DOUBLE) END) AS n_lap,
  count(TRY_CAST(raw.date_start AS TIMESTAMP)) AS n_start, {rounded("sum(CASE WHEN lap_duration <> 'NaN' THEN TRY_CAST(lap_duration AS DOUBLE) END)", "total", 4)},
  count(CASE WHEN is_pit_out_lap = 'true' THEN 1 END) AS n_pit
FROM raw LEFT JOIN known ON CAST(raw.session_key AS BIGINT) = known.session_key GROUP BY 1""")
def _(s: S.Shapes):
    raw = s.view(RAW_LAPS)
    laps = landing.type_laps(raw, s.sessions.where("session_type = 'Race'"))
    return laps.groupBy("session_key").agg(
        F.max("year").alias("year"), F.count(F.lit(1)).alias("n"), F.count("driver_number").alias("n_driver"),
        F.sum("driver_number").alias("sum_driver"), F.count("lap_duration").alias("n_lap"), F.count("date_start").alias("n_start"),
        F.round(F.sum("lap_duration"), 4).alias("total"), F.count_if("is_pit_out_lap").alias("n_pit"))


@query("coercion_counts", ctes(("raw", RAW_LAPS)) + """
SELECT 'driver_number' AS column_name, count(CASE WHEN trim(driver_number) IN ('n/a', 'NaN', 'Infinity', '1e300', '7.9', '12d') THEN 1 END) AS n FROM raw
UNION ALL SELECT 'lap_duration', count(CASE WHEN lap_duration IN ('DNF', 'NaN', '80.5f') THEN 1 END) FROM raw
UNION ALL SELECT 'date_start', count(CASE WHEN date_start LIKE '2024-02-30%' THEN 1 END) FROM raw
UNION ALL SELECT unnest(['meeting_key', 'session_key', 'lap_number', 'is_pit_out_lap', 'st_speed']), 0""")
def _(s): return shape.nulled(s.view(RAW_LAPS), **landing.LAP_TYPES)


@query("year_availability", ctes(SESSIONS) + """
SELECT y AS year, count(session_key) AS rows, CASE WHEN count(session_key) > 0 THEN 'OK' ELSE 'EMPTY' END AS status
FROM (SELECT unnest([2022, 2023, 2024, 2025])::BIGINT AS y) a LEFT JOIN sessions_v ON year = y GROUP BY y""")
def _(s): return landing.year_availability(s.sessions, [2022, 2023, 2024, 2025])


# Every session, and one more per supplier for which nothing was landed.
SCOPE_WITH_GAPS = f"SELECT session_key FROM ({S.SESSIONS}) a UNION ALL SELECT session_key + 1000000 FROM ({S.SESSIONS}) b"

@query("sessions_for_years", ctes(SESSIONS) + "SELECT session_key, year FROM sessions_v WHERE year IN (2023, 2025)")
def _(s): return landing.sessions_for_years(s.sessions, [2023, 2025]).select("session_key", "year")


@query("sessions_without_laps", ctes(LAPS, ("scope_v", SCOPE_WITH_GAPS)) + """
SELECT session_key FROM scope_v WHERE session_key NOT IN (SELECT session_key FROM laps_v)""")
def _(s): return landing.sessions_without_laps(s.laps, s.view(SCOPE_WITH_GAPS))


RAW_HOURS = """SELECT concat('ST', user_id % 25) AS station_id, CAST(2023 + user_id % 2 AS VARCHAR(9)) AS year,
  CAST(1 + user_id % 3 AS VARCHAR(9)) AS month, CAST(1 + event_id % 31 AS VARCHAR(9)) AS day,
  CASE WHEN event_id % 41 = 0 THEN 'x' ELSE CAST(event_id % 25 AS VARCHAR(9)) END AS hour, CAST(value AS VARCHAR(40)) AS temp
FROM {events}"""

@query("station_hours", ctes(("raw", RAW_HOURS)) + f"""
SELECT station_id, {t("h", "weather_hour_utc")}, count(*) AS n, count(temp) AS n_temp, {r("min(CAST(temp AS DOUBLE))", "lowest")} FROM (
  SELECT *, TRY_CAST(printf('%s-%02d-%02d %02d:00:00', year, CAST(month AS INT), CAST(day AS INT), TRY_CAST(hour AS INT)) AS TIMESTAMP) AS h
  FROM raw WHERE TRY_CAST(hour AS INT) < 24) x WHERE h IS NOT NULL GROUP BY station_id, h""")
def _(s):
    hours = landing.type_station_hours(s.view(RAW_HOURS))
    return hours.groupBy("station_id", "weather_hour_utc").agg(
        F.count(F.lit(1)).alias("n"), F.count("temp").alias("n_temp"), F.min("temp").alias("lowest"))


@query("one_row_per_station_hour", ctes(("raw", RAW_HOURS)) + f"""
SELECT station_id, {t("h", "weather_hour_utc")}, {r("min(CAST(temp AS DOUBLE))", "temp")} FROM (
  SELECT *, TRY_CAST(printf('%s-%02d-%02d %02d:00:00', year, CAST(month AS INT), CAST(day AS INT), TRY_CAST(hour AS INT)) AS TIMESTAMP) AS h
  FROM raw WHERE TRY_CAST(hour AS INT) < 24) x WHERE h IS NOT NULL GROUP BY station_id, h""")
def _(s): return landing.one_row_per_hour(landing.type_station_hours(s.view(RAW_HOURS)))


# Each page becomes a listing page with one circuit row, and a circuit page with coordinates, around its own html.
LISTED = """SELECT page_id, concat('https://pages.example.org/wiki/P', page_id) AS url, concat(
  '<table class="plain"><tr><th>Circuit</th></tr></table><table class="wikitable sortable"><tbody><tr><th>Circuit</th><th>Type</th>',
  '<th>Direction</th><th>Length</th><th>Location</th><th>Country</th></tr><tr><td><a href="/wiki/P', page_id, '">Ring &amp; Loop ', page_id,
  '</a> *</td><td>street</td><td>cw</td><td>5</td><td>', CASE WHEN page_id % 4 = 0 THEN '' ELSE concat('<a href="/x">Town', page_id % 9, '</a>') END,
  '</td><td><a href="/f"></a><a href="/c">Land', page_id % 7, '</a></td></tr><tr><td>short row</td></tr></tbody></table>',
  CASE WHEN page_id % 5 = 0 THEN '<span class="geo">unknown</span>' ELSE concat('<span class="geo">', page_id % 90, '.5; -', page_id % 180, '.25</span>') END,
  html) AS html FROM {pages}"""

@query("page_circuits", f"""
SELECT concat('Ring & Loop ', page_id) AS circuit_name, concat('https://pages.example.org/wiki/P', page_id) AS circuit_url,
  CASE WHEN page_id % 4 <> 0 THEN concat('Town', page_id % 9) END AS locality, concat('Land', page_id % 7) AS country,
  CASE WHEN page_id % 5 <> 0 THEN {r("page_id % 90 + 0.5::DOUBLE")} END AS latitude,
  CASE WHEN page_id % 5 <> 0 THEN {r("-(page_id % 180 + 0.25::DOUBLE)")} END AS longitude, 'now' AS scraped_at_utc FROM {{pages}}""")
def _(s): return pages.page_circuits(s.view(LISTED), "https://pages.example.org", "now")


# ---- sinks --------------------------------------------------------------------------------------

@query("pending_sessions", ctes(LAPS) + "SELECT session_key, count(*) AS n FROM laps_v WHERE session_key % 2 = 1 GROUP BY 1")
def _(s):
    todo = sinks.pending(s.laps, s.sessions.where("session_key % 2 = 0"))
    return todo.groupBy("session_key").agg(F.count(F.lit(1)).alias("n"))


@query("dim_circuits", ctes(SESSIONS_TWICE, DIM_CIRCUITS) + """SELECT circuit_key, circuit_short_name, location, country_name,
  country_code, CAST(NULL AS VARCHAR) AS wikipedia_circuit_url, CAST(NULL AS VARCHAR) AS station_id FROM dim_circuits""")
def _(s): return star.dim_circuits(s.sessions_twice)


@query("dim_drivers", ctes(DRIVERS_V, DIM_DRIVERS) + """SELECT driver_number, full_name, broadcast_name, name_acronym, first_name,
  last_name, country_code, team_name, team_colour, headshot_url FROM dim_drivers""")
def _(s): return star.dim_drivers(s.drivers)


@query("dim_sessions", ctes(SESSIONS_TWICE, DIM_SESSIONS) + f"""SELECT CAST(session_key AS INTEGER) AS session_key,
  CAST(meeting_key AS INTEGER) AS meeting_key, CAST(year AS INTEGER) AS year, session_name, session_type, {t("date_start", "date_start")},
  {t("date_end", "date_end")}, CASE WHEN gmt_offset = '03:00:00' THEN 10800 ELSE -19800 END::BIGINT AS gmt_offset,
  CAST(circuit_key AS INTEGER) AS circuit_key FROM dim_sessions""")
def _(s): return star.dim_sessions(scope.build_scope(s.sessions_twice))


def facts(s):
    return star.fact_laps(s.facts, S.LAP_ORDER)


@query("fact_laps", ctes(FACTS_V, FACTS) + f"""SELECT meeting_key, session_key, driver_number, lap_number, year, circuit_key,
  {t("lap_hour_utc", "lap_hour_utc")}, {cols(K.SPORT_COLS + K.WEATHER_COLS + ["lap_duration"], lambda c: r(f"CAST({c} AS DOUBLE)"))}, source_file FROM facts""")
def _(s): return facts(s)


@query("load_summary", ctes(FACTS_V, FACTS) + f"""SELECT count(*) AS total_laps, count(DISTINCT session_key) AS sessions,
  count(DISTINCT driver_number) AS drivers, min(year) AS min_year, max(year) AS max_year, {rounded("avg(CAST(lap_duration AS DOUBLE))", "avg_lap_duration", 3)},
  count(CASE WHEN temp IS NULL THEN 1 END) AS missing_temp FROM facts""")
def _(s): return star.load_summary(facts(s))


@query("star_table_counts", ctes(FACTS_V, FACTS, SESSIONS_TWICE, DIM_CIRCUITS, DRIVERS_V, DIM_DRIVERS, DIM_SESSIONS) + """
SELECT 'fact_laps' AS "table", count(*) AS rows FROM facts UNION ALL SELECT 'dim_circuits', count(*) FROM dim_circuits
UNION ALL SELECT 'dim_drivers', count(*) FROM dim_drivers UNION ALL SELECT 'dim_sessions', count(*) FROM dim_sessions""")
def _(s): return star.table_counts(star_tables(s))


def star_tables(s):
    return {"fact_laps": facts(s), "dim_circuits": star.dim_circuits(s.sessions_twice),
            "dim_drivers": star.dim_drivers(s.drivers), "dim_sessions": star.dim_sessions(scope.build_scope(s.sessions_twice))}


@query("constraint_violations", ctes(LAPS, FACTS_V, ("f", "SELECT * FROM facts_v"), SESSIONS, DRIVERS_V, ("ds", """
  SELECT * FROM sessions_v WHERE session_type = 'Race'"""), ("dc", "SELECT DISTINCT circuit_key FROM sessions_v WHERE circuit_key <> 3"),
  ("dd", "SELECT * FROM drivers_v WHERE driver_number <> 7"), ("v", """
SELECT 'dim_circuits: primary key' AS constraint_name, 0 AS violations UNION ALL SELECT 'dim_circuits: not null', 0 UNION ALL SELECT 'dim_circuits: text length', 0
UNION ALL SELECT 'dim_drivers: primary key', (SELECT count(*) - count(DISTINCT driver_number) FROM dd)
UNION ALL SELECT 'dim_drivers: not null', 0
UNION ALL SELECT 'dim_drivers: text length', 0
UNION ALL SELECT 'dim_sessions: primary key', 0 UNION ALL SELECT 'dim_sessions: not null', 0 UNION ALL SELECT 'dim_sessions: text length', 0
UNION ALL SELECT 'fact_laps: primary key', (SELECT count(*) - count(DISTINCT (meeting_key, session_key, driver_number, lap_number)) FROM f)
UNION ALL SELECT 'fact_laps: not null', (SELECT count(*) FROM f WHERE lap_duration IS NULL)
UNION ALL SELECT 'fact_laps: text length', 0
UNION ALL SELECT 'fact_laps: 0 < lap_duration < 3600', (SELECT count(*) FROM f WHERE lap_duration <= 0 OR lap_duration >= 3600)
UNION ALL SELECT 'dim_sessions: year 2020-2030', 0
UNION ALL SELECT 'dim_drivers: driver_number > 0', 0
UNION ALL SELECT 'dim_sessions.circuit_key -> dim_circuits', (SELECT count(*) FROM ds WHERE circuit_key NOT IN (SELECT circuit_key FROM dc))
UNION ALL SELECT 'fact_laps.session_key -> dim_sessions', (SELECT count(*) FROM f WHERE session_key NOT IN (SELECT session_key FROM ds))
UNION ALL SELECT 'fact_laps.driver_number -> dim_drivers', (SELECT count(*) FROM f WHERE driver_number NOT IN (SELECT driver_number FROM dd))
UNION ALL SELECT 'fact_laps.circuit_key -> dim_circuits', (SELECT count(*) FROM f WHERE circuit_key NOT IN (SELECT circuit_key FROM dc))
""")) + "SELECT constraint_name, CAST(violations AS BIGINT) AS violations FROM v")
def _(s):
    # Unloaded tables on purpose: the fact side keeps duplicates and null targets, dimensions have holes.
    raw = {"dim_circuits": star.dim_circuits(s.sessions.where("circuit_key <> 3")),
           "dim_drivers": s.drivers.where("driver_number <> 7"),
           "dim_sessions": s.sessions.where("session_type = 'Race'"),
           "fact_laps": s.facts.withColumnRenamed("__source_file", "source_file")}
    return star.constraint_violations(raw)


@query("retained_events", """SELECT event_type AS category, count(*) AS n FROM {events} WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-04-09') <=
  CASE event_type WHEN 'view' THEN 90 WHEN 'click' THEN 80 WHEN 'error' THEN 75 ELSE 100000 END GROUP BY 1""")
def _(s):
    policy = {"view": 90, "click": 80, "error": 75}
    kept = sinks.retained(s.events.withColumnRenamed("event_type", "category"), "category", "ts", "2024-04-09 00:00:00", policy)
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# The same policy as a purge of stored rows: what is left, month by month, after folders went and months at the limit were cut.
@query("purged_events", """SELECT event_type AS category, strftime(ts, '%Y-%m') AS month, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
  FROM {events} WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-04-09') <=
  CASE event_type WHEN 'view' THEN 90 WHEN 'click' THEN 80 WHEN 'error' THEN 75 ELSE 100000 END GROUP BY 1, 2""")
def _(s):
    rows = s.events.withColumnRenamed("event_type", "category")
    path = fresh_path(s.spark, "events-by-month")
    retention.write_by_month(rows, path, "ts")
    retention.purge(s.spark, path, rows.schema, "ts", "2024-04-09 00:00:00", {"view": 90, "click": 80, "error": 75})
    left = retention.read_by_month(s.spark, path, rows.schema)
    return left.groupBy("category", "month").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


# ---- scope, cleaning ----------------------------------------------------------------------------

@query("session_scope", ctes(SESSIONS_TWICE, SCOPE) + f"""SELECT year, meeting_key, session_key, session_name, session_type,
  {t("date_start", "date_start")}, {t("date_end", "date_end")}, gmt_offset, circuit_key, circuit_short_name, location, country_name,
  country_code, country_key, {t("session_start_hour_utc", "session_start_hour_utc")} FROM scope WHERE year IN (2023, 2024)""")
def _(s): return scope.build_scope(s.sessions_twice, [2023, 2024])


@query("sessions_ending_before_start", ctes(SESSIONS) + "SELECT session_key FROM sessions_v WHERE date_end < date_start")
def _(s): return scope.ends_before_start(s.sessions).select("session_key")


@query("circuits_in_use", ctes(SESSIONS_TWICE, ("seen", """
  SELECT circuit_key, 'n' AS f, circuit_short_name AS v FROM sessions_v UNION ALL SELECT circuit_key, 'c', country_name FROM sessions_v
  UNION ALL SELECT circuit_key, 'l', location FROM sessions_v"""), ("top", """SELECT * FROM (SELECT circuit_key, f, v,
  row_number() OVER (PARTITION BY circuit_key, f ORDER BY count(*) DESC, v) AS rn FROM seen WHERE v IS NOT NULL GROUP BY circuit_key, f, v) x WHERE rn = 1""")) + """
SELECT k.circuit_key, n.v AS circuit_short_name, c.v AS country_name, l.v AS location, k.location_variants, k.years_present FROM (
  SELECT circuit_key, coalesce(string_agg(DISTINCT trim(location), '|' ORDER BY trim(location)), '') AS location_variants,
    string_agg(DISTINCT CAST(year AS VARCHAR), '|' ORDER BY CAST(year AS VARCHAR)) AS years_present FROM sessions_v GROUP BY circuit_key) k
LEFT JOIN top n ON n.circuit_key = k.circuit_key AND n.f = 'n' LEFT JOIN top c ON c.circuit_key = k.circuit_key AND c.f = 'c'
LEFT JOIN top l ON l.circuit_key = k.circuit_key AND l.f = 'l'""")
def _(s): return scope.circuits_in_use(s.sessions_twice)


@query("latest_drivers", ctes(DRIVERS_V) + """SELECT driver_number, full_name, team_name, session_key FROM (SELECT *,
  row_number() OVER (PARTITION BY driver_number ORDER BY session_key DESC) AS rn FROM drivers_v) d WHERE rn = 1""")
def _(s): return scope.latest_drivers(s.drivers).select("driver_number", "full_name", "team_name", "session_key")


KEPT = ["session_key", "driver_number", "lap_number", "l_orderkey", "l_linenumber"]

@query("clean_laps", ctes(LAPS, RULE0, BOUNDS, LABELLED, CLEAN) + f"SELECT {cols(KEPT)}, {r('lap_duration', 'lap_duration')} FROM clean")
def _(s): return clean.clean_laps(s.laps)[0].select(*KEPT, "lap_duration")


@query("clean_laps_fixed_bounds", ctes(LAPS) + f"""SELECT {cols(KEPT)}, {r('lap_duration', 'lap_duration')} FROM laps_v
  WHERE lap_duration > 0 AND NOT coalesce(is_pit_out_lap, false) AND lap_duration BETWEEN 20 AND 80""")
def _(s):
    rules = clean.CleanRules(use_quantiles=False, min_lap_s=20, max_lap_s=80)
    return clean.clean_laps(s.laps, rules)[0].select(*KEPT, "lap_duration")


@query("clean_report", ctes(LAPS, RULE0, BOUNDS, LABELLED) + f"""SELECT session_key, count(*) AS n_in,
  count(CASE WHEN removed_by IS NULL THEN 1 END) AS n_out, {", ".join(f"count(CASE WHEN removed_by = '{k}' THEN 1 END) AS {n}" for k, n in [
    ("null_target", "removed_null_target"), ("nonpositive_target", "removed_nonpositive_target"), ("pit_out", "removed_pit_out"),
    ("outlier", "removed_outliers")])}, {r("max(low_threshold)", "low_threshold", 9)}, {r("max(high_threshold)", "high_threshold", 9)}
  FROM labelled GROUP BY session_key""", digits=9)
def _(s): return clean.clean_laps(s.laps)[1]


@query("session_quantile_bounds", ctes(LAPS, RULE0, BOUNDS) + f"""SELECT session_key, {r("low_threshold", "low_threshold", 9)},
  {r("high_threshold", "high_threshold", 9)} FROM bounds""", digits=9)
def _(s):
    rules = clean.CleanRules()
    labelled = s.laps.withColumn("rule", clean.fixed_rule(s.laps, rules)).where("rule IS NULL")
    return clean.session_bounds(labelled, rules)


@query("step_report", ctes(LAPS, RULE0, BOUNDS, LABELLED, ("failed", "SELECT DISTINCT session_key FROM laps_v WHERE circuit_key = 24")) + """
SELECT l.session_key, CASE WHEN f.session_key IS NULL THEN count(*) END AS n_in, f.session_key IS NULL AS ok,
  CASE WHEN f.session_key IS NOT NULL THEN 'circuit has no station' END AS error
FROM labelled l LEFT JOIN failed f ON f.session_key = l.session_key GROUP BY l.session_key, f.session_key""")
def _(s):
    report = s.laps.groupBy("session_key").agg(F.count(F.lit(1)).alias("n_in"))
    failed = s.laps.where("circuit_key = 24").select("session_key", F.lit("circuit has no station").alias("error"))
    return sinks.report_table(report, failed)


@query("first_sessions", ctes(LAPS) + """SELECT session_key, count(*) AS n FROM laps_v WHERE session_key IN
  (SELECT DISTINCT session_key FROM laps_v ORDER BY 1 LIMIT 5) GROUP BY 1""")
def _(s): return shape.limit_sessions(s.laps, 5).groupBy("session_key").agg(F.count(F.lit(1)).alias("n"))


# ---- context, weather, dataset ------------------------------------------------------------------

CTX_COLS = ["session_name", "session_type", "location", "country_name", "gmt_offset"]

@query("laps_with_context", ctes(LAPS, SESSIONS_TWICE, ("clean", "SELECT * FROM laps_v"), SCOPE, CTX) + f"""
SELECT {cols(KEPT)}, year, ctx_meeting AS meeting_key, circuit_key, {cols(CTX_COLS)}, {t("date_start_session", "date_start_session")},
  {t("date_end_session", "date_end_session")}, {t("lap_hour_utc", "lap_hour_utc")}, missing_session_meta, meeting_key_mismatch FROM ctx""")
def _(s):
    df = context.add_context(s.laps, scope.build_scope(s.sessions_twice))
    return df.select(*KEPT, "year", "meeting_key", "circuit_key", *CTX_COLS, "date_start_session", "date_end_session",
                     "lap_hour_utc", "missing_session_meta", "meeting_key_mismatch")


@query("context_report", ctes(LAPS, SESSIONS_TWICE, ("clean", "SELECT * FROM laps_v"), SCOPE, CTX) + """
SELECT session_key, count(*) AS n_in, count(CASE WHEN missing_session_meta THEN 1 END) AS n_missing_session_meta,
  count(CASE WHEN date_start IS NULL THEN 1 END) AS n_missing_lap_date_start,
  count(CASE WHEN meeting_key_mismatch THEN 1 END) AS n_meeting_key_mismatch FROM ctx GROUP BY session_key""")
def _(s): return context.context_report(context.add_context(s.laps, scope.build_scope(s.sessions_twice)))


@query("circuits_per_session", ctes(LAPS, ("m", "SELECT session_key, CASE WHEN lap_number = 60 AND session_key % 2 = 0 THEN 99 ELSE circuit_key END AS circuit_key FROM laps_v")) + """
SELECT session_key, min(circuit_key) AS lowest, max(circuit_key) AS highest FROM m GROUP BY 1 HAVING min(circuit_key) <> max(circuit_key)""")
def _(s):
    moved = F.when((F.col("lap_number") == 60) & (F.col("session_key") % 2 == 0), F.lit(99).cast("long")).otherwise(F.col("circuit_key"))
    return context.circuits_per_session(s.laps.withColumn("circuit_key", moved))


@query("circuit_stations", ctes(URLS, URL_STATIONS, MAPPING) + """SELECT circuit_key, wikipedia_circuit_url,
  concat('NATION_', circuit_key, ' ring+1') AS circuit_id, station_id FROM mapping""")
def _(s): return weather.circuit_stations(s.circuit_urls, s.url_stations)


@query("unmapped_circuits", ctes(LAPS, URLS, URL_STATIONS, MAPPING) + """SELECT DISTINCT circuit_key FROM laps_v
  WHERE circuit_key NOT IN (SELECT circuit_key FROM mapping)""")
def _(s): return weather.unmapped_circuits(s.laps, weather.circuit_stations(s.circuit_urls, s.url_stations))


CLEAN_ALL = ("clean", "SELECT * FROM laps_v")
JOIN_PARTS = [LAPS, SESSIONS_TWICE, WEATHER, URLS, URL_STATIONS, CLEAN_ALL, SCOPE, CTX, MAPPING, JOINED]


def weather_joined(s):
    laps = context.add_context(s.laps, scope.build_scope(s.sessions_twice))
    return weather.attach_weather(laps, weather.circuit_stations(s.circuit_urls, s.url_stations), s.stored_hours)


@query("laps_with_weather", ctes(*JOIN_PARTS) + f"""SELECT {cols(KEPT)}, station_id, {t("lap_hour_utc", "lap_hour_utc")},
  {cols(K.WEATHER_COLS, r)} FROM joined WHERE NOT no_weather""")
def _(s):
    return weather.with_weather_only(weather_joined(s)).select(*KEPT, "station_id", "lap_hour_utc", *K.WEATHER_COLS)


@query("hours_in_use", ctes(*JOIN_PARTS) + f"""SELECT station_id, year, count(*) AS n, {r("avg(temp)", "temp")}, {r("max(wspd)", "wspd")} FROM (
  SELECT *, CAST(year(weather_hour_utc) AS INTEGER) AS year FROM wx_v) w WHERE (station_id, year) IN (SELECT DISTINCT station_id, year(lap_hour_utc) FROM joined)
  GROUP BY 1, 2""")
def _(s):
    laps = context.add_context(s.laps, scope.build_scope(s.sessions_twice))
    wanted = weather.needed_hours(laps, weather.circuit_stations(s.circuit_urls, s.url_stations))
    return weather.hours_in_use(s.stored_hours, lookup(wanted)).groupBy("station_id", "year").agg(
        F.count(F.lit(1)).alias("n"), F.avg("temp").alias("temp"), F.max("wspd").alias("wspd"))


@query("weather_report", ctes(*JOIN_PARTS) + """SELECT session_key, count(*) AS n_in, count(CASE WHEN NOT no_weather THEN 1 END) AS n_out,
  count(CASE WHEN no_weather THEN 1 END) AS n_missing_weather, min(circuit_key) AS circuit_key, min(station_id) AS station_id
  FROM joined GROUP BY session_key""")
def _(s): return weather.weather_report(weather_joined(s))


COVERED = "(SELECT station_id FROM wx_v WHERE station_id NOT IN ('ST1', 'ST2'))"

@query("failed_weather_sessions", ctes(LAPS, URLS, URL_STATIONS, MAPPING, WEATHER) + f"""
SELECT DISTINCT session_key, 'circuit has no station' AS error FROM laps_v WHERE circuit_key NOT IN (SELECT circuit_key FROM mapping)
UNION ALL SELECT DISTINCT session_key, 'no weather for 2024' FROM laps_v l JOIN mapping m ON l.circuit_key = m.circuit_key
WHERE l.date_start IS NOT NULL AND m.station_id NOT IN {COVERED}""")
def _(s):
    laps = s.laps.withColumn("lap_hour_utc", shape.floor_hour("date_start"))
    hours = s.weather.where("station_id NOT IN ('ST1', 'ST2')")
    return weather.failed_sessions(laps, weather.circuit_stations(s.circuit_urls, s.url_stations), hours)


DATASET_NUMS = K.SPORT_COLS + ["temp", "rhum", "pres", "wspd", "wdir", "prcp", "cldc", "lap_duration"]


def inputs(s):
    return pipeline.Inputs(s.sessions_twice, s.laps, s.drivers, s.circuit_urls, s.url_stations, s.weather)


@query("dataset", ctes(*PIPE) + f"""SELECT year, ctx_meeting AS meeting_key, session_key, circuit_key, driver_number, lap_number,
  {cols(CTX_COLS)}, {t("date_start_session", "date_start_session")}, {t("date_end_session", "date_end_session")}, {t("lap_hour_utc", "lap_hour_utc")},
  station_id, wikipedia_circuit_url, {cols(DATASET_NUMS, r)} FROM joined WHERE NOT no_weather""")
def dataset_query(s): return pipeline.run(inputs(s)).dataset


@query("dataset_summary", ctes(*PIPE, ("d", "SELECT *, count(*) OVER (PARTITION BY ctx_meeting, session_key, driver_number, lap_number) AS c FROM joined WHERE NOT no_weather")) + """
SELECT count(*) AS n_rows, CAST(30 AS BIGINT) AS n_cols, count(*) - count(DISTINCT (ctx_meeting, session_key, driver_number, lap_number)) AS n_duplicates_key,
  count(*) - count(lap_duration) AS missing_target, 
  count(CASE WHEN temp IS NULL OR rhum IS NULL OR pres IS NULL OR wspd IS NULL OR wdir IS NULL OR prcp IS NULL OR cldc IS NULL THEN 1 END) AS missing_weather_any,
  count(CASE WHEN no_weather THEN 1 END) AS missing_weather_all FROM d""")
def _(s): return pipeline.run(inputs(s)).summary


@query("dataset_by_circuit", ctes(*PIPE) + f"""SELECT circuit_key, count(*) AS laps, count(DISTINCT session_key) AS sessions,
  {r("avg(lap_duration)", "avg_lap")}, {r("avg(temp)", "avg_temp")} FROM joined WHERE NOT no_weather GROUP BY circuit_key""")
def flagship(s):
    return pipeline.run(inputs(s)).dataset.groupBy("circuit_key").agg(
        F.count(F.lit(1)).alias("laps"), F.countDistinct("session_key").alias("sessions"),
        F.avg("lap_duration").alias("avg_lap"), F.avg("temp").alias("avg_temp"))


@query("weather_join_strict", ctes(*JOIN_PARTS) + f"""SELECT session_key, count(*) AS n FROM joined WHERE station_id IN {COVERED}
  GROUP BY session_key""")
def _(s):
    laps = context.add_context(s.laps, scope.build_scope(s.sessions_twice))
    mapping = weather.circuit_stations(s.circuit_urls, s.url_stations)
    hours = s.weather.where("station_id NOT IN ('ST1', 'ST2')")
    joined = weather.strict_sessions(weather.attach_weather(laps, mapping, hours), weather.failed_sessions(laps, mapping, hours))
    return joined.groupBy("session_key").agg(F.count(F.lit(1)).alias("n"))


# ---- profiling and quality ----------------------------------------------------------------------

@query("duplicate_key_count", ctes(LAPS) + """SELECT count(*) - count(DISTINCT (meeting_key, session_key, driver_number, lap_number)) AS n_duplicates_key FROM laps_v""")
def _(s): return dataset.duplicate_rows(s.laps, K.LAP_KEY)


@query("repeated_rows", ctes(LAPS) + """SELECT l_orderkey, l_linenumber, l_partkey, session_key FROM (SELECT *, count(*) OVER
  (PARTITION BY session_key, driver_number, lap_number) AS c FROM laps_v) x WHERE c > 1""")
def _(s): return profile.repeated_rows(s.laps, ["session_key", "driver_number", "lap_number"]).select("l_orderkey", "l_linenumber", "l_partkey", "session_key")


NULL_COLS = ["meeting_key", "session_key", "driver_number", "lap_number", "year", "circuit_key", "is_pit_out_lap", "date_start", "ship_day", *K.SPORT_COLS, K.TARGET]

@query("null_ratios", ctes(LAPS) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {r(f'avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END)', 'null_ratio')} FROM laps_v" for c in NULL_COLS))
def _(s): return profile.null_ratios(s.laps.select(*NULL_COLS), NULL_COLS)


@query("cardinalities", ctes(LAPS) + """SELECT count(*) AS n_rows, count(DISTINCT meeting_key) AS n_meeting_key,
  count(DISTINCT session_key) AS n_session_key, count(DISTINCT driver_number) AS n_driver_number FROM laps_v""")
def _(s): return profile.cardinalities(s.laps, ["meeting_key", "session_key", "driver_number"])


@query("value_frequencies", ctes(LAPS) + "SELECT is_pit_out_lap, count(*) AS n FROM laps_v GROUP BY 1")
def _(s): return profile.value_frequencies(s.laps, "is_pit_out_lap")


@query("describe_sector_delta", ctes(LAPS, ("d", "SELECT abs(lap_duration - (duration_sector_1 + duration_sector_2 + duration_sector_3)) AS x FROM laps_v")) + f"""
SELECT count(x) AS "count", {r("avg(x)", "mean")}, {r("stddev_samp(x)", "std")}, {r("min(x)", "min")}, {r("quantile_cont(x, 0.25)", "p25")},
  {r("quantile_cont(x, 0.5)", "p50")}, {r("quantile_cont(x, 0.75)", "p75")}, {r("max(x)", "max")} FROM d WHERE x IS NOT NULL""")
def _(s): return profile.describe_sector_delta(s.laps)


@query("hour_gaps", ctes(("h", "SELECT concat('ST', user_id % 25) AS station_id, date_trunc('hour', ts) AS h FROM {events}")) + """
SELECT gap_seconds, count(*) AS n FROM (SELECT CAST(epoch(h) - epoch(lag(h) OVER (PARTITION BY station_id ORDER BY h)) AS BIGINT) AS gap_seconds FROM h) x
WHERE gap_seconds IS NOT NULL GROUP BY 1""")
def _(s):
    hours = s.events.select(F.concat(F.lit("ST"), F.col("user_id") % 25).alias("station_id"), F.date_trunc("hour", "ts").alias("weather_hour_utc"))
    return profile.gap_histogram(hours)


@query("max_lap_gaps", ctes(LAPS, ("h", f"""SELECT DISTINCT session_key, driver_number, lap_number FROM (SELECT *, row_number() OVER
  (PARTITION BY session_key, driver_number ORDER BY {ORDER}) AS rn FROM laps_v) x WHERE rn <= 10""")) + """
SELECT session_key, driver_number, max(g) AS max_gap FROM (SELECT *, lap_number - lag(lap_number) OVER (PARTITION BY session_key, driver_number
  ORDER BY lap_number) AS g FROM h) y GROUP BY 1, 2 HAVING max(g) IS NOT NULL""")
def _(s): return profile.max_lap_gaps(s.laps, S.LAP_ORDER)


def _share(cond, among):
    return f"count(CASE WHEN ({cond}) AND ({among}) THEN 1 END) / nullif(count(CASE WHEN {among} THEN 1 END), 0)::DOUBLE"


_DELTA = "abs(lap_duration - (duration_sector_1 + duration_sector_2 + duration_sector_3))"
CHECKS = [("rows", "count(*)", ">", 1000)]
for _c in K.SPEED_COLS:
    CHECKS += [(f"{_c} min", f"min({_c})", ">=", 20), (f"{_c} max", f"max({_c})", "<=", 380),
               (f"{_c} share 150-370", _share(f"{_c} BETWEEN 150 AND 370", f"{_c} IS NOT NULL"), ">=", 0.75)]
CHECKS += [("lap_duration min", "min(lap_duration)", ">=", 50), ("lap_duration max", "max(lap_duration)", "<=", 1200),
           ("lap_duration share 60-130", _share("lap_duration BETWEEN 60 AND 130", "lap_duration IS NOT NULL"), ">=", 0.6),
           ("lap_duration share above 300", "avg(CASE WHEN lap_duration > 300 THEN 1.0::DOUBLE ELSE 0 END)", "<", 0.001)]
CHECKS += [(f"{c} null ratio", f"avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END)", "<", v) for c, v in quality.NULL_LIMITS.items()]
CHECKS += [("sector sum within 2 s", _share(f"{_DELTA} < 2.0", f"{_DELTA} IS NOT NULL"), ">=", 0.85)]
for _c, (_lo, _hi) in quality.WEATHER_LIMITS.items():
    CHECKS += [(f"{_c} min", f"min({_c})", ">=", _lo), (f"{_c} max", f"max({_c})", "<=", _hi)]
CHECKS += [("driver_number min", "min(driver_number)", ">", 0), ("circuit_key min", "min(circuit_key)", ">", 0),
           ("lap_number min", "min(lap_number)", ">=", 1), ("year min", "min(year)", ">=", 2023), ("year max", "max(year)", "<=", 2025)]


def _check_sql(rows, source):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, {r(f'CAST({e} AS DOUBLE)', 'observed')}, '{op} {float(v)}' AS limit_text, ({e}) {op} {v} AS passed FROM {source}"
        for n, e, op, v in rows)


@query("dataset_checks", ctes(FACTS_V, ("heads", f"""SELECT DISTINCT session_key, driver_number, lap_number FROM (SELECT *, row_number() OVER
  (PARTITION BY session_key, driver_number ORDER BY {ORDER}) AS rn FROM facts_v) x WHERE rn <= 10"""), ("gaps", """SELECT lap_number - lag(lap_number)
  OVER (PARTITION BY session_key, driver_number ORDER BY lap_number) AS g FROM heads"""), ("reps", """SELECT count(*) AS n FROM facts_v
  GROUP BY session_key, driver_number, lap_number HAVING count(*) > 1""")) + _check_sql(CHECKS, "facts_v") + " UNION ALL " + _check_sql(
    [("repeated lap rows", "coalesce(sum(n), 0)", "=", 0)], "reps") + " UNION ALL " + _check_sql([("largest lap gap", "coalesce(max(g), 0)", "<=", 20)], "gaps") + """
  UNION ALL SELECT 'required columns missing', 5.0, '= 0.0', false UNION ALL SELECT 'non-numeric measure columns', 0.0, '= 0.0', true""")
def _(s): return quality.dataset_checks(s.facts, S.LAP_ORDER)


@query("load_checks", ctes(*PIPE, ("d", "SELECT * FROM joined WHERE NOT no_weather"), DRIVERS_V, DIM_DRIVERS) + """
SELECT 'dataset rows' AS check_name, count(*)::DOUBLE AS observed, '> 0.0' AS limit_text, count(*) > 0 AS passed FROM d
UNION ALL SELECT 'duplicate lap keys', (count(*) - count(DISTINCT (ctx_meeting, session_key, driver_number, lap_number)))::DOUBLE, '= 0.0',
  count(*) = count(DISTINCT (ctx_meeting, session_key, driver_number, lap_number)) FROM d
UNION ALL SELECT 'missing targets', 0.0, '= 0.0', true
UNION ALL SELECT 'dim_drivers rows', count(*)::DOUBLE, '> 0.0', true FROM dim_drivers
UNION ALL SELECT 'dim_circuits rows', count(DISTINCT circuit_key)::DOUBLE, '> 0.0', true FROM scope
UNION ALL SELECT 'dim_sessions rows', count(*)::DOUBLE, '> 0.0', true FROM scope
UNION ALL SELECT 'fact_laps rows', count(DISTINCT (ctx_meeting, session_key, driver_number, lap_number))::DOUBLE, '> 0.0', true FROM d""")
def _(s):
    result = pipeline.run(inputs(s), frozen=True)
    return result.checks(result.star(inputs(s)))


# ---- ordered primitives -------------------------------------------------------------------------

@query("exact_quantiles", ctes(LAPS) + f"""SELECT circuit_key, driver_number, count(lap_duration) AS n, {r("quantile_cont(lap_duration, 0.5)", "median", 9)},
  {r("quantile_cont(lap_duration, 0.95)", "p95", 9)} FROM laps_v WHERE lap_duration IS NOT NULL GROUP BY 1, 2""", digits=9)
def _(s): return ordered.quantiles(s.laps, ["circuit_key", "driver_number"], "lap_duration", {"median": 0.5, "p95": 0.95})


@query("hour_floor_and_first_seen", ctes(LAPS) + f"""SELECT session_key, l_orderkey, {t("date_trunc('hour', date_start)", "lap_hour_utc")} FROM (
  SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY {ORDER}) AS rn FROM laps_v) x WHERE rn = 1""")
def _(s):
    first = profile.first_seen(s.laps, ["session_key"], S.LAP_ORDER)
    return first.select("session_key", "l_orderkey", shape.floor_hour("date_start").alias("lap_hour_utc"))


@query("union_by_name", ctes(LAPS) + """SELECT session_key, CASE WHEN session_key % 2 = 0 THEN driver_number END AS driver_number, count(*) AS n
  FROM laps_v GROUP BY 1, 2""")
def _(s):
    even = s.laps.where("session_key % 2 = 0").select("session_key", "driver_number")
    odd = s.laps.where("session_key % 2 = 1").select("session_key")
    return shape.union_named([even, odd]).groupBy("session_key", "driver_number").agg(F.count(F.lit(1)).alias("n"))
