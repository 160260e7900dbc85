"""Serving, feature, matching, drift, model and monitoring queries."""

from pyspark.ml import Pipeline
from pyspark.sql import Window as W, functions as F

from lapforge import constants as K
from lapforge.functions import geo, text, timing
from lapforge.operators import drift, features, match, models, ordered, runs, serve, stages, star, stations
from lapforge.plans import shapes as S
from lapforge.plans.catalog import (DIM_CIRCUITS, DIM_DRIVERS, DRIVERS_V, EVENTS, FACTS, FACTS_V, LAPS, ORDER, SCOPE, SESSIONS, SESSIONS_TWICE,
                                    ORACLES, cols, ctes, query, r, rounded, t)
from lapforge.operators.shape import union_named
from lapforge.session import freeze, fresh_path
from lapforge.sources import star_store, stream
from lapforge.streaming import rules
from lapforge.streaming.monitor import Monitor

FACT_PARTS = [FACTS_V, FACTS]
LAP_OUT = ("meeting_key, session_key, driver_number, lap_number, year, circuit_key, "
           + cols(["lap_duration", *K.SPORT_COLS, "temp", "rhum", "pres"], lambda c: r(f"CAST({c} AS DOUBLE)")))
LAP = "CAST(lap_duration AS DOUBLE)"

# ---- point queries, lists, pages ----------------------------------------------------------------

@query("list_circuits", ctes(SESSIONS_TWICE, DIM_CIRCUITS) + "SELECT circuit_key, circuit_short_name, location, country_name, country_code FROM dim_circuits")
def _(s): return serve.list_circuits(s.star.circuits)


@query("get_circuit", ctes(SESSIONS_TWICE, DIM_CIRCUITS) + """SELECT circuit_key, circuit_short_name, location, country_name, country_code
  FROM dim_circuits WHERE circuit_key = 7""")
def _(s): return serve.get_circuit(s.star.circuits, 7)


@query("list_drivers", ctes(DRIVERS_V, DIM_DRIVERS) + f"SELECT {cols(K.DRIVER_COLS)} FROM dim_drivers")
def _(s): return serve.list_drivers(s.star.drivers)


@query("get_driver", ctes(DRIVERS_V, DIM_DRIVERS) + f"SELECT {cols(K.DRIVER_COLS)} FROM dim_drivers WHERE driver_number = 11")
def _(s): return serve.get_driver(s.star.drivers, 11)


@query("list_sessions", ctes(SESSIONS) + f"""SELECT {cols(K.SESSION_COLS[:-1])}, {t("date_start", "date_start")} FROM (SELECT * FROM sessions_v
  WHERE year = 2024 ORDER BY date_start DESC NULLS FIRST, session_key LIMIT 20) x""")
def _(s): return serve.list_sessions(s.sessions, year=2024, limit=20)


@query("sessions_per_year", ctes(SESSIONS) + "SELECT year, count(*) AS n FROM sessions_v GROUP BY year")
def _(s): return s.sessions.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("filter_laps", ctes(*FACT_PARTS) + f"SELECT {LAP_OUT} FROM facts WHERE year = 2023 AND driver_number = 5")
def _(s): return star_store.filter_laps(s.star, year=2023, driver_number=5)


@query("session_laps", ctes(*FACT_PARTS) + f"SELECT {LAP_OUT} FROM facts WHERE session_key = 7")
def _(s): return star_store.filter_laps(s.star, session_key=7)


@query("stored_star_counts", ctes(*FACT_PARTS, SESSIONS_TWICE, DIM_CIRCUITS, DRIVERS_V, DIM_DRIVERS, ("scope_v", SCOPE[1])) + """
SELECT 'fact_laps' AS "table", count(*) AS rows FROM facts UNION ALL SELECT 'dim_circuits', count(*) FROM dim_circuits UNION ALL
SELECT 'dim_drivers', count(*) FROM dim_drivers UNION ALL SELECT 'dim_sessions', count(*) FROM scope_v""")
def _(s): return star.table_counts(s.star.tables())


@query("laps_page", ctes(*FACT_PARTS) + f"SELECT {LAP_OUT} FROM (SELECT * FROM facts WHERE year = 2024 ORDER BY session_key, driver_number, lap_number, meeting_key LIMIT 100 OFFSET 200) p")
def _(s): return star_store.laps_page(s.star, page=3, page_size=100, year=2024)


@query("laps_page_info", ctes(*FACT_PARTS) + """SELECT count(*) AS total, 3::BIGINT AS page, 100::BIGINT AS page_size,
  CAST(ceil(count(*) / 100.0) AS BIGINT) AS total_pages FROM facts WHERE year = 2024""")
def _(s): return star_store.page_info(s.star, 3, 100, year=2024)


@query("laps_after", ctes(*FACT_PARTS) + f"""SELECT {LAP_OUT} FROM (SELECT * FROM facts WHERE (session_key, driver_number, lap_number) > (50, 7, 30)
  ORDER BY session_key, driver_number, lap_number, meeting_key LIMIT 50) p""")
def _(s): return star_store.laps_after(s.star, (50, 7, 30), 50)


@query("driver_laps", ctes(*FACT_PARTS) + f"""SELECT {LAP_OUT} FROM (SELECT * FROM facts WHERE driver_number = 4 ORDER BY session_key DESC,
  lap_number, meeting_key LIMIT 100) p""")
def _(s): return star_store.driver_laps(s.star, 4)


@query("circuit_laps", ctes(*FACT_PARTS) + f"""SELECT {LAP_OUT} FROM (SELECT * FROM facts WHERE circuit_key = 9 AND year = 2024 ORDER BY lap_duration,
  meeting_key, session_key, driver_number, lap_number LIMIT 100) p""")
def _(s): return star_store.circuit_laps(s.star, 9, 2024)


@query("sample_rows", ctes(*FACT_PARTS) + "SELECT session_key, driver_number, lap_number FROM (SELECT * FROM facts ORDER BY session_key, driver_number, lap_number, meeting_key LIMIT 5) p")
def _(s): return star_store.laps_after(s.star, None, 5).select("session_key", "driver_number", "lap_number")


# ---- statistics ---------------------------------------------------------------------------------

@query("dataset_stats", ctes(*FACT_PARTS, SESSIONS_TWICE, DIM_CIRCUITS, DRIVERS_V, DIM_DRIVERS) + f"""SELECT (SELECT count(*) FROM facts) AS total_laps,
  (SELECT count(*) FROM dim_circuits) AS total_circuits, (SELECT count(*) FROM dim_drivers) AS total_drivers, (SELECT count(*) FROM sessions_v) AS total_sessions,
  (SELECT string_agg(DISTINCT CAST(year AS VARCHAR), '|' ORDER BY CAST(year AS VARCHAR)) FROM facts) AS years,
  (SELECT {t("min(date_start)")} FROM sessions_v) AS first_date, (SELECT {t("max(date_start)")} FROM sessions_v) AS last_date""")
def _(s):
    df = star_store.dataset_stats(s.star, s.sessions_twice)
    return df.select("total_laps", "total_circuits", "total_drivers", "total_sessions", "years",
                     F.col("date_range.min").alias("first_date"), F.col("date_range.max").alias("last_date"))


@query("circuit_averages", ctes(*FACT_PARTS) + f"SELECT circuit_key, {r(f'avg({LAP})', 'circuit_avg')} FROM facts GROUP BY circuit_key")
def _(s): return star_store.circuit_averages(s.star)


@query("circuit_average_display", ctes(*FACT_PARTS, ("a", f"SELECT circuit_key, avg({LAP}) AS m FROM facts GROUP BY 1")) + f"""SELECT circuit_key,
  {rounded("m", "avg_laptime_seconds", 3)}, concat(CAST(floor(m / 60) AS INT), ':', printf('%06.3f', m - floor(m / 60) * 60)) AS avg_laptime_formatted FROM a""")
def _(s): return star_store.circuit_average_display(s.star)


@query("driver_circuit_averages", ctes(*FACT_PARTS) + f"SELECT driver_number, circuit_key, {r(f'avg({LAP})', 'driver_circuit_avg')} FROM facts GROUP BY 1, 2")
def _(s): return star_store.driver_circuit_averages(s.star)


MAXLAP = "SELECT circuit_key, avg(m) AS a FROM (SELECT circuit_key, session_key, max(lap_number) AS m FROM facts GROUP BY 1, 2) x GROUP BY 1"

@query("typical_max_laps", ctes(*FACT_PARTS, ("a", MAXLAP)) + f"SELECT circuit_key, {r('a', 'mean_max_lap')}, CAST(round(a) AS INTEGER) AS typical_max_lap FROM a")
def _(s):
    exact = star_store.typical_max_laps(s.star, rounded=False).withColumnRenamed("typical_max_lap", "mean_max_lap")
    return exact.join(star_store.typical_max_laps(s.star), "circuit_key")


@query("performance_scores", ctes(*FACT_PARTS) + f"""SELECT p.driver_number, p.circuit_key, {r("a - b", "driver_perf_score")} FROM
  (SELECT driver_number, circuit_key, avg({LAP}) AS a FROM facts GROUP BY 1, 2) p JOIN (SELECT circuit_key, avg({LAP}) AS b FROM facts GROUP BY 1) c
  ON p.circuit_key = c.circuit_key""")
def _(s): return star_store.performance_scores(s.star)


PROFILE = {"avg_laptime": ("lap_duration", 90.0), "avg_st_speed": ("st_speed", 310.0), "avg_i1_speed": ("i1_speed", 295.0), "avg_i2_speed": ("i2_speed", 285.0)}
PROFILES = ("profiles", f"""SELECT driver_number, {", ".join(f"coalesce(avg(CAST({c} AS DOUBLE)), {d}) AS {n}" for n, (c, d) in PROFILE.items())}
  FROM (SELECT *, row_number() OVER (PARTITION BY driver_number ORDER BY session_key DESC, lap_number, meeting_key) AS rn FROM facts) x WHERE rn <= 100 GROUP BY 1""")

@query("driver_profiles", ctes(*FACT_PARTS, PROFILES) + f"SELECT driver_number, {cols(PROFILE, r)} FROM profiles")
def _(s): return star_store.driver_profiles(s.star)


# ---- scoring inputs -----------------------------------------------------------------------------

# Parts play requests; drivers, circuits and values run in and out of the allowed ranges.
REQUESTS = """SELECT p_partkey AS request_id, CAST(p_partkey % 104 AS INT) AS driver_number, CAST(p_partkey % 30 AS INT) AS circuit_key,
  p_size * 9.0e0 AS st_speed, 280.0e0 AS i1_speed, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 270.0e0 END AS i2_speed,
  CAST(p_size AS DOUBLE) + 12 AS temp, 50.0e0 AS rhum, 1013.0e0 AS pres, CAST(p_partkey % 70 AS INT) AS lap_number,
  CASE WHEN p_partkey % 3 = 0 THEN 70.0e0 + p_size END AS circuit_avg_laptime,
  CASE WHEN p_partkey % 5 = 0 THEN -0.5e0 END AS driver_perf_score FROM {part}"""
BAD = {"driver_number < 1": "driver_number < 1", "driver_number > 99": "driver_number > 99", "circuit_key < 1": "circuit_key < 1",
       "st_speed > 400": "st_speed > 400", "i2_speed missing": "i2_speed IS NULL", "temp > 60": "temp > 60", "lap_number < 1": "lap_number < 1"}
REASONS = "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in BAD.items()) + ")"

@query("rejected_requests", ctes(("req", REQUESTS)) + f"SELECT request_id, {REASONS} AS reason FROM req WHERE {REASONS} <> ''")
def _(s): return serve.split_requests(s.view(REQUESTS))[1].select("request_id", "reason")


VALID = ("valid", f"SELECT * FROM req WHERE {REASONS} = ''")
ENRICHED = ("enriched", f"""SELECT v.*, 2025 AS year, coalesce(v.circuit_avg_laptime, c.b, 90.0) AS avg_lap,
  coalesce(v.driver_perf_score, coalesce(p.a, c.b) - c.b, 0.0) AS perf, (st_speed + i1_speed + i2_speed) / 3 AS avg_speed,
  least(v.lap_number / coalesce(nullif(round(m.a), 0), 70), 1.0) AS lap_progress, c.b AS circuit_avg
  FROM valid v LEFT JOIN (SELECT circuit_key, avg({LAP}) AS b FROM facts GROUP BY 1) c ON c.circuit_key = v.circuit_key
  LEFT JOIN (SELECT driver_number, circuit_key, avg({LAP}) AS a FROM facts GROUP BY 1, 2) p ON p.circuit_key = v.circuit_key AND p.driver_number = v.driver_number
  LEFT JOIN ({MAXLAP}) m ON m.circuit_key = v.circuit_key""")

@query("enriched_requests", ctes(*FACT_PARTS, ("req", REQUESTS), VALID, ENRICHED) + f"""SELECT request_id, year, {r("avg_lap", "circuit_avg_laptime")},
  {r("perf", "driver_perf_score")}, {r("avg_speed", "avg_speed")}, {r("lap_progress", "lap_progress")} FROM enriched""")
def _(s):
    ok, _ = serve.split_requests(s.view(REQUESTS))
    return serve.enrich_requests(ok, star_store.serving_tables(s.star)).select(
        "request_id", "year", "circuit_avg_laptime", "driver_perf_score", "avg_speed", "lap_progress")


@query("simple_request_defaults", ctes(("req", REQUESTS)) + f"""SELECT request_id, {r("coalesce(temp, 25)", "temp")}, 50.0::DOUBLE AS rhum, 1013.0::DOUBLE AS pres,
  coalesce(lap_number, 1) AS lap_number FROM req""")
def _(s):
    return serve.with_simple_defaults(s.view(REQUESTS).drop("rhum", "pres")).select("request_id", "temp", "rhum", "pres", "lap_number")


@query("prediction_deltas", ctes(*FACT_PARTS, PROFILES, ("req", REQUESTS), VALID, ENRICHED) + f"""SELECT request_id,
  {r("80 + st_speed / 100 - coalesce(circuit_avg, 90)", "delta_circuit")}, {r("80 + st_speed / 100 - coalesce(avg_laptime, 90)", "delta_driver")}
  FROM enriched e LEFT JOIN profiles p ON p.driver_number = e.driver_number""")
def _(s):
    ok, _ = serve.split_requests(s.view(REQUESTS))
    scored = ok.withColumn("prediction", 80 + F.col("st_speed") / 100)
    out = serve.compare_predictions(scored, star_store.serving_tables(s.star), star_store.driver_profiles(s.star))
    return out.select("request_id", "delta_circuit", "delta_driver")


@query("lap_time_text", ctes(LAPS) + """SELECT l_orderkey, l_linenumber, l_partkey,
  concat(CAST(floor(x / 60) AS INT), ':', lpad(CAST(CAST(x - floor(x / 60) * 60 AS DECIMAL(9,3)) AS VARCHAR), 6, '0')) AS lap_text
  FROM (SELECT *, round(lap_duration) + 0.25 AS x FROM laps_v WHERE lap_duration IS NOT NULL) y""")
def _(s):
    seconds = F.round("lap_duration") + 0.25
    return s.laps.where("lap_duration IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", timing.format_lap_time(seconds).alias("lap_text"))


# ---- features -----------------------------------------------------------------------------------

IMPUTED = [("g", f"""SELECT circuit_key, driver_number, {", ".join(f"median({c}) AS m_{c}" for c in K.SPORT_COLS)} FROM facts_v GROUP BY 1, 2"""),
           ("f1", f"""SELECT f.* REPLACE ({", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in K.SPORT_COLS)}) FROM facts_v f LEFT JOIN g
              ON f.circuit_key = g.circuit_key AND f.driver_number = g.driver_number"""),
           ("f2", f"""SELECT f1.* REPLACE ({", ".join(f"coalesce({c}, (SELECT median({c}) FROM f1)) AS {c}" for c in K.SPORT_COLS)},
              {", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in K.WEATHER_COLS)}) FROM f1
              WINDOW w AS (PARTITION BY session_key ORDER BY lap_number, driver_number, {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
           ("f3", f"""SELECT f2.* REPLACE ({", ".join(f"coalesce({c}, (SELECT median({c}) FROM f2)) AS {c}" for c in [*K.WEATHER_COLS, "lap_duration"])}) FROM f2""")]
IMPUTED_COLS = K.SPORT_COLS + K.WEATHER_COLS + ["lap_duration"]
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "session_key"]

@query("impute_groups", ctes(FACTS_V, *IMPUTED) + f"SELECT {cols(ROW)}, {cols(K.SPORT_COLS, r)} FROM f2")
def _(s): return features.impute_groups(s.facts, K.SPORT_COLS).select(*ROW, *K.SPORT_COLS)


@query("impute", ctes(FACTS_V, *IMPUTED) + f"SELECT {cols(ROW)}, {cols(IMPUTED_COLS, r)} FROM f3")
def _(s): return features.impute(s.facts, S.LAP_ORDER).select(*ROW, *IMPUTED_COLS)


def saved(s, name, model):
    """The model as it comes back from storage."""
    path = fresh_path(s.spark, name)
    model.write().save(path)
    return type(model).load(path)


@query("impute_by_stored_model", ctes(FACTS_V, *IMPUTED) + f"SELECT {cols(ROW)}, {cols(IMPUTED_COLS, r)} FROM f3")
def _(s):
    steps = stages.preparation(S.LAP_ORDER).getStages()[:3]
    return saved(s, "imputer", Pipeline(stages=steps).fit(s.facts)).transform(s.facts).select(*ROW, *IMPUTED_COLS)


# Medians of the laps before 2025, kept, next to the medians of all laps.
EARLY = "facts_v WHERE year < 2025"

@query("stored_medians_apart", ctes(FACTS_V, *[(n, f"""SELECT circuit_key, driver_number, {", ".join(f"median({c}) AS {c}" for c in K.SPORT_COLS)} FROM {rows}
  GROUP BY 1, 2""") for n, rows in (("now", "facts_v"), ("kept", EARLY))]) + " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count(*) AS groups,
  count(CASE WHEN k.driver_number IS NOT NULL AND n.{c} IS DISTINCT FROM k.{c} THEN 1 END) AS changed, count(CASE WHEN k.driver_number IS NULL THEN 1 END) AS new
  FROM now n LEFT JOIN kept k ON n.circuit_key = k.circuit_key AND n.driver_number = k.driver_number""" for c in K.SPORT_COLS))
def _(s):
    step = stages.GroupMedians(columns=K.SPORT_COLS)
    return stages.medians_apart(saved(s, "medians", step.fit(s.facts.where("year < 2025"))), step.fit(s.facts), K.SPORT_COLS)


@query("fill_forward", ctes(FACTS_V) + f"""SELECT {cols(ROW)}, {cols(K.WEATHER_COLS, lambda c: r(f"last_value({c} IGNORE NULLS) OVER w"))} FROM facts_v
  WINDOW w AS (PARTITION BY session_key ORDER BY lap_number, driver_number, {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(s):
    order = ["lap_number", "driver_number", *S.LAP_ORDER]
    return ordered.fill_forward(s.facts, ["session_key"], order, K.WEATHER_COLS).select(*ROW, *K.WEATHER_COLS)


MEDIAN_COLS = [K.TARGET, *K.SPORT_COLS, *K.WEATHER_COLS, "lap_number", "year"]

@query("global_medians", ctes(FACTS_V) + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'median({c})', 'median')} FROM facts_v" for c in MEDIAN_COLS))
def _(s):
    found = features.global_medians(s.facts, MEDIAN_COLS)
    return s.spark.createDataFrame(list(found.items()), "feature string, median double")


TRAIN = ("flagged", """SELECT facts_v.*, rank() OVER (PARTITION BY circuit_key ORDER BY md5(concat_ws(':', '42', CAST(meeting_key AS VARCHAR),
  CAST(session_key AS VARCHAR), CAST(driver_number AS VARCHAR), CAST(lap_number AS VARCHAR)))) <=
  quota AS is_train FROM facts_v JOIN (
    SELECT circuit_key AS k, size - test - CASE WHEN row_number() OVER (ORDER BY share - test DESC, circuit_key) <= wanted - sum(test) OVER () THEN 1 ELSE 0 END AS quota FROM (
      SELECT *, floor(share + 1e-9) AS test FROM (SELECT *, wanted * size / total::DOUBLE AS share FROM (
        SELECT circuit_key, count(*) AS size, sum(count(*)) OVER () AS total, ceil(sum(count(*)) OVER () * 0.2::DOUBLE - 1e-9) AS wanted FROM facts_v GROUP BY 1) a) b) c
  ) q ON circuit_key = k""")

@query("stratified_flag", ctes(FACTS_V, TRAIN) + f"SELECT {cols(ROW)}, is_train FROM flagged")
def _(s): return features.stratified_flag(s.facts).select(*ROW, "is_train")


@query("temporal_flag", ctes(FACTS_V) + "SELECT year, year <> 2025 AS is_train, count(*) AS n FROM facts_v GROUP BY 1, 2")
def _(s): return features.temporal_flag(s.facts).groupBy("year", "is_train").agg(F.count(F.lit(1)).alias("n"))


# Odd partkeys train, and one circuit and one driver are never seen in training.
HALF = ("half", "SELECT *, l_partkey % 2 = 1 AND circuit_key <> 3 AND driver_number <> 8 AS is_train FROM facts_v")

def half(s):
    return s.facts.withColumn("is_train", (F.col("l_partkey") % 2 == 1) & (F.col("circuit_key") != 3) & (F.col("driver_number") != 8))


@query("target_encoding", ctes(FACTS_V, HALF) + f"""SELECT {cols(ROW)}, {r("coalesce(c.m, (SELECT avg(lap_duration) FROM half WHERE is_train))", "circuit_avg_laptime")},
  {r("coalesce(y.m, (SELECT avg(lap_duration) FROM half WHERE is_train))", "year_avg_laptime")} FROM half
  LEFT JOIN (SELECT circuit_key AS k, avg(lap_duration) AS m FROM half WHERE is_train GROUP BY 1) c ON c.k = circuit_key
  LEFT JOIN (SELECT year AS k, avg(lap_duration) AS m FROM half WHERE is_train GROUP BY 1) y ON y.k = year""")
def _(s):
    df = half(s)
    return features.TargetEncoder.fit(df, ["circuit_key", "year"]).apply(df).select(*ROW, "circuit_avg_laptime", "year_avg_laptime")


@query("encode_by_stored_model", ORACLES["target_encoding"])
def _(s):
    df = half(s)
    fitted = saved(s, "encoder", stages.MeanEncoding(columns=["circuit_key", "year"]).fit(df))
    return fitted.transform(df.drop("is_train")).select(*ROW, "circuit_avg_laptime", "year_avg_laptime")


@query("derived_features", ctes(FACTS_V, HALF, ("tr", "SELECT * FROM half WHERE is_train"),
       ("ml", "SELECT circuit_key, avg(m) AS a FROM (SELECT circuit_key, session_key, max(lap_number) AS m FROM half GROUP BY 1, 2) x GROUP BY 1")) + f"""
SELECT {cols(ROW)}, {r("(st_speed + i1_speed + i2_speed) / 3", "avg_speed")}, {r("least(lap_number / coalesce(ml.a, 70), 1.0)", "lap_progress")},
  {r("coalesce(p.m, d.m, c.m, o.m) - coalesce(c.m, o.m)", "driver_perf_score")} FROM half
  LEFT JOIN ml ON ml.circuit_key = half.circuit_key CROSS JOIN (SELECT avg(lap_duration) AS m FROM tr) o
  LEFT JOIN (SELECT circuit_key AS k, avg(lap_duration) AS m FROM tr GROUP BY 1) c ON c.k = half.circuit_key
  LEFT JOIN (SELECT driver_number AS k, avg(lap_duration) AS m FROM tr GROUP BY 1) d ON d.k = half.driver_number
  LEFT JOIN (SELECT driver_number AS k, circuit_key AS j, avg(lap_duration) AS m FROM tr GROUP BY 1, 2) p ON p.k = half.driver_number AND p.j = half.circuit_key""")
def _(s):
    df = half(s)
    return features.DerivedFeatures.fit(df).apply(df).select(*ROW, "avg_speed", "lap_progress", "driver_perf_score")


@query("feature_projection", ctes(FACTS_V) + f"""SELECT column_name FROM (SELECT unnest(json_keys(to_json(f))) AS column_name FROM (SELECT * FROM facts_v LIMIT 1) f) x
  WHERE column_name NOT IN ({", ".join(f"'{c}'" for c in K.EXCLUDED_FEATURES)})""")
def _(s):
    kept = s.facts.select(*features.model_columns(s.facts))
    return s.spark.createDataFrame([(c,) for c in kept.columns], "column_name string")


@query("preprocess")
def _(s): return features.preprocess(s.facts, tiebreak=S.LAP_ORDER).select(*ROW, "is_train", *K.MODEL_FEATURES)


# ---- text and geometry --------------------------------------------------------------------------

FOLD = "regexp_replace(strip_accents(lower(trim(text, ' \t\n\r'))), '[^\\x00-\\x7F]', '', 'g')"

@query("normalised_text", f"SELECT doc_id, trim(regexp_replace({FOLD}, '[^a-z0-9]+', ' ', 'g')) AS norm FROM {{documents}}")
def _(s): return s.table("documents").select("doc_id", text.norm_text("text").alias("norm"))


@query("slugs", f"""SELECT doc_id, substr(CASE WHEN x = '' THEN 'unknown' ELSE x END, 1, 64) AS slug FROM (SELECT doc_id,
  regexp_replace(regexp_replace({FOLD}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS x FROM {{documents}}) y""")
def _(s): return s.table("documents").select("doc_id", text.slug("text", 64).alias("slug"))


@query("page_ids", """SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS circuit_id FROM {pages}""")
def _(s):
    # The test pages have no /wiki/ part: put one in front of their own path.
    moved = F.regexp_replace("url", r"^([a-z]+://[^/]+)/", "$1/wiki/")
    return s.table("pages").select("page_id", text.page_id(moved).alias("circuit_id"))


HAVERSINE = """2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) AS d FROM (SELECT *, pow(sin(radians(lat2 - lat1) / 2), 2)
  + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2) AS a FROM"""

@query("haversine", ctes(("st", S.STATIONS)) + f"""SELECT id, {r("d", "distance_km", 4)} FROM (SELECT id, {HAVERSINE} (SELECT id, latitude AS lat1, longitude AS lon1,
  48.85 AS lat2, 2.35 AS lon2 FROM st) p) q) z""", digits=4)
def _(s):
    return s.stations.select("id", geo.haversine_km("latitude", "longitude", F.lit(48.85), F.lit(2.35)).alias("distance_km"))


# ---- matching -----------------------------------------------------------------------------------

# Nations are the timing source's circuits; customers are pages, in the nation's region or none.
MATCH_LEFT = """SELECT CAST(n_nationkey AS BIGINT) AS circuit_key, concat(n_name, ' ring') AS circuit_short_name,
  CASE WHEN n_nationkey = 5 THEN 'Nowhere' ELSE r_name END AS country_name, concat(r_name, ' ', n_nationkey) AS location
  FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""
MATCH_RIGHT = """SELECT concat(n_name, ' ', c_mktsegment, ' ', c_custkey) AS circuit_name, r_name AS country, concat(r_name, ' ', c_custkey % 40) AS locality,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal / 200 END AS latitude, c_acctbal / 100 AS longitude, concat('https://pages.example.org/wiki/C', c_custkey) AS circuit_url
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

@query("match_candidates")
def _(s): return match.match_candidates(s.view(MATCH_LEFT), s.view(MATCH_RIGHT), 5)


# Candidates with known scores: each customer proposes itself to its nation.
CANDIDATES = """SELECT circuit_key, openf1_circuit_short_name, openf1_country_name, openf1_location, candidate_rank, match_score, wikipedia_circuit_name,
  wikipedia_country, wikipedia_locality, wikipedia_circuit_url, wikipedia_latitude, wikipedia_longitude FROM (
  SELECT CAST(c_nationkey AS BIGINT) AS circuit_key, n_name AS openf1_circuit_short_name, n_name AS openf1_country_name, n_name AS openf1_location,
  CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS candidate_rank, c_acctbal AS match_score, c_name AS wikipedia_circuit_name,
  n_name AS wikipedia_country, n_name AS wikipedia_locality, concat('https://pages.example.org/wiki/C', c_custkey) AS wikipedia_circuit_url,
  CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal / 200 END AS wikipedia_latitude, c_acctbal / 100 AS wikipedia_longitude
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey) x"""
OVERRIDES = """SELECT CAST(n_nationkey AS BIGINT) AS circuit_key, 2 AS chosen_candidate_rank FROM {nation} WHERE n_nationkey IN (15, 23)"""
FINAL = ("final", "SELECT c.* FROM cand c LEFT JOIN ov o ON o.circuit_key = c.circuit_key WHERE candidate_rank = coalesce(chosen_candidate_rank, 1)")
FINAL_PARTS = [("cand", CANDIDATES), ("ov", OVERRIDES), FINAL]

def final(s): return match.final_mapping(s.view(CANDIDATES), s.view(OVERRIDES))


@query("final_mapping", ctes(*FINAL_PARTS) + "SELECT circuit_key, candidate_rank, wikipedia_circuit_name, wikipedia_circuit_url FROM final")
def _(s): return final(s).select("circuit_key", "candidate_rank", "wikipedia_circuit_name", "wikipedia_circuit_url")


@query("mapping_without_coordinates", ctes(*FINAL_PARTS) + "SELECT circuit_key FROM final WHERE wikipedia_latitude IS NULL OR wikipedia_longitude IS NULL")
def _(s): return match.without_coordinates(final(s)).select("circuit_key")


PAGES_V = ("pages_v", MATCH_RIGHT)

@query("mapped_pages", ctes(*FINAL_PARTS, PAGES_V) + f"""SELECT circuit_name, country, locality, circuit_url, {r("latitude", "latitude")}, {r("longitude", "longitude")}
  FROM pages_v WHERE circuit_url IN (SELECT wikipedia_circuit_url FROM final)""")
def _(s): return match.mapped_pages(s.view(MATCH_RIGHT), final(s))


@query("mapping_coverage", ctes(*FINAL_PARTS, PAGES_V) + """SELECT (SELECT count(*) FROM final) AS mapping, (SELECT count(*) FROM pages_v p JOIN final ON
  p.circuit_url = wikipedia_circuit_url) AS filtered, true AS complete""")
def _(s): return match.mapping_coverage(s.view(MATCH_RIGHT), final(s))


# ---- stations -----------------------------------------------------------------------------------

# Sparse stations leave some circuits without a hit in the small box.
STATIONS = ("st", S.STATIONS)
CIRCUITS = ("ci", S.CIRCUITS)
NEAR = ("near", """SELECT *, row_number() OVER (PARTITION BY circuit_url ORDER BY distance_km, id) AS station_rank FROM (SELECT circuit_url, id, country,
  latitude, longitude, elevation, 2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) AS distance_km FROM (SELECT c.circuit_url, s.*, c.latitude AS clat, c.longitude AS clon,
  pow(sin(radians(s.latitude - c.latitude) / 2), 2) + cos(radians(c.latitude)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - c.longitude) / 2), 2) AS a,
  abs(s.latitude - c.latitude) <= 5 AND abs(s.longitude - c.longitude) <= 5 AS close,
  max(CASE WHEN abs(s.latitude - c.latitude) <= 5 AND abs(s.longitude - c.longitude) <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY c.circuit_url) AS any_close
  FROM ci c JOIN st s ON abs(s.latitude - c.latitude) <= 15 AND abs(s.longitude - c.longitude) <= 15) x WHERE close OR any_close = 0) y""")

@query("nearest_stations", ctes(STATIONS, CIRCUITS, NEAR) + f"SELECT circuit_url, id, CAST(station_rank AS INTEGER) AS station_rank, {r('distance_km', 'distance_km', 4)} FROM near WHERE station_rank <= 10", digits=4)
def _(s): return stations.nearest_stations(s.circuits, s.stations).select("circuit_url", "id", "station_rank", "distance_km")


NAMES = ("names", S.STATION_NAMES)

@query("station_names", ctes(NAMES) + """SELECT station AS station_id, name AS station_name FROM (SELECT *, row_number() OVER (PARTITION BY station
  ORDER BY (language = 'en') DESC, name) AS rn FROM names) x WHERE rn = 1""")
def _(s): return stations.station_names(s.station_names)


AVAILABLE = "SELECT concat('C', c_custkey) AS station_id, 2023 + c_custkey % 2 AS year FROM {customer} UNION ALL SELECT concat('C', c_custkey), 2025 FROM {customer} WHERE c_custkey % 3 = 0 UNION ALL SELECT concat('C', c_custkey), 2024 FROM {customer} WHERE c_custkey % 6 = 0"
COVER = [("av", AVAILABLE), ("cov", """SELECT n.circuit_url, n.id AS station_id, n.station_rank, round(n.distance_km, 3) AS distance_km,
  coalesce(string_agg(DISTINCT CAST(year AS VARCHAR), '|' ORDER BY CAST(year AS VARCHAR)), '') AS years_ok, 3 - count(DISTINCT year) AS n_missing
  FROM (SELECT * FROM near WHERE station_rank <= 10) n LEFT JOIN av ON av.station_id = n.id GROUP BY 1, 2, 3, 4""")]

def candidates(s):
    return stations.station_candidates(s.circuits, s.stations, s.station_names, s.view(AVAILABLE), [2023, 2024, 2025])


@query("station_candidates", ctes(STATIONS, CIRCUITS, NEAR, *COVER, NAMES, ("nm", """SELECT station, name FROM (SELECT *, row_number() OVER (PARTITION BY station
  ORDER BY (language = 'en') DESC, name) AS rn FROM names) x WHERE rn = 1""")) + """SELECT circuit_url, station_id, CAST(station_rank AS INTEGER) AS station_rank, years_ok,
  CAST(n_missing AS INTEGER) AS n_missing, name AS station_name FROM cov LEFT JOIN nm ON nm.station = station_id""")
def _(s): return candidates(s).select("circuit_url", "station_id", "station_rank", "years_ok", F.size("years_missing").alias("n_missing"), "station_name")


CHOSEN = ("chosen", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY circuit_url ORDER BY n_missing, distance_km, station_rank) AS rn FROM cov) x WHERE rn = 1""")

@query("chosen_stations", ctes(STATIONS, CIRCUITS, NEAR, *COVER, CHOSEN) + """SELECT circuit_url, station_id, CAST(station_rank AS INTEGER) AS station_rank,
  CASE WHEN n_missing = 0 THEN 'nearest_with_full_coverage' ELSE 'best_coverage_then_nearest' END AS selection_rule, years_ok FROM chosen""")
def _(s): return stations.choose_stations(candidates(s)).select("circuit_url", "station_id", "station_rank", "selection_rule", "years_ok")


@query("station_folders", ctes(STATIONS, CIRCUITS, NEAR, *COVER, CHOSEN) + """SELECT station_id, concat(station_id, '__', regexp_replace(lower(country), '[^a-z0-9]+', '-', 'g'), '__',
  regexp_replace(lower(locality), '[^a-z0-9]+', '-', 'g')) AS folder FROM (SELECT c.*, country, locality, row_number() OVER (PARTITION BY station_id
  ORDER BY distance_km, circuit_name) AS r2 FROM chosen c JOIN ci ON ci.circuit_url = c.circuit_url) z WHERE r2 = 1""")
def _(s): return stations.station_folders(stations.choose_stations(candidates(s)))


# ---- drift --------------------------------------------------------------------------------------

SIDED = ("sided", "SELECT *, CASE WHEN ship_day < DATE '2000-01-01' THEN 'reference' ELSE 'current' END AS side FROM facts_v")
KS_COLS = K.DRIFT_FEATURES + ["lap_duration"]

def sided(s):
    return drift.split_by_time(s.facts, "ship_day", "2000-01-01")


KS = [("long", " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, side FROM sided WHERE {c} IS NOT NULL" for c in KS_COLS)),
      ("vc", "SELECT feature, v, count(CASE WHEN side = 'reference' THEN 1 END) AS rn, count(CASE WHEN side = 'current' THEN 1 END) AS cn FROM long GROUP BY 1, 2"),
      ("cum", """SELECT feature, sum(rn) OVER w AS ru, sum(cn) OVER w AS cu, sum(rn) OVER (PARTITION BY feature) AS rt, sum(cn) OVER (PARTITION BY feature) AS ct
        FROM vc WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
      ("ks", "SELECT feature, max(abs(ru / rt::DOUBLE - cu / ct::DOUBLE)) AS d, max(rt)::BIGINT AS n, max(ct)::BIGINT AS m FROM cum GROUP BY 1"),
      ("ksp", """SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101),
        lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * x * x))))) END AS p FROM (SELECT *, d * sqrt(n::DOUBLE * m / (n + m)) AS x FROM ks) y""")]

@query("drift_by_column", ctes(FACTS_V, SIDED, *KS) + f"SELECT feature, {r('d', 'statistic')}, n AS n_reference, m AS n_current, {r('p', 'p_value')}, p < 0.05 AS drifted FROM ksp")
def _(s): return drift.drift_flags(drift.ks_by_column(sided(s)))


@query("drift_summary", ctes(FACTS_V, SIDED, *KS) + f"""SELECT count(*) AS n_columns, count(CASE WHEN p < 0.05 THEN 1 END) AS n_drifted,
  {r("avg(CASE WHEN p < 0.05 THEN 1.0::DOUBLE ELSE 0 END)", "drift_share")}, avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0 END) >= 0.5 AS dataset_drift FROM ksp""")
def _(s): return drift.drift_summary(drift.drift_flags(drift.ks_by_column(sided(s))))


@query("positional_split", ctes(FACTS_V) + f"""SELECT {cols(ROW)}, CASE WHEN row_number() OVER (ORDER BY year, session_key, driver_number, lap_number, {ORDER})
  <= floor(count(*) OVER () * 0.7::DOUBLE) THEN 'reference' ELSE 'current' END AS side FROM facts_v""")
def _(s):
    return drift.split_by_position(s.facts, ["year", "session_key", "driver_number", "lap_number", *S.LAP_ORDER]).select(*ROW, "side")


# A plain function of the speed plays a prediction.
PRED = "(st_speed - 250) * 2"
METRICS = f"""count(*) AS n, {r("avg(abs(e))", "mae")}, {r("sqrt(avg(e * e))", "rmse")}, {r("1 - sum(e * e) / (var_pop(y) * count(*))", "r2")},
  {rounded("100 * avg(abs(e / nullif(y, 0)))", "mape", 4)}, count(CASE WHEN y = 0 THEN 1 END) AS zero_targets, {r("avg(-e)", "mean_error")}, {r("stddev_samp(e)", "error_std")}"""
ERR = ("err", f"SELECT *, lap_duration AS y, lap_duration - {PRED} AS e FROM sided WHERE lap_duration IS NOT NULL AND st_speed IS NOT NULL")

def predicted(s):
    return sided(s).withColumn("prediction", (F.col("st_speed") - 250) * 2)


@query("regression_metrics", ctes(FACTS_V, SIDED, ERR) + f"SELECT {METRICS} FROM err")
def _(s): return drift.regression_metrics(predicted(s)).withColumn("mape", F.round("mape", 4))


@query("performance_by_side", ctes(FACTS_V, SIDED, ERR) + f"SELECT side, {METRICS} FROM err GROUP BY side")
def _(s): return drift.performance_by_side(predicted(s)).withColumn("mape", F.round("mape", 4))


@query("retrain_needed", ctes(FACTS_V, SIDED, ERR, *KS) + f"""SELECT {r("(SELECT avg(abs(e)) FROM err WHERE side = 'current')", "current_mae")},
  (SELECT avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0 END) >= 0.5 FROM ksp) AS dataset_drift, true AS retrain""")
def _(s):
    summary = drift.drift_summary(drift.drift_flags(drift.ks_by_column(sided(s))))
    return drift.retrain_needed(drift.performance_by_side(predicted(s)), summary)


# ---- runs and models ----------------------------------------------------------------------------

# Each supplier plays a training run.
RUNS = """SELECT concat('run', s_suppkey) AS run_id, concat('name', s_suppkey) AS run_name, CASE WHEN s_suppkey % 2 = 0 THEN 'random_forest' ELSE 'boosted_trees' END AS model_family,
  1 + abs(s_acctbal) / 10000 AS test_mae, 0.5 + s_nationkey / 100.0e0 AS test_r2, 10 + s_nationkey / 10.0e0 AS test_rmse, 5.0e0 AS test_mape, 0.9e0 + (s_suppkey % 13) / 40.0e0 AS train_mae,
  0.6e0 AS cv_r2_mean, 1.2e0 AS cv_mae_mean FROM {supplier}"""
RUN_PARTS = [("runs0", RUNS), ("runs_v", "SELECT *, test_mae / train_mae AS overfitting_ratio, abs(cv_r2_mean - test_r2) AS concept_drift_score FROM runs0")]

def all_runs(s): return drift.gap_scores(s.view(RUNS))


@query("gap_scores", ctes(*RUN_PARTS) + f"SELECT run_id, {r('overfitting_ratio', 'overfitting_ratio')}, {r('concept_drift_score', 'concept_drift_score')} FROM runs_v")
def _(s): return all_runs(s).select("run_id", "overfitting_ratio", "concept_drift_score")


@query("best_run_robust", ctes(*RUN_PARTS) + """SELECT run_id, model_family FROM runs_v WHERE model_family = 'random_forest' AND overfitting_ratio < 5
  ORDER BY overfitting_ratio, test_mae, run_id LIMIT 1""")
def _(s): return runs.best_run(all_runs(s), "robust", "random_forest").select("run_id", "model_family")


@query("best_run_mae", ctes(*RUN_PARTS, ("two", "SELECT *, row_number() OVER (ORDER BY test_mae, run_id) AS rn FROM runs_v")) + """
SELECT CASE WHEN b.test_mae - a.test_mae < 0.01 AND b.test_r2 > a.test_r2 THEN b.run_id ELSE a.run_id END AS run_id FROM two a JOIN two b ON a.rn = 1 AND b.rn = 2""")
def _(s): return runs.best_run(all_runs(s), "mae").select("run_id")


@query("recommended_runs", ctes(*RUN_PARTS) + "SELECT run_id FROM runs_v WHERE overfitting_ratio < 5 AND test_mae < 1.5 AND model_family = 'boosted_trees'")
def _(s): return runs.recommended_runs(all_runs(s), "boosted_trees").select("run_id")


@query("run_comparison", ctes(*RUN_PARTS) + f"""SELECT run_name, {r("test_mae", "test_mae")}, {r("test_r2", "test_r2")}, run_id = (SELECT run_id FROM runs_v ORDER BY test_mae, run_id LIMIT 1) AS is_best FROM runs_v""")
def _(s): return runs.comparison(all_runs(s)).select("run_name", "test_mae", "test_r2", "is_best")


@query("fold_summary", ctes(FACTS_V, SIDED, ERR, ("per", f"""SELECT l_partkey % 5 AS fold, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2
  FROM err GROUP BY 1""")) + "SELECT " + ", ".join(r(f"{f}({m})", f"cv_{m}_{n}") for m in ("mae", "rmse", "r2") for n, f in (("mean", "avg"), ("std", "stddev_pop"))) + " FROM per")
def _(s):
    per = drift.regression_metrics(predicted(s).withColumn("fold", F.col("l_partkey") % 5), ["fold"])
    return models.fold_summary(per)


@query("residual_histogram", ctes(FACTS_V, SIDED, ERR, ("edge", "SELECT min(e) AS lo, max(e) AS hi FROM err")) + f"""SELECT CAST(least(floor((e - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin,
  count(*) AS n FROM err, edge GROUP BY 1""")
def _(s):
    res = models.residuals(predicted(s).where("lap_duration IS NOT NULL AND st_speed IS NOT NULL"))
    return models.histogram(res, "residual").select("bin", "n")


def prepared_features(s):
    return features.preprocess(s.facts, tiebreak=S.LAP_ORDER)


@query("random_forest_importance")
def _(s):
    model = models.fit(prepared_features(s).where("is_train"), "random_forest")
    return models.feature_importance(s.spark, model, K.MODEL_FEATURES, 20)


@query("train_run_record")
def _(s): return models.train_run(prepared_features(s), "random_forest").record


@query("boosted_trees_scores")
def _(s):
    df = prepared_features(s)
    model = models.fit(df.where("is_train"), "boosted_trees")
    ok, _ = serve.split_requests(s.view(REQUESTS))
    enriched = serve.enrich_requests(ok, star_store.serving_tables(s.star))
    return models.score(enriched, model).select("request_id", "lap_duration_seconds", "lap_duration_formatted")


@query("grid_search_points")
def _(s):
    return models.grid_search(prepared_features(s).where("is_train"), "random_forest", **K.FIXED["random_forest"])[1].select("point", "mean_mae", "std_mae")


# ---- monitoring ---------------------------------------------------------------------------------

B = S.LATENCY_BOUNDS
MINUTE = ("minute", f"""SELECT event_type, date_trunc('minute', ts) AS m, count(*) AS n, count(CASE WHEN failed THEN 1 END) AS n_failed, sum(value) AS total, count(value) AS n_value,
  {", ".join(f"count(CASE WHEN value <= {b} THEN 1 END) AS le_{i}" for i, b in enumerate(B))} FROM events_v GROUP BY 1, 2""")
WIDE = ("wide", f"""SELECT event_type, m - k * INTERVAL '1' MINUTE AS window_start, m - k * INTERVAL '1' MINUTE + INTERVAL '5' MINUTE AS window_end, sum(n)::BIGINT AS n, sum(n_failed)::BIGINT AS n_failed,
  sum(total) AS total, sum(n_value)::DOUBLE AS n_value, {", ".join(f"sum(le_{i})::DOUBLE AS le_{i}" for i in range(len(B)))}
  FROM minute CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) ks GROUP BY 1, 2, 3""")
_QUANTILE = "CASE " + " ".join(
    f"WHEN le_{i} >= 0.95::DOUBLE * n_value THEN {B[i - 1] if i else 0} + ({b} - {B[i - 1] if i else 0}) * (0.95::DOUBLE * n_value - {f'le_{i - 1}' if i else 0}) / nullif(le_{i} - {f'le_{i - 1}' if i else 0}, 0)"
    for i, b in enumerate(B)) + f" ELSE {B[-1]} END"
SLIDING = f"""SELECT {t("window_start", "window_start")}, {t("window_end", "window_end")}, event_type, n, {r("n / 300.0::DOUBLE", "rate")}, n_failed, {r("n_failed / n::DOUBLE", "error_ratio")},
  {r("n_failed / 300.0::DOUBLE", "error_rate")}, {r("total / n_value", "mean_value")}, {r(_QUANTILE, "quantile")} FROM wide"""

@query("sliding_metrics", ctes(EVENTS, MINUTE, WIDE) + SLIDING)
def _(s): return rules.sliding_metrics(s.events, ["event_type"], B)


@query("label_counters", ctes(EVENTS) + f"""SELECT {t("date_trunc('minute', ts)", "window_start")}, event_type, failed, count(*) AS n FROM events_v GROUP BY 1, 2, 3""")
def _(s): return rules.label_counters(s.events, ["event_type", "failed"])


@query("cumulative_histogram", ctes(EVENTS) + " UNION ALL ".join(
    f"SELECT event_type, {b}::DOUBLE AS le, count(CASE WHEN value <= {b} THEN 1 END) AS n FROM events_v GROUP BY 1" for b in B) + """
  UNION ALL SELECT event_type, 1e9::DOUBLE AS le, count(value) AS n FROM events_v GROUP BY 1""")
def _(s):
    df = rules.cumulative_histogram(s.events, ["event_type"], B)
    return df.withColumn("le", F.when(F.col("le") > 1e9, 1e9).otherwise(F.col("le")))


LAST_VALUES = ctes(EVENTS) + f"""SELECT user_id, {r("arg_max(value, (ts, event_id))", "last_value")}, {t("max(ts)", "last_ts")} FROM events_v GROUP BY 1"""

@query("last_values", LAST_VALUES)
def _(s): return rules.last_values(s.events, ["user_id"])


HELD = [("bad", "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY window_end) AS rn FROM wide WHERE total / n_value > 12"),
        ("isl", "SELECT *, window_end - rn * INTERVAL '1' MINUTE AS island FROM bad"),
        ("held", "SELECT *, min(window_end) OVER (PARTITION BY event_type, island) AS since FROM isl")]

@query("held_condition", ctes(EVENTS, MINUTE, WIDE, *HELD) + f"""SELECT event_type, {t("window_end", "window_end")}, {t("since", "since")},
  window_end - since >= INTERVAL '5' MINUTE AS firing FROM held""")
def _(s):
    samples = rules.rule_samples(rules.sliding_metrics(s.events, ["event_type"], B), "mean_value", ">", 12.0)
    return rules.held(samples, ["event_type"], 5)


def event_stream(s):
    return stream.event_stream(s.spark, s.folder, "events.parquet")


# A drained stream returns every window; those that end after its last watermark come out open.
CLOSED = "window_end <= (SELECT max(ts) FROM events_v) - INTERVAL '10' MINUTE AS closed"


def sliding(events): return rules.sliding_metrics(events, ["event_type"], B)


def window_end(df): return df["window_end"]


@query("stream_sliding_metrics", ctes(EVENTS, MINUTE, WIDE) + SLIDING.replace(" FROM wide", f", {CLOSED} FROM wide"))
def _(s):
    closed = rules.run_available(sliding(event_stream(s)), "sliding")
    return rules.with_open_windows(closed, s.events, sliding, window_end, "5 minutes")


@query("stream_label_counters", ctes(EVENTS) + f"""SELECT {t("m", "window_start")}, event_type, failed, n,
  m + INTERVAL '1' MINUTE <= (SELECT max(ts) FROM events_v) - INTERVAL '10' MINUTE AS closed
  FROM (SELECT date_trunc('minute', ts) AS m, event_type, failed, count(*) AS n FROM events_v GROUP BY 1, 2, 3) x""")
def _(s):
    count = lambda events: rules.label_counters(events, ["event_type", "failed"])
    return rules.with_open_windows(rules.run_available(count(event_stream(s)), "counters"), s.events, count,
                                   lambda df: df["window_start"] + F.expr("INTERVAL '1 minute'"), "1 minute")


@query("stream_held_condition", ctes(EVENTS, MINUTE, WIDE, *HELD) + f"""SELECT event_type, {t("window_end", "window_end")}, {t("since", "since")},
  window_end - since >= INTERVAL '5' MINUTE AS firing, {CLOSED} FROM held""")
def _(s):
    breach = lambda df: rules.rule_samples(df, "mean_value", ">", 12.0)
    windows = rules.sliding_metrics(event_stream(s), ["event_type"], B, time="at")
    finished = rules.run_available(rules.held_stream(breach(windows), ["event_type"], 5, time="at"), "held")
    # Runs that the stream still waits for at its last watermark come from the batch form.
    cut = rules.last_watermark(s.events)
    every = rules.held(breach(sliding(s.events)), ["event_type"], 5)
    last = F.max("window_end").over(W.partitionBy("event_type", "since"))
    waiting = every.withColumn("last", last).where(F.col("last") + F.expr("INTERVAL '90' SECOND") - F.expr("INTERVAL '0.000001' SECOND") > cut).drop("last")
    return finished.unionByName(waiting).withColumn("closed", F.col("window_end") <= cut)


def monitored(s):
    """A monitor in a folder of its own that has taken up all events, in update mode: open windows are in its tables too."""
    monitor = Monitor(event_stream(s), fresh_path(s.spark, "monitor"), ["event_type"], ["user_id"], B)
    monitor.run()
    return monitor


@query("monitor_windows", ctes(EVENTS, MINUTE, WIDE) + SLIDING)
def _(s): return monitored(s).windows()


@query("monitor_gauge", LAST_VALUES)
def _(s): return monitored(s).gauge.rows()


# The published rules, each with its own comparison, limit and hold time, on measures made from events.
RULE_MEASURES = {
    "HighPredictionLatency": ("quantile", "quantile / 20"), "HighPredictionErrorRate": ("error_ratio", "error_ratio"),
    "HighAPIErrorRate": ("error_ratio", "error_ratio / 10"), "SlowDatabaseQueries": ("quantile", "quantile / 10"),
    "ModelNotLoaded": ("n", "CASE WHEN n % 3 = 0 THEN 0.0 ELSE 1.0 END"), "APIDown": ("n", "CASE WHEN n % 2 = 0 THEN 0.0 ELSE 1.0 END"),
    "DatabaseConnectionIssues": ("n", "CASE WHEN n % 5 < 2 THEN 0.0 ELSE 1.0 END"),
}


def rule_sql(name):
    _, comparison, limit, hold = K.ALERT_RULES[name]
    measure = RULE_MEASURES[name][1].replace("quantile", f"({_QUANTILE})").replace("error_ratio", "(n_failed / n::DOUBLE)")
    return f"""SELECT '{name}' AS rule, event_type, {t("window_end", "window_end")}, {t("since", "since")}, window_end - since >= INTERVAL '{hold}' MINUTE AS firing FROM (
      SELECT *, min(window_end) OVER (PARTITION BY event_type, island) AS since FROM (
        SELECT *, window_end - row_number() OVER (PARTITION BY event_type ORDER BY window_end) * INTERVAL '1' MINUTE AS island
        FROM (SELECT *, {measure} AS measured FROM wide) w WHERE measured {comparison} {limit}) x) y"""


@query("alert_rules", ctes(EVENTS, MINUTE, WIDE) + " UNION ALL ".join(rule_sql(n) for n in K.ALERT_RULES))
def _(s):
    metrics = freeze(sliding(s.events))
    return union_named([rules.alerts(metrics.withColumn("measured", F.expr(RULE_MEASURES[n][1])), n, "measured", ["event_type"]) for n in K.ALERT_RULES])


@query("histogram_families", ctes(EVENTS) + " UNION ALL ".join(
    f"SELECT '{family}' AS family, event_type, {b}::DOUBLE AS le, count(CASE WHEN value / 20 <= {b} THEN 1 END) AS n FROM events_v GROUP BY 2"
    for family, bounds in K.HISTOGRAMS.items() for b in [*bounds, 1e9]))
def _(s):
    scaled = s.events.withColumn("value", F.col("value") / 20)
    parts = [rules.cumulative_histogram(scaled, ["event_type"], bounds).withColumn("family", F.lit(f)) for f, bounds in K.HISTOGRAMS.items()]
    return union_named(parts).withColumn("le", F.least("le", F.lit(1e9)))
