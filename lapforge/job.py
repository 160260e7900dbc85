"""Batch jobs: python -m lapforge.job {match,run,train,score,drift,purge,monitor} --help. Submit with spark-submit on a cluster.

match  circuit pages, sessions and a station catalogue -> circuit_urls and circuit_stations, as `run` reads them
run    landed files -> scope, dataset, star schema, reports, checks
train  dataset -> features, models, runs table, importances
score  requests -> predictions of the best stored model, with the rejected requests and their reasons
drift  dataset -> drift per column and summary; with --run also the model's errors on both sides and the retrain decision
purge  a table by category and month -> the same table without the rows past their retention, and what was deleted
monitor  events that arrived since the last run -> minutes and gauges kept up to date, and the alerts that follow from them
"""

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapforge import constants as K, schemas
from lapforge.operators import drift, features, match, models, quality, runs, scope, serve, stages, stations
from lapforge.operators.clean import CleanRules
from lapforge.operators.dataset import SORT_COLS
from lapforge.operators.quality import all_passed
from lapforge.operators.shape import limit_sessions, union_named
from lapforge.plans import pipeline
from lapforge.session import build_session, release, store
from lapforge.sources import landing, pages, retention, sinks, star_store, stream, weather_store
from lapforge.streaming.monitor import Monitor

YEARS = [2023, 2024, 2025]
PLACE = ["year", "meeting_key", "session_key", "driver_number", "lap_number"]


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


def weather_hours(spark: SparkSession, landing_folder: str, path: str, force: bool = False) -> DataFrame:
    """The landed weather as stored hours: files are parsed once, later runs read the folders they need."""
    if force or not exists(spark, path):
        weather_store.write_hours(landing.station_hours(spark, f"{landing_folder}/weather/*"), path)
    return weather_store.stored_hours(spark, path)


def landed(spark: SparkSession, folder: str, fmt: str, years: list[int], hours: DataFrame, limit: int = 0) -> pipeline.Inputs:
    """Inputs as the landing step leaves them under one folder, with the stored hours."""
    sessions = landing.sessions_for_years(landing.session_records(spark, f"{folder}/sessions"), years)
    raw = landing.read_session_files(spark, f"{folder}/laps", fmt) if fmt != "json" else \
        spark.read.schema(schemas.LAP_RECORDS).option("multiLine", True).json(f"{folder}/laps")
    laps = limit_sessions(landing.type_laps(raw, sessions), limit)
    urls = spark.read.option("header", True).csv(f"{folder}/circuit_urls")
    stations = spark.read.option("header", True).csv(f"{folder}/circuit_stations")
    return pipeline.Inputs(sessions, laps, landing.driver_records(spark, f"{folder}/drivers", sessions), urls, stations, hours)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    dataset_path, star_path = f"{a.out}/dataset", f"{a.out}/star"
    if not a.verify_only and (a.force or not exists(spark, dataset_path)):
        rules = CleanRules(not a.no_quantiles, a.q_low, a.q_high, min_lap_s=a.min_lap_s, max_lap_s=a.max_lap_s)
        hours = weather_hours(spark, a.landing, f"{a.out}/weather_hours", a.force)
        given = landed(spark, a.landing, a.format, a.years, hours, a.limit_sessions)
        result = pipeline.run(given, a.years, a.session_type, rules, a.strict, frozen=True)
        sinks.write_step(result.dataset.orderBy(*SORT_COLS), dataset_path, partition_by=["year"])
        sinks.write_step(result.summary, f"{a.out}/summary")
        sinks.write_step(result.scope, f"{a.out}/scope")
        sinks.write_step(given.drivers, f"{a.out}/drivers")
        for name, report in result.reports.items():
            sinks.write_step(report, f"{a.out}/report_{name}")
            sinks.write_manifest(spark, f"{a.out}/manifest_{name}", sinks.manifest(
                spark.read.parquet(f"{a.out}/report_{name}"), step=name, **{k: v for k, v in vars(a).items() if k != "job"}))
    read = lambda name: spark.read.parquet(f"{a.out}/{name}")
    if not a.verify_only and not a.skip_load and (a.force or not exists(spark, f"{star_path}/fact_laps")):
        stored = pipeline.Result(read("scope"), read("dataset"), read("summary"), {})
        tables = pipeline.load_star(stored.dataset, stored.scope, pipeline.latest_drivers(read("drivers")))
        star_store.write(tables, star_path, "append" if a.append else "overwrite", placed=True)
    if a.skip_load:
        return 0
    landing.register_star(spark, star_path)
    tables = {n: spark.table(n) for n in schemas.STAR}
    checks = pipeline.pipeline_checks(read("summary"), pipeline.table_counts(tables))
    checks.show(100, False)
    sinks.write_step(pipeline.verify(tables), f"{a.out}/constraint_violations")
    sinks.write_step(quality.dataset_checks(read("dataset"), SORT_COLS), f"{a.out}/quality")
    spark.read.parquet(f"{a.out}/quality").show(100, False)
    found = spark.read.parquet(f"{a.out}/constraint_violations")
    found.show(100, False)
    # Values out of the expected ranges are reported; broken keys and references end the job with an error.
    broken = found.where("violations > 0 AND (constraint_name LIKE '%primary key' OR constraint_name LIKE '%->%')")
    return 0 if all_passed(checks) and broken.limit(1).count() == 0 else 2


def match_pages(spark: SparkSession, a: argparse.Namespace) -> int:
    """Circuits of the pages, their mapping to the timing source, and a weather station for each."""
    listed = pages.page_circuits(spark.read.parquet(a.pages), a.base_url)
    sinks.write_step(listed, f"{a.out}/page_circuits")
    listed = spark.read.parquet(f"{a.out}/page_circuits")
    used = scope.circuits_in_use(landing.session_records(spark, f"{a.landing}/sessions"), a.years)
    sinks.write_step(match.match_candidates(used, listed, a.top_n), f"{a.out}/match_candidates")
    candidates = spark.read.parquet(f"{a.out}/match_candidates")
    chosen = match.final_mapping(candidates, landing.overrides(spark, a.overrides) if a.overrides else None, a.strict)
    sinks.write_step(chosen, f"{a.out}/circuit_mapping")
    mapping = spark.read.parquet(f"{a.out}/circuit_mapping")
    sinks.write_step(match.without_coordinates(mapping), f"{a.out}/circuits_without_coordinates")
    mapped = match.mapped_pages(listed, mapping).dropDuplicates(["circuit_url"])
    catalogue, names = landing.station_catalogue(spark, a.stations, a.station_names)
    hours = landing.station_hours(spark, f"{a.landing}/weather/*")
    have = hours.select("station_id", F.year("weather_hour_utc").alias("year")).distinct()
    near = stations.choose_stations(stations.station_candidates(mapped, catalogue, names, have, a.years, a.top_n))
    sinks.write_step(near, f"{a.out}/station_choice")
    near = spark.read.parquet(f"{a.out}/station_choice")
    sinks.write_step(stations.station_folders(near), f"{a.out}/station_folders")
    for table, name in ((mapping.select("circuit_key", "wikipedia_circuit_url"), "circuit_urls"), (near.select("circuit_url", "station_id"), "circuit_stations")):
        sinks.write_step(table, f"{a.landing}/{name}", "csv")
    return 0


def score(spark: SparkSession, a: argparse.Namespace) -> int:
    best = runs.best_run(spark.read.parquet(f"{a.out}/runs"), a.strategy, a.family).first()
    if best is None:
        raise landing.NoData("no trained run to score with")
    requests = spark.read.parquet(a.requests) if a.format == "parquet" else spark.read.json(a.requests)
    valid, rejected = serve.split_requests(serve.with_simple_defaults(requests) if a.simple else requests)
    facts = spark.read.parquet(f"{a.out}/star/fact_laps")
    prepared, learner = stages.split_model(models.load(best["model_path"]))
    tables = (None if a.features == "star" else stages.stored_serving_tables(prepared)) or serve.serving_tables(facts)
    scored = models.score(serve.enrich_requests(valid, tables), learner)
    sinks.write_step(serve.compare_predictions(scored, tables, serve.driver_profiles(facts)), f"{a.out}/predictions")
    sinks.write_step(rejected, f"{a.out}/rejected_requests")
    return 0


def train(spark: SparkSession, a: argparse.Namespace) -> int:
    dataset = spark.read.parquet(f"{a.out}/dataset")
    flagged = store(features.stratified_flag(dataset) if a.split == "stratified" else features.temporal_flag(dataset))
    prepared = stages.preparation().fit(flagged)
    # each family and the search read this copy, so the laps are put in order once
    data = store(prepared.transform(flagged))
    records: list[DataFrame] = []
    for family in a.families:
        for tuned in ([False, True] if a.tuned else [False]):
            trained = models.train_run(data, family, tuned=tuned)
            run_id = trained.record.first()["run_id"]
            # A folder per run: training again never replaces the model that a record names.
            models.save(stages.with_model(prepared, trained.model), f"{a.out}/models/{run_id}")
            sinks.write_step(trained.importance, f"{a.out}/importance/{run_id}")
            records.append(trained.record.withColumn("model_path", F.lit(f"{a.out}/models/{run_id}")))
    sinks.write_step(union_named(records), f"{a.out}/runs", mode="append")
    table = spark.read.parquet(f"{a.out}/runs")
    runs.comparison(table).show(100, False)
    runs.best_run(table, a.strategy).show(1, False)
    return 0


def watch(spark: SparkSession, a: argparse.Namespace) -> int:
    data = spark.read.parquet(f"{a.out}/dataset")
    sided = drift.split_by_time(data, "date_start_session", a.since) if a.since else drift.split_by_position(data, PLACE, a.share)
    flags = drift.drift_flags(drift.ks_by_column(sided), a.alpha)
    sinks.write_step(flags, f"{a.out}/drift")
    spark.read.parquet(f"{a.out}/drift").orderBy("feature").show(100, False)
    summary = drift.drift_summary(spark.read.parquet(f"{a.out}/drift"))
    summary.show()
    if a.run:
        path = spark.read.parquet(f"{a.out}/runs").where(F.col("run_id") == a.run).first()["model_path"]
        # the steps were fitted with the model: nothing is learned from the rows under watch
        scored = models.load(path).transform(sided)
        sinks.write_step(drift.performance_by_side(scored), f"{a.out}/performance_by_side")
        decision = drift.retrain_needed(spark.read.parquet(f"{a.out}/performance_by_side"), summary)
        sinks.write_step(decision, f"{a.out}/retrain")
        spark.read.parquet(f"{a.out}/retrain").show(1, False)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = p.add_subparsers(dest="job", required=True)
    r = jobs.add_parser("run")
    r.add_argument("--landing", required=True)
    r.add_argument("--format", choices=["csv", "parquet", "json"], default="csv")
    r.add_argument("--years", type=int, nargs="+", default=YEARS)
    r.add_argument("--session-type", default="Race")
    r.add_argument("--no-quantiles", action="store_true")
    r.add_argument("--q-low", type=float, default=0.01)
    r.add_argument("--q-high", type=float, default=0.99)
    r.add_argument("--min-lap-s", type=float)
    r.add_argument("--max-lap-s", type=float)
    r.add_argument("--limit-sessions", type=int, default=0)
    for flag in ("--strict", "--force", "--skip-load", "--append", "--verify-only"):
        r.add_argument(flag, action="store_true")
    t = jobs.add_parser("train")
    t.add_argument("--split", choices=["stratified", "temporal"], default="stratified")
    t.add_argument("--families", nargs="+", default=["random_forest", "boosted_trees"])
    t.add_argument("--tuned", action="store_true")
    t.add_argument("--strategy", choices=["robust", "mae"], default="robust")
    m = jobs.add_parser("match")
    m.add_argument("--landing", required=True)
    m.add_argument("--pages", required=True, help="Parquet table page_id, url, html")
    m.add_argument("--base-url", default="https://en.wikipedia.org")
    m.add_argument("--stations", required=True)
    m.add_argument("--station-names", required=True)
    m.add_argument("--overrides")
    m.add_argument("--years", type=int, nargs="+", default=YEARS)
    m.add_argument("--top-n", type=int, default=5)
    m.add_argument("--strict", action="store_true", help="circuits without coordinates are an error")
    s = jobs.add_parser("score")
    s.add_argument("--requests", required=True)
    s.add_argument("--format", choices=["json", "parquet"], default="json", help="json is one request per line")
    s.add_argument("--simple", action="store_true", help="short requests: weather and lap number get defaults")
    s.add_argument("--features", choices=["stored", "star"], default="stored", help="means and lap counts of the training rows, or of all facts")
    s.add_argument("--strategy", choices=["robust", "mae"], default="robust")
    s.add_argument("--family", choices=["random_forest", "boosted_trees"])
    d = jobs.add_parser("drift")
    d.add_argument("--run", help="run id of a trained model to compare on both sides")
    d.add_argument("--since", help="first date of the current part; without it the split is by position")
    d.add_argument("--share", type=float, default=0.7)
    d.add_argument("--alpha", type=float, default=0.05)
    g = jobs.add_parser("purge")
    g.add_argument("--table", required=True, help="folder category=<c>/month=<yyyy-MM>/ of Parquet files")
    g.add_argument("--stamp", default="ts", help="column with the age of a row")
    g.add_argument("--now", required=True, help="moment from which ages are counted")
    w = jobs.add_parser("monitor")
    w.add_argument("--events", required=True, help="folder in which Parquet files of events arrive")
    w.add_argument("--labels", nargs="+", default=["event_type"])
    w.add_argument("--gauge-keys", nargs="+", default=["user_id"])
    w.add_argument("--rule", choices=list(K.ALERT_RULES), help="rule whose alerts are written")
    w.add_argument("--measure", default="error_ratio", help="column of the windows that plays the rule's measure")
    w.add_argument("--partitions", type=int, help="state partitions; the first run fixes them")
    for q in (r, t, d, m, s, g, w):
        q.add_argument("--out", required=True)
    return p


def purge(spark: SparkSession, a: argparse.Namespace) -> int:
    done = retention.purge(spark, a.table, spark.read.parquet(a.table).schema, a.stamp, a.now)
    sinks.write_step(done, f"{a.out}/purged", mode="append")
    return 0


def monitor(spark: SparkSession, a: argparse.Namespace) -> int:
    kept = Monitor(stream.event_stream(spark, a.events), f"{a.out}/monitor", a.labels, a.gauge_keys, K.LATENCY_BUCKETS)
    kept.run(a.partitions)
    sinks.write_step(kept.windows(), f"{a.out}/windows")
    if a.rule:
        sinks.write_step(kept.alerts(a.rule, a.measure), f"{a.out}/alerts")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    job = {"match": match_pages, "run": run, "train": train, "score": score, "drift": watch, "purge": purge, "monitor": monitor}[args.job]
    if spark is not None:
        return job(spark, args)
    spark = build_session(f"lapforge-{args.job}")
    try:
        return job(spark, args)
    finally:
        release(spark)


if __name__ == "__main__":
    sys.exit(main())
