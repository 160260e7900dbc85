"""Landed files in, written tables out."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from lapforge import schemas
from lapforge.functions.html import read_page
from lapforge.operators import star
from lapforge.sources import landing, pages, sinks


def test_session_files(spark, tmp_path):
    head = "meeting_key,session_key,driver_number,lap_number,lap_duration,date_start,is_pit_out_lap"
    names = schemas.LAP_RECORDS.fieldNames()
    for key, lap in ((9001, "90.5"), (9002, "bad")):
        values = {"meeting_key": "1", "driver_number": "4", "lap_number": "2", "lap_duration": lap}
        (tmp_path / f"laps_session_{key}.csv").write_text(",".join(names) + "\n" + ",".join(values.get(n, "") for n in names) + "\n")
    (tmp_path / "laps_session_x.csv").write_text(head + "\n")
    (tmp_path / "report.csv").write_text("a\n1\n")
    df = landing.read_session_files(spark, str(tmp_path))
    typed = {r["session_key"]: r for r in landing.type_laps(df).collect()}
    assert typed.keys() == {9001, 9002}
    assert typed[9001]["lap_duration"] == 90.5 and typed[9002]["lap_duration"] is None
    assert typed[9001]["__source_file"] == "laps_session_9001.csv"
    assert landing.read_session_files(spark, str(tmp_path), sessions=1).select("session_key").first()[0] == 9001


def test_lap_records_take_defaults_from_the_scope(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([
        {"session_key": 1, "driver_number": 44, "lap_number": 1, "lap_duration": 91.2, "is_pit_out_lap": None, "date_start": "2024-03-02T15:40:00.123000+00:00"},
        {"session_key": 1, "driver_number": 44, "lap_number": 2, "lap_duration": "x", "is_pit_out_lap": True, "meeting_key": 5}]))
    scope = spark.createDataFrame([(1, 10, 2024), (2, 11, 2024)], "session_key long, meeting_key long, year long")
    got = {r["lap_number"]: r for r in landing.lap_records(spark, str(tmp_path / "a.json"), scope).collect()}
    assert (got[1]["meeting_key"], got[2]["meeting_key"], got[1]["year"]) == (10, 5, 2024)
    assert got[2]["lap_duration"] is None and got[2]["is_pit_out_lap"] and got[1]["date_start"].hour == 15
    laps = landing.lap_records(spark, str(tmp_path / "a.json"), scope)
    assert [r[0] for r in landing.sessions_without_laps(laps, scope).collect()] == [2]


def test_station_hours_from_gzip_folders(spark, tmp_path):
    folder = tmp_path / "07149__france__orly"
    folder.mkdir()
    cols = schemas.WEATHER_RECORDS.fieldNames()
    lines = [",".join(cols), "2024,2,29,7,5.5,,,,,,", "2024,2,30,7,5.5,,,,,,", "2024,1,1,x,1,,,,,,"]
    with gzip.open(folder / "2024.csv.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    got = landing.station_hours(spark, str(tmp_path / "*")).collect()
    assert [(r["station_id"], r["weather_hour_utc"], r["temp"]) for r in got] == [("07149", dt.datetime(2024, 2, 29, 7), 5.5)]


def test_missing_year_is_an_error(spark):
    df = spark.createDataFrame([(2024, 1)], "year long, session_key long")
    assert landing.sessions_for_years(df, [2024]).count() == 1
    with pytest.raises(landing.NoData):
        landing.sessions_for_years(df, [2023, 2024])
    status = {r["year"]: (r["rows"], r["status"]) for r in landing.year_availability(df, [2022, 2024]).collect()}
    assert status == {2022: (0, "EMPTY"), 2024: (1, "OK")}


PAGE = """<table class="wikitable"><tr><th>Team</th></tr></table>
<table class="sortable wikitable"><tbody><tr><th>Circuit</th><th>Map</th><th>Type</th><th>Dir</th><th>Location</th><th>Country</th></tr>
<tr><td><a href="/wiki/M%C3%B3naco">Mónaco <b>GP</b></a></td><td></td><td></td><td></td><td><a>Monte</a><a>Carlo</a></td><td><a><img></a><a>Monaco</a></td></tr>
<tr><td>no link</td><td></td><td></td><td></td><td></td><td></td></tr><tr><td>short</td></tr></tbody></table>
<span class="geo x">43.7347; <b>7.4206</b></span><span class="geo">1; 2</span>"""


def test_page_reader():
    rows, lat, lon = read_page(PAGE, "https://x.org")
    assert rows == [{"circuit_name": "MónacoGP", "circuit_url": "https://x.org/wiki/M%C3%B3naco", "locality": "Monte", "country": "Monaco"}]
    assert (lat, lon) == (43.7347, 7.4206)
    assert read_page("<table class='wikitable'><tr><th>Country</th></tr></table>", "") == ([], None, None)
    assert read_page("<span class='geo'>a; b</span>", "")[1:] == (None, None)
    assert read_page(None, "") == ([], None, None)


def test_page_circuits(spark):
    df = spark.createDataFrame([(1, "https://x.org/list", PAGE.split("<span")[0]), (2, "https://x.org/wiki/M%C3%B3naco", "<span class='geo'>43.5;7.5</span>")],
                               "page_id long, url string, html string")
    row = pages.page_circuits(df, "https://x.org", "now").first()
    assert (row["latitude"], row["longitude"], row["scraped_at_utc"]) == (43.5, 7.5, "now")


def test_incremental_sessions(spark, tmp_path):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([(1, 10.0), (2, 20.0)], "session_key long, x double")
    sinks.write_sessions(first, path)
    sinks.write_sessions(spark.createDataFrame([(2, 99.0), (3, 30.0)], "session_key long, x double"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("session_key", "x").collect()) == [(1, 10.0), (2, 20.0), (3, 30.0)]
    sinks.write_sessions(spark.createDataFrame([(2, 99.0)], "session_key long, x double"), path, overwrite=True)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("session_key", "x").collect()) == [(1, 10.0), (2, 99.0), (3, 30.0)]


def test_star_round_trip(spark, shapes, tmp_path):
    from lapforge.plans import pipeline
    from lapforge.plans.catalog_pipeline import inputs
    given = inputs(shapes)
    result = pipeline.run(given, frozen=True)
    tables = result.star(given)
    sinks.write_star(tables, str(tmp_path))
    assert set(landing.register_star(spark, str(tmp_path))) == set(schemas.STAR)
    assert sinks.missing_tables(spark, list(schemas.STAR) + ["fact_nothing"]) == ["fact_nothing"]
    loaded = spark.table("fact_laps")
    assert loaded.count() == tables["fact_laps"].count() > 0
    pruned = loaded.where("year = 2024").select("lap_duration")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in pruned and "ReadSchema: struct<lap_duration" in pruned
    bad = {r["constraint_name"]: r["violations"] for r in star.constraint_violations(
        {n: spark.table(n) for n in schemas.STAR}).collect()}
    assert all(v == 0 for k, v in bad.items() if "->" not in k), bad
    reports = sinks.manifest(result.reports["weather"], strict=False)
    assert reports["n_ko"] > 0 and reports["n_ok"] + reports["n_ko"] == reports["n_sessions"]
    sinks.write_manifest(spark, str(tmp_path / "manifest"), reports)
    assert json.loads(spark.read.text(str(tmp_path / "manifest")).first()[0])["n_ok"] == reports["n_ok"]


def test_strict_run_drops_failed_sessions(shapes):
    from lapforge.plans import pipeline
    from lapforge.plans.catalog_pipeline import inputs
    given = inputs(shapes)
    strict = pipeline.run(given, strict=True)
    failed = {r["session_key"] for r in strict.reports["weather"].where("NOT ok").collect()}
    kept = {r["session_key"] for r in strict.dataset.select("session_key").distinct().collect()}
    assert failed and not failed & kept


def test_retention(spark):
    rows = [("raw", 730), ("raw", 731), ("log", 90), ("log", 91), ("other", 9999)]
    df = spark.createDataFrame(rows, "category string, days int").withColumn("at", F.expr("timestampadd(DAY, -days, timestamp'2025-01-01 12:00:00')"))
    kept = sinks.retained(df, "category", "at", "2025-01-01 12:00:00")
    assert sorted(tuple(r) for r in kept.select("category", "days").collect()) == [("log", 90), ("other", 9999), ("raw", 730)]
