"""The weather by station and year, and the stored star: same rows as from the tables, and only the needed parts are read."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lapforge import constants as K, schemas
from lapforge.operators import serve, weather
from lapforge.session import lookup
from lapforge.sources import sinks, star_store, weather_store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def hours(spark, years=(2023, 2024), stations=("007", "8", "x9")):
    made = [(s, f"{y}-03-0{d} {h:02}:00:00", float(d * h)) for s in stations for y in years for d in (1, 2) for h in (0, 15, 23)]
    made += [("007", f"{years[0]}-03-01 15:00:00", 99.0), (None, "2024-03-01 15:00:00", 1.0), ("007", None, 1.0)]
    df = spark.createDataFrame(made, "station_id string, t string, temp double")
    return df.select("station_id", F.to_timestamp("t").alias("weather_hour_utc"), "temp", F.lit(1).cast("double").alias("wspd"), F.lit("x").alias("part"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hours_come_back_once_and_keep_their_station(spark, tmp_path):
    weather_store.write_hours(hours(spark), str(tmp_path / "h"))
    got = weather_store.stored_hours(spark, str(tmp_path / "h"))
    assert {r.station_id for r in got.select("station_id").distinct().collect()} == {"007", "8", "x9"}
    assert got.count() == 36 and got.where("station_id = '007' AND year = 2023 AND temp = 15").count() == 1
    assert got.where("temp = 99 OR rhum IS NOT NULL").count() == 0


def test_a_later_delivery_replaces_only_its_stations_and_years(spark, tmp_path):
    path = str(tmp_path / "h")
    weather_store.write_hours(hours(spark), path)
    more = spark.createDataFrame([("8", "2024-01-01 00:00:00", 5.0), ("8", "2025-01-01 00:00:00", 6.0)], "station_id string, t string, temp double")
    weather_store.write_hours(more.select("station_id", F.to_timestamp("t").alias("weather_hour_utc"), "temp"), path)
    got = weather_store.stored_hours(spark, path)
    assert got.where("station_id = '8' AND year = 2024").count() == 1 and got.where("station_id = '8'").count() == 8 and got.count() == 32


def test_folders_are_pruned_by_the_laps(spark, tmp_path):
    path = str(tmp_path / "h")
    weather_store.write_hours(hours(spark, years=range(2020, 2026)), path)
    wanted = lookup(spark.createDataFrame([("007", 2024), ("x9", 2023)], "station_id string, year int"))
    used = weather_store.hours_in_use(weather_store.stored_hours(spark, path), wanted)
    assert "dynamicpruning" in plan(used)
    assert used.count() == 12
    files = used.select(F.col("station_id"), "year").distinct()
    assert rows(files) == [("007", 2024), ("x9", 2023)]


def test_join_is_the_same_from_either_form(spark, tmp_path):
    path = str(tmp_path / "h")
    weather_store.write_hours(hours(spark), path)
    made = [(c, f"{y}-03-01 15:00:00" if y else None, n) for n, (c, y) in enumerate(itertools.product((1, 2, 3, 4, None), (2022, 2023, 2024, None)))]
    laps = spark.createDataFrame(made, "circuit_key long, t string, n int").select("circuit_key", F.to_timestamp("t").alias("lap_hour_utc"), "n")
    mapping = spark.createDataFrame([(1, "u1", "007"), (2, "u2", "8"), (3, "u3", "none")], "circuit_key long, wikipedia_circuit_url string, station_id string")
    plain, stored = (weather.attach_weather(laps, mapping, h) for h in (hours(spark).drop("part"), weather_store.stored_hours(spark, path)))
    columns = ["n", "station_id", *K.WEATHER_COLS]
    assert rows(plain.select(columns)) == rows(stored.select(columns)) and stored.where("temp = 15").count() == 4
    failed = [rows(weather.failed_sessions(laps.withColumn("session_key", F.col("n")), mapping, h)) for h in (hours(spark), weather_store.stored_hours(spark, path))]
    assert failed[0] == failed[1]


# ---- star ---------------------------------------------------------------------------------------

def facts(spark, seed=1, n=3000):
    r = random.Random(seed)
    made = {}
    for _ in range(n):
        session = r.randrange(1, 40)
        key = (session // 3, session, r.randrange(1, 12), r.randrange(1, 60))
        made[key] = (*key, 2022 + session % 3, session % 7, r.randrange(60_000, 99_000) / 1000, r.randrange(300))
    df = spark.createDataFrame(list(made.values()), "meeting_key int, session_key int, driver_number int, lap_number int, year int, circuit_key int, lap_duration double, st_speed int")
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.FACT_LAPS.fields])


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("star"))
    dims = {n: spark.createDataFrame([], schemas.STAR[n]) for n in schemas.STAR if n != "fact_laps"}
    star_store.write({"fact_laps": facts(spark), **dims}, folder)
    return star_store.StoredStar(spark, folder)


def same(got, want):
    return [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


FILTERS = [{}, {"year": 2023}, {"circuit_key": 3}, {"driver_number": 4}, {"session_key": 7}, {"year": 2022, "driver_number": 5}, {"year": 1999}]


@pytest.mark.parametrize("given", FILTERS)
def test_pages_are_those_of_the_facts(spark, star, given):
    plain = star.facts
    for page, size in ((1, 10), (3, 37), (2, 1000), (60, 20), (500, 10)):
        assert same(star_store.laps_page(star, page, size, **given), serve.laps_page(plain, page, size, **given).data)
    assert same(star_store.page_info(star, 2, 10, **given), serve.page_info(plain, 2, 10, **given))
    assert rows(star_store.filter_laps(star, **given)) == rows(serve.filter_laps(plain, **given))
    for last in (None, (7, 3, 30), (38, 11, 59), (99, 1, 1)):
        assert same(star_store.laps_after(star, last, 25, **given), serve.laps_after(plain, last, 25, **given))


def test_laps_of_a_driver_and_of_a_circuit(spark, star):
    for driver, year, limit in ((4, None, 100), (4, 2023, 30), (4, None, 1), (5, None, 1000), (99, None, 10)):
        assert same(star_store.driver_laps(star, driver, year, limit), serve.driver_laps(star.facts, driver, year, limit))
    assert same(star_store.circuit_laps(star, 3, 2023), serve.circuit_laps(star.facts, 3, 2023))
    assert same(star_store.circuit_laps(star, 3), serve.circuit_laps(star.facts, 3))
    with pytest.raises(ValueError):
        star_store.laps_page(star, 0)


def test_statistics_from_totals(spark, star):
    f = star.facts

    def close(got, want):
        a, b = ({tuple(r)[:-1]: r[-1] for r in x.select(sorted(x.columns, key=lambda c: c not in ("driver_number", "circuit_key"))).collect()} for x in (got, want))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)

    close(star_store.circuit_averages(star), serve.circuit_averages(f))
    close(star_store.driver_circuit_averages(star), serve.driver_circuit_averages(f))
    close(star_store.performance_scores(star), serve.performance_scores(f))
    for rounded in (True, False):
        close(star_store.typical_max_laps(star, rounded), serve.typical_max_laps(f, rounded))
    assert rows(star_store.driver_profiles(star)) == rows(serve.driver_profiles(f))
    assert star_store.dataset_stats(star).first()["total_laps"] == f.count()


def test_only_the_needed_parts_are_read(spark, star):
    def scan(df):
        return next(line for line in plan(df).splitlines() if "FileScan" in line)

    one = star_store.circuit_laps(star, 3, 2023)
    assert "Window" not in plan(one) and "(year#" in scan(one).split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "EqualTo(circuit_key,3)" in scan(one)
    latest = scan(star_store.driver_laps(star, 4, limit=5))
    assert "session_key" in latest.split("PushedFilters")[1].split("ReadSchema")[0] and "year#" in latest.split("PartitionFilters")[1].split("PushedFilters")[0]
    session = scan(star_store.filter_laps(star, session_key=7))
    assert "EqualTo(circuit_key,0)" in session or "circuit_key" in session.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "lap_duration" not in scan(star_store.page_info(star, 1, 10, year=2023))  # counts need no laps


def test_an_append_renews_the_totals(spark, tmp_path):
    dims = {n: spark.createDataFrame([], schemas.STAR[n]) for n in schemas.STAR if n != "fact_laps"}
    all_ = facts(spark, 2, 400)
    star_store.write({"fact_laps": all_.where("year < 2024"), **dims}, str(tmp_path))
    star_store.write({"fact_laps": all_.where("year = 2024"), **dims}, str(tmp_path), "append")
    star = star_store.StoredStar(spark, str(tmp_path))
    assert star.totals.agg(F.sum("laps")).first()[0] == star.facts.count() == all_.count()


def test_empty_star(spark, tmp_path):
    tables = {n: spark.createDataFrame([], schemas.STAR[n]) for n in schemas.STAR}
    star_store.write(tables, str(tmp_path))
    star = star_store.StoredStar(spark, str(tmp_path))
    assert star_store.laps_page(star).count() == star_store.driver_laps(star, 1).count() == star_store.circuit_averages(star).count() == 0
    assert star_store.page_info(star).first()["total"] == 0 and sinks.missing_tables(spark, ["no_such_table"]) == ["no_such_table"]


def test_facts_meet_and_are_ranged_in_one_shuffle(spark):
    """Sessions of one place, of two, without a key, and a hot one: the same rows as by the plain way, and nothing is sorted before the shuffle."""
    from lapforge.operators import star as loader

    def row(session, driver, lap, year, circuit, at, seconds):
        return (session, session, driver, lap, year, circuit, at, seconds)

    laps = [row(s, d, n, 2023 + s % 3, s % 4, at, 80.0 + at) for s in range(1, 7) for d in (1, 2) for n in (1, 2, None) for at in (2, 1)]
    laps += [row(7, 1, 1, 2023, 1, 2, 90.0), row(7, 1, 1, 2024, 2, 1, 91.0), row(7, 1, 2, 2023, 1, 1, 92.0), row(None, 1, 1, 2023, 1, 1, 93.0),
             row(None, 1, 1, 2023, 1, 0, None), row(8, 3, 1, 2023, 1, 1, 1e12)] + [row(9, 1, 1, 2025, 3, at, 70.0 + at) for at in range(50)]
    df = spark.createDataFrame(laps, "meeting_key long, session_key long, driver_number long, lap_number long, year long, circuit_key long, l_orderkey long, lap_duration double")
    plain = loader.load_table(df, "fact_laps", order_by=["l_orderkey"]).where("lap_duration IS NOT NULL")
    assert plain.count() == 6 * 2 * 3 + 2 + 1
    for hot_rows in (1, 20, 1000):
        made = loader.fact_laps(df, ["l_orderkey"], hot_rows)
        assert sorted(map(str, made.collect())) == sorted(map(str, plain.collect()))
    plan = loader.fact_laps(df.where("session_key < 7"), ["l_orderkey"])._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan
    assert "Sort" not in plan[plan.index("Exchange "):]
