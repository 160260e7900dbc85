"""Edge rows of cleaning, context, weather and dataset steps."""

import datetime as dt

import pytest

from lapforge.operators import clean, context, dataset, scope, shape, star, weather
from lapforge.operators.clean import CleanRules

UTC = dt.timezone.utc
LAPS = "session_key long, driver_number long, lap_number long, lap_duration double, is_pit_out_lap boolean"


def laps(spark, durations, session=1, pit=None):
    return spark.createDataFrame([(session, 1, i + 1, d, pit) for i, d in enumerate(durations)], LAPS)


def test_unknown_pit_flag_keeps_the_lap(spark):
    df = laps(spark, [90.0], pit=None).union(laps(spark, [91.0], pit=True)).union(laps(spark, [92.0], pit=False))
    kept, report = clean.clean_laps(df, CleanRules(use_quantiles=False))
    assert sorted(r["lap_duration"] for r in kept.collect()) == [90.0, 92.0]
    assert report.first()["removed_pit_out"] == 1


@pytest.mark.parametrize("n,removed", [(19, 0), (20, 2)])
def test_quantiles_need_twenty_laps(spark, n, removed):
    df = laps(spark, [80.0 + i for i in range(n)] + [None, 0.0, -1.0])
    _, report = clean.clean_laps(df)
    row = report.first()
    assert (row["removed_outliers"], row["removed_null_target"], row["removed_nonpositive_target"]) == (removed, 1, 2)
    assert (row["low_threshold"] is None) == (n < 20)


def test_equal_durations_have_no_bounds(spark):
    kept, _ = clean.clean_laps(laps(spark, [90.0] * 30))
    assert kept.count() == 30


def test_quantiles_look_only_at_surviving_laps(spark):
    df = laps(spark, [float(i) for i in range(80, 100)]).union(laps(spark, [1000.0] * 5, pit=True))
    row = clean.clean_laps(df)[1].first()
    assert row["high_threshold"] < 100 and row["removed_pit_out"] == 5


def test_fixed_bounds_are_inclusive_and_cleaning_is_idempotent(spark):
    rules = CleanRules(use_quantiles=False, min_lap_s=80.0, max_lap_s=90.0)
    once = clean.clean_laps(laps(spark, [79.9, 80.0, 85.0, 90.0, 90.1]), rules)[0]
    assert sorted(r["lap_duration"] for r in once.collect()) == [80.0, 85.0, 90.0]
    assert clean.clean_laps(once, rules)[0].count() == 3


@pytest.mark.parametrize("low,high", [(0.0, 0.9), (0.5, 0.5), (0.9, 0.1), (0.1, 1.0)])
def test_bad_quantiles_are_refused(low, high):
    with pytest.raises(ValueError):
        CleanRules(q_low=low, q_high=high)


SCOPE = "year long, meeting_key long, session_key long, session_type string, date_start string, date_end string, circuit_key long"


def test_scope_keeps_races_once_and_coerces_dates(spark):
    rows = [(2024, 10, 1, "Race", "2024-03-02T15:20:00+00:00", "junk", 5), (2024, 10, 1, "Race", "2024-03-02T18:00:00+00:00", None, 5),
            (2024, 11, 2, "Qualifying", "2024-03-01 10:00:00", None, 5)]
    got = scope.build_scope(spark.createDataFrame(rows, SCOPE)).collect()
    assert len(got) == 1 and got[0]["date_end"] is None
    assert got[0]["session_start_hour_utc"] == dt.datetime(2024, 3, 2, 15)


def test_scope_needs_its_keys(spark):
    with pytest.raises(shape.MissingColumns):
        scope.build_scope(spark.createDataFrame([(1,)], "session_key long"))


def enrich(spark, parity=False):
    sc = spark.createDataFrame([(2024, 10, 1, "Race", 5)], "year long, meeting_key long, session_key long, session_type string, circuit_key long")
    rows = [(99, 1, "2024-03-02 15:40:00"), (10, 1, None), (77, 2, "2024-03-02 15:40:00")]
    df = spark.createDataFrame(rows, "meeting_key long, session_key long, date_start string")
    return context.add_context(df, sc, parity)


def test_context_of_known_and_unknown_sessions(spark):
    got = {(r["session_key"], r["date_start"] is None): r for r in enrich(spark).collect()}
    known, late, lost = got[(1, False)], got[(1, True)], got[(2, False)]
    assert known["meeting_key"] == 10 and known["meeting_key_mismatch"] and known["lap_hour_utc"] == dt.datetime(2024, 3, 2, 15)
    assert late["lap_hour_utc"] is None and late["meeting_key_mismatch"] is False
    assert lost["missing_session_meta"] and lost["meeting_key"] == 77 and lost["circuit_key"] is None


def test_parity_never_sees_a_mismatch(spark):
    assert enrich(spark, True).where("meeting_key_mismatch").count() == 0


def weather_parts(spark):
    ctx = spark.createDataFrame([(1, 5, dt.datetime(2024, 1, 1, 10)), (1, 5, None), (2, 6, dt.datetime(2024, 1, 1, 10)),
                                 (3, 5, dt.datetime(2024, 1, 1, 11)), (4, 7, dt.datetime(2023, 1, 1, 11))],
                                "session_key long, circuit_key long, lap_hour_utc timestamp")
    urls = spark.createDataFrame([(5, "https://x.org/wiki/A%20b+c"), (7, "https://x.org/wiki/D")], "circuit_key long, wikipedia_circuit_url string")
    station = spark.createDataFrame([("https://x.org/wiki/A%20b+c", "007"), ("https://x.org/wiki/D", "008")], "circuit_url string, station_id string")
    hours = spark.createDataFrame([("007", dt.datetime(2024, 1, 1, 10), 20.0), ("007", dt.datetime(2024, 1, 1, 10), 25.0),
                                   ("007", dt.datetime(2024, 1, 1, 11), None), ("008", dt.datetime(2024, 1, 1, 11), 1.0)],
                                  "station_id string, weather_hour_utc timestamp, temp double")
    return ctx, weather.circuit_stations(urls, station), hours


def test_weather_join(spark):
    ctx, mapping, hours = weather_parts(spark)
    assert {r["circuit_id"] for r in mapping.collect()} == {"A b+c", "D"}
    joined = weather.attach_weather(ctx, mapping, hours)
    # The repeated hour does not multiply laps, a null hour matches nothing, circuit 6 has no page.
    assert joined.count() == 4
    kept = weather.with_weather_only(joined).collect()
    assert [(r["session_key"], r["temp"], r["station_id"]) for r in kept] == [(1, 20.0, "007")]
    failed = {r["session_key"]: r["error"] for r in weather.failed_sessions(ctx, mapping, hours).collect()}
    assert failed == {2: "circuit has no station", 4: "no weather for 2023"}
    assert [r[0] for r in weather.unmapped_circuits(ctx, mapping).collect()] == [6]
    strict = weather.strict_sessions(joined, weather.failed_sessions(ctx, mapping, hours))
    assert {r["session_key"] for r in strict.collect()} == {1, 3}


def test_dataset_keeps_duplicates_and_the_loader_drops_them(spark):
    row = (2024, 10, 1, 5, 44, 3, 90.0, 21.0)
    cols = "year long, meeting_key long, session_key long, circuit_key long, driver_number long, lap_number long, lap_duration double, temp double"
    df = spark.createDataFrame([row, row, (2024, 10, 1, 5, 44, 4, 91.2345, None), (2024, 10, 1, 5, 44, 5, None, 20.0)], cols)
    summary = dataset.quality_summary(df).first()
    assert (summary["n_rows"], summary["n_duplicates_key"], summary["missing_target"], summary["missing_weather_all"]) == (4, 1, 1, 1)
    assert dataset.build_dataset(df).count() == 2
    facts = star.fact_laps(df).orderBy("lap_number").collect()
    assert [(r["lap_number"], str(r["lap_duration"])) for r in facts] == [(3, "90.000"), (4, "91.235")]


def test_interval(spark):
    df = spark.createDataFrame([("03:00:00",), ("-05:30:00",), ("soon",), (None,)], "g string")
    got = [r[0] for r in df.select(star.interval("g")).collect()]
    assert got == [dt.timedelta(hours=3), -dt.timedelta(hours=5, minutes=30), None, None]


def test_empty_text_is_null_on_load(spark):
    df = spark.createDataFrame([(7, "", "Ann")], "driver_number int, team_name string, full_name string")
    row = star.dim_drivers(df).first()
    assert row["team_name"] is None and row["full_name"] == "Ann" and row["headshot_url"] is None


def test_modal_names_and_variants(spark):
    rows = [(1, "B", "X", " Miami ", 2023), (1, "A", "X", "Miami Gardens", 2024), (1, "B", "X", "", 2024), (1, "A", "X", None, 2023), (None, "Z", "X", "y", 2023)]
    df = spark.createDataFrame(rows, "circuit_key long, circuit_short_name string, country_name string, location string, year long")
    got = scope.circuits_in_use(df).collect()
    assert len(got) == 1
    assert (got[0]["circuit_short_name"], got[0]["location_variants"], got[0]["years_present"]) == ("A", "Miami|Miami Gardens", "2023|2024")
