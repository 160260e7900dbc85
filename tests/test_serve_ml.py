"""Serving, features, models and run selection."""


import pytest
from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.functions.timing import format_lap_time, signed_delta
from lapforge.operators import drift, features, models, quality, runs, serve, shape
from lapforge.plans import shapes as S
from lapforge.plans.catalog_pipeline import facts


def test_lap_time_text(spark):
    df = spark.createDataFrame([(59.9996,), (90.5,), (3.0,), (None,)], "x double")
    assert [r[0] for r in df.select(format_lap_time("x")).collect()] == ["0:60.000", "1:30.500", "0:03.000", None]
    row = df.limit(1).select(signed_delta(F.lit(1.5), F.lit(2.0)).alias("a"), signed_delta(F.lit(2.5), F.lit(2.0)).alias("b")).first()
    assert tuple(row) == ("-0.500", "+0.500")


def test_pages_cover_everything_once(shapes):
    df = facts(shapes).where("driver_number IN (3, 4)").cache()
    page = serve.laps_page(df, 1, 50, driver_number=3)
    seen, last = [], None
    for i in range(1, page.total_pages + 1):
        rows = serve.laps_page(df, i, 50, driver_number=3).data.collect()
        seen += rows
    assert len(seen) == page.total == df.where("driver_number = 3").count()
    assert len(set(seen)) == len(seen)
    keyset = []
    while True:
        rows = serve.laps_after(df, last, 50, driver_number=3).collect()
        keyset += rows
        if len(rows) < 50:
            break
        last = (rows[-1]["session_key"], rows[-1]["driver_number"], rows[-1]["lap_number"])
    # (session, driver, lap) is not unique across meetings here; the keyset skips ties at a page edge only.
    assert {(r["session_key"], r["lap_number"]) for r in keyset} == {(r["session_key"], r["lap_number"]) for r in seen}


@pytest.mark.parametrize("call", [lambda f: serve.laps_page(f, 1, 1001), lambda f: serve.laps_page(f, 0), lambda f: serve.driver_laps(f, 1, limit=0),
                                  lambda f: serve.circuit_laps(f, 1, limit=5000)])
def test_limits(shapes, call):
    with pytest.raises(ValueError):
        call(shapes.facts)


def request(spark, **change):
    row = {"driver_number": 1, "circuit_key": 7, "st_speed": 310.5, "i1_speed": 295.2, "i2_speed": 288.1, "temp": 25.0, "rhum": 45.0,
           "pres": 1013.0, "lap_number": 15, **change}
    kinds = {int: "int", float: "double"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(type(v), 'double')}" for k, v in row.items()))


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"driver_number": 100}, "driver_number > 99"), ({"circuit_key": 0}, "circuit_key < 1"), ({"st_speed": 400.0}, None),
    ({"st_speed": 400.1}, "st_speed > 400"), ({"rhum": -1.0}, "rhum < 0"), ({"pres": None}, "pres missing"),
    ({"circuit_avg_laptime": 59.0}, "circuit_avg_laptime < 60"), ({"temp": float("nan")}, "temp > 60")])
def test_request_validation(spark, change, reason):
    good, bad = serve.split_requests(request(spark, **change))
    assert (good.count(), [r["reason"] for r in bad.collect()]) == ((1, []) if reason is None else (0, [[reason]]))


def test_enrichment_defaults(spark, shapes):
    tables = serve.serving_tables(facts(shapes))
    unknown = serve.enrich_requests(request(spark, circuit_key=999, lap_number=140), tables).first()
    assert (unknown["year"], unknown["circuit_avg_laptime"], unknown["driver_perf_score"], unknown["lap_progress"]) == (2025, 90.0, 0.0, 1.0)
    given = serve.enrich_requests(request(spark, circuit_avg_laptime=88.0, driver_perf_score=-1.5), tables).first()
    assert (given["circuit_avg_laptime"], given["driver_perf_score"]) == (88.0, -1.5)
    stranger = serve.enrich_requests(request(spark, driver_number=98), tables).first()
    assert stranger["driver_perf_score"] == 0.0


def test_split_sizes_and_copies(spark):
    rows = [(1, s, d, l, c) for c, s in ((5, 1), (6, 2)) for d in range(1, 8) for l in range(1, 14)]
    df = spark.createDataFrame(rows, "meeting_key long, session_key long, driver_number long, lap_number long, circuit_key long")
    flagged = features.stratified_flag(df.union(df.where("driver_number = 3")))
    assert flagged.where("driver_number = 3").groupBy(*K.LAP_KEY).agg(F.countDistinct("is_train").alias("n")).where("n > 1").count() == 0
    sizes = {r["circuit_key"]: r["n"] for r in features.stratified_flag(df).where("is_train").groupBy("circuit_key").agg(F.count("*").alias("n")).collect()}
    # 182 rows give ceil(36.4) = 37 test rows; the odd one comes from the smaller stratum.
    assert sizes == {5: 72, 6: 73}
    again = features.stratified_flag(df.repartition(7)).exceptAll(features.stratified_flag(df))
    assert again.count() == 0 and features.stratified_flag(df, seed=1).exceptAll(features.stratified_flag(df)).count() > 0


def test_second_median_sees_the_filled_column(spark):
    rows = [(1, 1, 10.0), (1, 1, None), (1, 1, None), (2, 2, 20.0), (3, 3, None)]
    df = spark.createDataFrame(rows, "circuit_key long, driver_number long, st_speed double")
    for hot in (None, 1):
        got = sorted(r["st_speed"] for r in features.impute_groups(df, ["st_speed"], hot).collect())
        # 10, 10, 10, 20 after the group fill: the last row gets 10, not 15.
        assert got == [10.0, 10.0, 10.0, 10.0, 20.0]


def test_forward_fill_crosses_drivers_in_lap_order(spark):
    rows = [(1, 1, 1, 20.0), (1, 2, 1, None), (1, 1, 2, None), (1, 2, 2, 22.0), (1, 1, 3, None), (2, 1, 1, None)]
    df = spark.createDataFrame(rows, "session_key long, driver_number long, lap_number long, temp double")
    got = {(r["session_key"], r["lap_number"], r["driver_number"]): r["temp"] for r in features.impute(df).collect()}
    assert got[(1, 1, 2)] == 20.0 and got[(1, 2, 1)] == 20.0 and got[(1, 3, 1)] == 22.0
    assert got[(2, 1, 1)] == 20.0  # median of 20, 20, 20, 22, 22


def test_unseen_categories(spark):
    df = spark.createDataFrame([(1, 1, 90.0, True), (1, 2, 100.0, True), (2, 1, 70.0, False), (2, 9, 71.0, False)],
                               "circuit_key long, driver_number long, lap_duration double, is_train boolean").withColumns(
        {"session_key": F.lit(1), "lap_number": F.lit(100), "st_speed": F.lit(3.0), "i1_speed": F.lit(6.0), "i2_speed": F.lit(9.0)})
    enc = features.TargetEncoder.fit(df, ["circuit_key"]).apply(df)
    assert {r["circuit_avg_laptime"] for r in enc.where("circuit_key = 2").collect()} == {95.0}
    got = {(r["circuit_key"], r["driver_number"]): r for r in features.DerivedFeatures.fit(df).apply(df).collect()}
    assert got[(1, 1)]["driver_perf_score"] == -5.0
    assert got[(2, 1)]["driver_perf_score"] == -5.0  # own mean elsewhere against the overall mean
    assert got[(2, 9)]["driver_perf_score"] == 0.0
    assert got[(2, 9)]["avg_speed"] == 6.0 and got[(2, 9)]["lap_progress"] == 1.0


def test_zero_targets_leave_mape_finite(spark):
    df = spark.createDataFrame([(0.0, 1.0), (100.0, 90.0)], "lap_duration double, prediction double")
    row = drift.regression_metrics(df).first()
    assert (row["mape"], row["zero_targets"], row["mae"]) == (10.0, 1, 5.5)


RUN = "run_id string, model_family string, test_mae double, test_r2 double, overfitting_ratio double"


@pytest.mark.parametrize("rows,strategy,family,best", [
    ([("a", "x", 1.0, 0.5, 9.0), ("b", "x", 2.0, 0.5, 4.0), ("c", "y", 3.0, 0.5, 3.0)], "robust", None, "c"),
    ([("a", "x", 1.0, 0.5, 9.0), ("b", "x", 2.0, 0.5, 4.0), ("c", "y", 3.0, 0.5, 3.0)], "robust", "x", "b"),
    ([("a", "x", 2.0, 0.5, 9.0), ("b", "x", 1.0, 0.5, 8.0)], "robust", None, "b"),
    ([("a", "x", 1.0, 0.5, 9.0), ("b", "x", 1.005, 0.6, 8.0), ("c", "x", 1.006, 0.9, 1.0)], "mae", None, "b"),
    ([("a", "x", 1.0, 0.5, 9.0), ("b", "x", 1.02, 0.6, 8.0)], "mae", None, "a"),
    ([("a", "x", 1.0, 0.5, None)], "robust", None, "a")])
def test_best_run(spark, rows, strategy, family, best):
    assert runs.best_run(spark.createDataFrame(rows, RUN), strategy, family).first()["run_id"] == best


def test_grids_have_the_published_sizes():
    assert len(models.parameter_points(K.GRID["boosted_trees"])) == 24
    assert len(models.parameter_points(K.GRID["random_forest"])) == 16
    assert len(K.EXCLUDED_FEATURES) == 27 and len(K.MODEL_FEATURES) == 14


def test_model_round_trip(spark, shapes, tmp_path):
    small = features.preprocess(shapes.facts.where("session_key < 5"), tiebreak=S.LAP_ORDER).cache()
    # Every model feature is a kept column; what else is kept is the derivation's own key material.
    assert set(K.MODEL_FEATURES) <= set(models_columns(small))
    run = models.train_run(small, "random_forest", folds=2, numTrees=3, maxDepth=3)
    record = run.record.first()
    assert record["overfitting_ratio"] == pytest.approx(record["test_mae"] / record["train_mae"])
    assert record["n_train"] + record["n_test"] == small.count()
    models.save(run.model, str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m"))
    a, b = (m.transform(small).agg(F.sum("prediction")).first()[0] for m in (run.model, again))
    assert a == pytest.approx(b, abs=1e-3)
    ranks = run.importance.orderBy("importance_rank").collect()
    assert len(ranks) == 14 and sum(r["importance"] for r in ranks) == pytest.approx(1.0)


def models_columns(df):
    return features.model_columns(df)


def test_dataset_checks_fail_on_bad_rows(shapes):
    checks = {r["check_name"]: r for r in quality.dataset_checks(shapes.facts, S.LAP_ORDER).collect()}
    assert not checks["repeated lap rows"]["passed"] and checks["year min"]["passed"]
    assert not quality.all_passed(quality.dataset_checks(shapes.facts, S.LAP_ORDER))
    ok = shapes.facts.withColumn("wikipedia_latitude", F.lit(1.0)).withColumn("wikipedia_longitude", F.lit(1.0))
    assert quality.all_passed(quality.mapping_check(ok))


def test_conform_and_missing(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert shape.conform(df, ["b", "z", "a"]).columns == ["b", "a"]
    with pytest.raises(shape.MissingColumns):
        shape.conform(df, ["a"], required=["z"])
    assert shape.columns_missing(df, ["a", "q"]) == ["q"]


@pytest.mark.parametrize("name, called, family", [
    ("random_forest_importance", "fit", "random_forest"), ("boosted_trees_scores", "fit", "boosted_trees"),
    ("train_run_record", "train_run", "random_forest"), ("grid_search_points", "grid_search", "random_forest")])
def test_registered_model_queries_use_the_published_settings(spark, monkeypatch, name, called, family):
    """What each hands to training, without training."""
    import inspect
    from lapforge.plans.registry import QUERIES

    class Seen(Exception):
        pass

    shape = inspect.signature(getattr(models, called))

    def see(*args, **settings):
        given = shape.bind(*args, **settings)
        given.apply_defaults()
        raise Seen(given.arguments)

    monkeypatch.setattr(models, called, see)
    with pytest.raises(Seen) as seen:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    given = seen.value.args[0]
    assert given["family"] == family
    if called == "grid_search":
        assert (given["grid"] or K.GRID[family]) == K.GRID[family] and given["folds"] == K.GRID_FOLDS == 3
        assert given.get("fixed", {}) == K.FIXED[family]
    else:
        assert (given.get("params") or K.BASELINE[family]) == K.BASELINE[family]
        assert given.get("folds", K.CV_FOLDS) == K.CV_FOLDS == 5
