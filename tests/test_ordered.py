"""Hot groups and ordinary groups give the same rows, and both agree with pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapforge.operators import drift, features, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 1, rng.integers(2, 40, n))
    value = np.round(rng.normal(90, 12, n), 1)
    value[rng.random(n) < 0.3] = np.nan
    pdf = pd.DataFrame({"k": key, "pos": np.arange(n), "value": value})
    df = spark.createDataFrame(pdf).withColumn("value", F.nanvl("value", F.lit(None).cast("double"))).repartition(6)
    return pdf, df.cache()


def rows(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("hot", [5, 200, 10**6])
def test_quantiles(skewed, hot):
    pdf, df = skewed
    got = {r["k"]: (r["a"], r["b"], r["n"]) for r in ordered.quantiles(df, ["k"], "value", {"a": 0.01, "b": 0.5}, hot).collect()}
    want = pdf.dropna().groupby("k")["value"]
    assert got.keys() == set(want.groups)
    for k, g in want:
        assert got[k] == (pytest.approx(g.quantile(0.01), abs=1e-9), pytest.approx(g.quantile(0.5), abs=1e-9), len(g))


@pytest.mark.parametrize("hot", [10, 10**6])
def test_global_quantile_and_empty(skewed, hot):
    pdf, df = skewed
    row = ordered.quantiles(df, [], "value", {"m": 0.5}, hot).first()
    assert row["m"] == pytest.approx(pdf["value"].median()) and row["n"] == pdf["value"].count()
    assert ordered.quantiles(df.where("false"), [], "value", {"m": 0.5}, hot).count() == 0


@pytest.mark.parametrize("hot", [5, 300, 10**6])
def test_fill_forward(skewed, hot):
    pdf, df = skewed
    got = ordered.fill_forward(df, ["k"], ["pos"], ["value"], hot).toPandas().sort_values("pos")
    want = pdf.groupby("k")["value"].ffill()
    np.testing.assert_array_equal(got["value"].to_numpy(dtype=float), want.to_numpy())


@pytest.mark.parametrize("hot", [5, 300, 10**6])
def test_group_medians(skewed, hot):
    pdf, df = skewed
    got = {r["k"]: (r["value_median"], r["value_nulls"]) for r in ordered.group_medians(df, ["k"], ["value", "pos"], hot).collect()}
    for k, g in pdf.groupby("k"):
        assert got[k] == (pytest.approx(g["value"].median()), g["value"].isna().sum())


@pytest.mark.parametrize("hot", [10, 10**6])
def test_positions(skewed, hot):
    pdf, df = skewed
    got = ordered.positions(df, ["pos"], "p", hot).toPandas()
    assert (got["p"] == got["pos"]).all() and set(got["p_total"]) == {len(pdf)}


@pytest.mark.parametrize("hot", [None, ordered.ALL])
def test_prefix_sums_keep_null_keys(spark, hot):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 5)], "k string, o int, n long")
    got = rows(ordered.prefix_sums(df, ["k"], ["o"], ["n"], hot), ["k", "o", "n_upto", "n_total"])
    assert got == [("a", 1, 5, 5), (None, 1, 2, 5), (None, 2, 5, 5)]


@pytest.mark.parametrize("bucket", [1, 40, 10**9])
def test_split_does_not_depend_on_the_digit_buckets(shapes, monkeypatch, bucket):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "is_train"]
    want = rows(features.stratified_flag(shapes.facts), cols)
    monkeypatch.setattr(features, "BUCKET_ROWS", bucket)
    assert rows(features.stratified_flag(shapes.facts), cols) == want


def test_drift_of_equal_parts_is_zero(spark):
    df = spark.range(500).select((F.col("id") % 50).cast("double").alias("x"), F.when(F.col("id") < 250, "reference").otherwise("current").alias("side"))
    row = drift.ks_by_column(df, ["x"]).first()
    assert row["statistic"] == 0 and row["p_value"] == 1.0


def test_drift_of_disjoint_parts_is_one(spark):
    df = spark.range(400).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") < 200, "reference").otherwise("current").alias("side"))
    row = drift.ks_by_column(df, ["x"]).first()
    assert row["statistic"] == 1.0 and row["p_value"] < 1e-6


def test_series_p_value(spark):
    # Published critical value: x = 1.358 is the 5 % point of the limiting distribution.
    row = spark.range(1).select(drift._ks_p_value(F.lit(1.358 / np.sqrt(500.0)), F.lit(1000.0), F.lit(1000.0)).alias("p")).first()
    assert row["p"] == pytest.approx(0.05, abs=5e-4)


def test_both_paths_give_the_same_bits(skewed):
    _, df = skewed
    odd = df.withColumn("value", F.col("value") * 1.1 + F.col("pos") / 7)
    probs = {"a": 0.01, "b": 0.5, "c": 0.95, "d": 1 / 3}
    one, two = (sorted(map(tuple, ordered.quantiles(odd, ["k"], "value", probs, hot).collect())) for hot in (5, 10**6))
    assert one == two
    one, two = (sorted(map(tuple, ordered.group_medians(odd, ["k"], ["value", "pos"], hot).collect())) for hot in (5, 10**6))
    assert one == two
    one, two = (ordered.quantiles(odd, [], "value", probs, hot).first() for hot in (5, 10**6))
    assert tuple(one) == tuple(two)


def test_medians_of_whole_columns_order_only_the_middle(spark, skewed, monkeypatch):
    """The same bits as from sorted arrays, without the values being shuffled and put in order; NaN stands last."""
    _, df = skewed
    odd = df.withColumn("value", F.col("value") * 1.1 + F.col("pos") / 7).withColumn("few", F.col("pos") % 3).withColumn(
        "none", F.lit(None).cast("double")).withColumn("nan", F.when(F.col("pos") % 5 > 1, F.lit(float("nan"))).otherwise(F.col("pos")))
    columns = ["value", "pos", "few", "none", "nan"]
    want = ordered.group_medians(odd, [], columns, 10**6).first()

    def refuse(*_):
        raise AssertionError("all values are put in order")

    monkeypatch.setattr(ordered, "order_chunks", refuse)
    got = ordered.group_medians(odd, [], columns, 10).first()
    assert repr(got) == repr(want) and got["value_nulls"] > 0 and got["few_median"] == 1.0 and got["none_median"] is None
    two = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert tuple(ordered.group_medians(two, [], ["v"], 1).first()) == (1.5, 1)
