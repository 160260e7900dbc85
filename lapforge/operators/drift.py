"""Distribution drift and model comparison between a reference part and a current part."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lapforge.constants import DRIFT_FEATURES, TARGET
from lapforge.operators.ordered import HOT_ROWS, hot_groups, melt, prefix_sums

REFERENCE, CURRENT = "reference", "current"


def split_by_position(df: DataFrame, order_by: Sequence[str], share: float = 0.7, side: str = "side") -> DataFrame:
    """The first floor(share * n) rows in the given order are the reference part; rows that are alike in all order columns stay
    together, on the current side if the cut falls among them.

    Only the order columns are counted and ordered, to find the first row of the current part. The rows themselves are then
    compared with it where they are.
    """
    order_by = list(order_by)
    counts = df.groupBy(*order_by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = prefix_sums(counts, [], order_by, ["_n"], hot_groups(counts, [], HOT_ROWS))
    edge = ranked.where(F.col("_n_upto") > F.floor(F.col("_n_total") * F.lit(share))).orderBy(*order_by).select(*order_by).first()
    if edge is None:
        return df.withColumn(side, F.lit(REFERENCE))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    first = F.struct(*[F.lit(edge[c]).cast(kinds[c]).alias(c) for c in order_by])
    return df.withColumn(side, F.when(F.struct(*order_by) < first, REFERENCE).otherwise(CURRENT))


def split_by_time(df: DataFrame, column: str, since, side: str = "side") -> DataFrame:
    """Rows before `since` are the reference part. A plain expression: no shuffle."""
    return df.withColumn(side, F.when(F.col(column) < F.lit(since), REFERENCE).otherwise(CURRENT))


def _ks_p_value(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value: 2 * sum (-1)^(k-1) exp(-2 k^2 x^2), x = d * sqrt(nm / (n + m))."""
    x = d * F.sqrt(n * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


def ks_by_column(df: DataFrame, columns: Sequence[str] = (*DRIFT_FEATURES, TARGET), side: str = "side") -> DataFrame:
    """Exact two-sample Kolmogorov-Smirnov statistic per column.

    Values are counted per (column, value) before the only ordered step, and that step is
    range-partitioned, so neither a long column nor a hot value lands in one task.
    """
    long = melt(df.where(F.col(side).isin(REFERENCE, CURRENT)), [side], columns).where("value IS NOT NULL")
    counts = long.groupBy("feature", "value").agg(
        F.count_if(F.col(side) == REFERENCE).alias("r"), F.count_if(F.col(side) == CURRENT).alias("c"))
    ranked = prefix_sums(counts, ["feature"], ["value"], ["r", "c"])
    gap = F.abs(F.col("r_upto") / F.col("r_total") - F.col("c_upto") / F.col("c_total"))
    per = ranked.where("r_total > 0 AND c_total > 0").groupBy("feature").agg(
        F.max(gap).alias("statistic"), F.max("r_total").alias("n_reference"), F.max("c_total").alias("n_current"))
    return per.withColumn("p_value", _ks_p_value(F.col("statistic"), F.col("n_reference").cast("double"), F.col("n_current").cast("double")))


def drift_flags(ks: DataFrame, alpha: float = 0.05) -> DataFrame:
    return ks.withColumn("drifted", F.col("p_value") < alpha)


def drift_summary(flags: DataFrame, share_limit: float = 0.5) -> DataFrame:
    share = F.avg(F.col("drifted").cast("int"))
    return flags.agg(F.count(F.lit(1)).alias("n_columns"), F.count_if("drifted").alias("n_drifted"),
                     share.alias("drift_share"), (share >= share_limit).alias("dataset_drift"))


def regression_metrics(df: DataFrame, keys: Sequence[str] = (), target: str = TARGET, prediction: str = "prediction") -> DataFrame:
    """MAE, RMSE, R2, MAPE (zero targets left out and counted), mean error and error deviation."""
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    e = y - p
    known = df.where(y.isNotNull() & p.isNotNull())
    n = F.count(F.lit(1))
    total = F.var_pop(y) * n
    return known.groupBy(*keys).agg(
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(total > 0, 1 - F.sum(e * e) / F.nullif(total, F.lit(0.0))).alias("r2"),
        (100 * F.avg(F.abs(e / F.nullif(y, F.lit(0.0))))).alias("mape"), F.count_if(y == 0).alias("zero_targets"),
        F.avg(-e).alias("mean_error"), F.stddev_samp(e).alias("error_std"))


def performance_by_side(df: DataFrame, side: str = "side", target: str = TARGET, prediction: str = "prediction") -> DataFrame:
    return regression_metrics(df, [side], target, prediction)


def retrain_needed(performance: DataFrame, summary: DataFrame, mae_limit: float = 1.5, side: str = "side") -> DataFrame:
    """Retrain when the current part's MAE is above the limit or the dataset has drifted."""
    mae = performance.where(F.col(side) == CURRENT).agg(F.max("mae").alias("current_mae"))
    return mae.withColumn("dataset_drift", summary.select("dataset_drift").scalar()).select(
        "current_mae", "dataset_drift",
        (F.coalesce(F.col("current_mae") > mae_limit, F.lit(False)) | F.col("dataset_drift")).alias("retrain"))


def gap_scores(runs: DataFrame) -> DataFrame:
    """overfitting_ratio = test MAE / train MAE; concept_drift_score = |cross-validated R2 - test R2|."""
    return runs.withColumn("overfitting_ratio", F.col("test_mae") / F.nullif("train_mae", F.lit(0.0))).withColumn(
        "concept_drift_score", F.abs(F.col("cv_r2_mean") - F.col("test_r2")))
