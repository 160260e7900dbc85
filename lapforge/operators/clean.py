"""Lap cleaning: first failing rule per lap, per-session quantile bounds, removal counters."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lapforge.constants import QUANTILE_HIGH, QUANTILE_LOW, QUANTILE_MIN_ROWS, TARGET
from lapforge.operators.ordered import quantiles
from lapforge.operators.shape import require
from lapforge.session import lookup

RULE = "removed_by"


@dataclass(frozen=True)
class CleanRules:
    use_quantiles: bool = True
    q_low: float = QUANTILE_LOW
    q_high: float = QUANTILE_HIGH
    min_rows: int = QUANTILE_MIN_ROWS
    min_lap_s: float | None = None
    max_lap_s: float | None = None

    def __post_init__(self):
        if self.use_quantiles and not 0.0 < self.q_low < self.q_high < 1.0:
            raise ValueError("quantiles must satisfy 0 < q_low < q_high < 1")


def fixed_rule(laps: DataFrame, rules: CleanRules) -> Column:
    """Name of the first row-level rule the lap fails, or null. An unknown pit flag keeps the lap."""
    lap = F.col(TARGET)
    rule = F.when(lap.isNull() | F.isnan(lap), "null_target").when(lap <= 0, "nonpositive_target")
    if "is_pit_out_lap" in laps.columns:
        rule = rule.when(F.coalesce(F.col("is_pit_out_lap"), F.lit(False)), "pit_out")
    if rules.min_lap_s is not None:
        rule = rule.when(lap < rules.min_lap_s, "outlier")
    if rules.max_lap_s is not None:
        rule = rule.when(lap > rules.max_lap_s, "outlier")
    return rule


def session_bounds(survivors: DataFrame, rules: CleanRules) -> DataFrame:
    """Inclusive bounds per session over the laps that survive the row-level rules.

    A session with fewer than min_rows laps, or with equal bounds, has none.
    """
    q = quantiles(survivors, ["session_key"], TARGET, {"low_threshold": rules.q_low, "high_threshold": rules.q_high})
    return q.where((F.col("n") >= rules.min_rows) & (F.col("low_threshold") < F.col("high_threshold"))).drop("n")


def label_laps(laps: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """Every lap with the rule that removes it (null = kept) and its session's bounds."""
    require(laps, ["session_key", TARGET])
    df = laps.withColumn(RULE, fixed_rule(laps, rules))
    if not rules.use_quantiles:
        none = F.lit(None).cast("double")
        return df.withColumn("low_threshold", none).withColumn("high_threshold", none)
    bounds = lookup(session_bounds(df.where(F.col(RULE).isNull()), rules))
    outside = (F.col(TARGET) < F.col("low_threshold")) | (F.col(TARGET) > F.col("high_threshold"))
    return df.join(bounds, "session_key", "left").withColumn(
        RULE, F.coalesce(RULE, F.when(outside, F.lit("outlier"))))


def kept_laps(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col(RULE).isNull()).drop(RULE, "low_threshold", "high_threshold")


def clean_report(labelled: DataFrame) -> DataFrame:
    """Counters per session."""
    def removed(rule):
        return F.count_if(F.col(RULE) == rule)
    return labelled.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("n_in"), F.count_if(F.col(RULE).isNull()).alias("n_out"),
        removed("null_target").alias("removed_null_target"),
        removed("nonpositive_target").alias("removed_nonpositive_target"),
        removed("pit_out").alias("removed_pit_out"), removed("outlier").alias("removed_outliers"),
        F.max("low_threshold").alias("low_threshold"), F.max("high_threshold").alias("high_threshold"))


def clean_laps(laps: DataFrame, rules: CleanRules = CleanRules()) -> tuple[DataFrame, DataFrame]:
    labelled = label_laps(laps, rules)
    return kept_laps(labelled), clean_report(labelled)
