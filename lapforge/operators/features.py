"""Imputation, leak-free encodings, derived features and splits.

Each learned step is a pair fit -> small tables, apply -> plain expressions and lookup joins.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F, types as T

from lapforge import constants as K
from lapforge.functions.text import encoded_name
from lapforge.functions.timing import avg_speed, lap_progress
from lapforge.operators.ordered import fill_forward, group_medians
from lapforge.operators.serve import typical_max_laps
from lapforge.operators.shape import feature_columns
from lapforge.session import lookup, store

GROUP = ["circuit_key", "driver_number"]
FILL_ORDER = ["lap_number", "driver_number"]
BUCKET_ROWS = 50_000


def _fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    usable = {c: v for c, v in values.items() if v is not None}
    return df.select(*[F.coalesce(F.col(c), F.lit(usable[c])).alias(c) if c in usable else F.col(c) for c in df.columns])


def global_medians(df: DataFrame, columns: Sequence[str], hot_rows: int | None = None) -> dict[str, float]:
    """Exact median of each column."""
    if not columns:
        return {}
    row = group_medians(df, [], columns, hot_rows).first()
    return {c: row[f"{c}_median"] for c in columns}


def _has_keyless(df: DataFrame) -> bool:
    return df.where(F.col(GROUP[0]).isNull() | F.col(GROUP[1]).isNull()).limit(1).count() > 0


def impute_groups(df: DataFrame, columns: Sequence[str], hot_rows: int | None = None,
                  keyless: bool | None = None) -> DataFrame:
    """Null -> median of (circuit, driver), else median of the column as it stands after that fill.

    The second median is computed only for columns that still have nulls then, which the group
    table tells without another look at the rows.
    """
    columns = list(columns)
    groups = lookup(group_medians(df, GROUP, columns, hot_rows))
    filled = df.join(groups, GROUP, "left").select(*[
        F.coalesce(F.col(c), F.col(f"{c}_median")).alias(c) if c in columns else F.col(c) for c in df.columns])
    holes = groups.agg(*[
        F.coalesce(F.sum(F.when(F.col(f"{c}_median").isNull(), F.col(f"{c}_nulls"))), F.lit(0)).alias(c)
        for c in columns]).first()
    keyless = _has_keyless(df) if keyless is None else keyless
    open_columns = columns if keyless else [c for c in columns if holes[c]]
    return _fill(filled, global_medians(filled, open_columns, hot_rows))


def impute(df: DataFrame, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Sport columns by group median, weather forward in lap order within the session (all drivers
    together), then global medians of every numeric column that still has nulls."""
    sport = [c for c in K.SPORT_COLS if c in df.columns]
    weather = [c for c in K.WEATHER_COLS if c in df.columns]
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    keyless = F.count_if(F.col(GROUP[0]).isNull() | F.col(GROUP[1]).isNull()) if sport else F.lit(0)
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), keyless.alias("_keyless"), *[F.count(c).alias(c) for c in dict.fromkeys([*weather, *numeric])]).first()
    filled = impute_groups(df, sport, keyless=counted["_keyless"] > 0) if sport else df
    # A column without nulls has nothing to fill, one without values nothing to carry.
    gappy = [c for c in weather if 0 < counted[c] < counted["_rows"]]
    if gappy:
        order = FILL_ORDER + [c for c in tiebreak if c not in FILL_ORDER]
        filled = fill_forward(filled, ["session_key"], order, gappy)
    filled = store(filled)
    # Fills take nulls away only, so a column without them is not looked at again, and sport columns are whole or empty by now.
    left = [c for c in numeric if 0 < counted[c] < counted["_rows"] and c not in sport]
    if not left:
        return filled
    known = filled.agg(*[F.count(c).alias(c) for c in left]).first()
    return _fill(filled, global_medians(filled, [c for c in left if known[c] < counted["_rows"]]))


def stratified_flag(df: DataFrame, stratum: str = "circuit_key", test_size: float = K.TEST_SIZE,
                    seed: int = K.SEED, key: Sequence[str] = K.LAP_KEY, flag: str = "is_train") -> DataFrame:
    """Mark rows as train by a seeded hash of the key: all but ceil(test_size * N) of N rows, each stratum its share.

    A stratum's test rows are its share rounded down; what is missing from the total goes one each to the largest remainders
    (equal ones: the smaller stratum first).
    The mark depends only on the rows, never on their layout. Rows with the same key get the same
    mark, so copies never sit on both sides; a key that straddles the limit is train.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))
    marked = df.withColumn("_digest", digest)
    limit = lookup(_digest_limits(marked, stratum, test_size))
    cond = marked[stratum].eqNullSafe(limit[stratum])
    return marked.join(limit, cond, "left").select(
        *[marked[c] for c in df.columns], F.coalesce(F.col("_digest") <= F.col("_limit"), F.lit(False)).alias(flag))


def leading_digits(rows: int) -> int:
    return min(8, max(1, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16))))


def train_quotas(counts: DataFrame, stratum: str, test_size: float) -> DataFrame:
    """(_of, _quota): train rows of each stratum, from counts (stratum, _n). One row per stratum is ordered."""
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = counts.groupBy(F.col(stratum).alias("_of")).agg(F.sum("_n").alias("_size")).withColumn("_all", F.sum("_size").over(everyone))
    wanted = F.ceil(F.col("_all") * F.lit(test_size) - F.lit(1e-9))
    sizes = sizes.withColumn("_share", wanted * F.col("_size") / F.col("_all")).withColumn("_test", F.floor(F.col("_share") + F.lit(1e-9)))
    place = F.row_number().over(Window.orderBy((F.col("_share") - F.col("_test")).desc(), F.col("_of").asc_nulls_first()))
    extra = (place <= wanted - F.sum("_test").over(everyone)).cast("long")
    return sizes.select("_of", (F.col("_size") - F.col("_test") - extra).alias("_quota"))


def _digest_limits(marked: DataFrame, stratum: str, test_size: float) -> DataFrame:
    """Largest train digest per stratum, without ordering the rows.

    Digests are uniform, so counts per leading digits tell in which digit bucket the quota is
    reached; only the rows of that bucket are looked at one by one. The number of digits follows
    the number of rows and keeps a bucket near BUCKET_ROWS.
    """
    digits = F.substring("_digest", 1, leading_digits(marked.count()))
    upto = F.sum("_n").over(Window.partitionBy(stratum).orderBy("_digits").rowsBetween(Window.unboundedPreceding, 0))
    buckets = marked.groupBy(F.col(stratum).alias(stratum), digits.alias("_digits")).agg(F.count(F.lit(1)).alias("_n"))
    quotas = lookup(train_quotas(buckets, stratum, test_size))
    buckets = buckets.join(quotas, F.col(stratum).eqNullSafe(F.col("_of")))
    quota = F.col("_quota")
    turning = lookup(buckets.select(stratum, "_digits", "_n", "_quota", upto.alias("_upto")).where(
        (F.col("_upto") - F.col("_n") < quota) & (quota <= F.col("_upto"))).select(
        F.col(stratum).alias("_s"), F.col("_digits").alias("_d"), (quota - (F.col("_upto") - F.col("_n"))).alias("_left")))
    inside = marked.select(stratum, "_digest", digits.alias("_digits")).join(
        turning, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_digits") == F.col("_d")))
    counts = inside.groupBy(stratum, "_digest").agg(F.count(F.lit(1)).alias("_n"), F.max("_left").alias("_left"))
    before = F.sum("_n").over(Window.partitionBy(stratum).orderBy("_digest").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return counts.withColumn("_before", before).where(F.col("_before") < F.col("_left")).groupBy(stratum).agg(
        F.max("_digest").alias("_limit"))


def temporal_flag(df: DataFrame, train_years: Sequence[int] = tuple(K.TRAIN_YEARS), test_year: int = K.TEST_YEAR,
                  flag: str = "is_train") -> DataFrame:
    """Train years true, the test year false; other years are in neither part."""
    kept = df.where(F.col("year").isin([*train_years, test_year]))
    return kept.withColumn(flag, F.col("year").isin(list(train_years)))


@dataclass(frozen=True)
class TargetEncoder:
    """Mean target per category over train rows, and over all of them for unknown categories."""
    means: dict[str, DataFrame]
    overall: float | None

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], target: str = K.TARGET, flag: str = "is_train") -> "TargetEncoder":
        train = df.where(flag)
        means = {c: lookup(train.groupBy(c).agg(F.avg(target).alias(encoded_name(c))).dropna(subset=[c])) for c in columns}
        return cls(means, train.agg(F.avg(target)).first()[0])

    def apply(self, df: DataFrame) -> DataFrame:
        for c, table in self.means.items():
            name = encoded_name(c)
            df = df.join(table, c, "left").withColumn(name, F.coalesce(F.col(name), F.lit(self.overall)))
        return df


@dataclass(frozen=True)
class DerivedFeatures:
    """avg_speed, lap_progress and driver_perf_score."""
    max_laps: DataFrame
    circuits: DataFrame
    drivers: DataFrame
    pairs: DataFrame
    overall: float | None

    @classmethod
    def fit(cls, df: DataFrame, target: str = K.TARGET, flag: str = "is_train") -> "DerivedFeatures":
        """Means come from train rows; the typical lap count from all rows."""
        sums = lookup(df.where(flag).groupBy("driver_number", "circuit_key").agg(
            F.sum(target).alias("total"), F.count(target).alias("n")))
        mean = F.sum("total") / F.nullif(F.sum("n"), F.lit(0))
        return cls(
            lookup(typical_max_laps(df, rounded=False).dropna(subset=["circuit_key"])),
            lookup(sums.groupBy("circuit_key").agg(mean.alias("_circuit_mean")).dropna(subset=["circuit_key"])),
            lookup(sums.groupBy("driver_number").agg(mean.alias("_driver_mean")).dropna(subset=["driver_number"])),
            lookup(sums.groupBy("driver_number", "circuit_key").agg(mean.alias("_pair_mean")).dropna(subset=GROUP)),
            sums.agg(mean).first()[0])

    def apply(self, df: DataFrame) -> DataFrame:
        joined = df.join(self.max_laps, "circuit_key", "left").join(self.circuits, "circuit_key", "left") \
            .join(self.drivers, "driver_number", "left").join(self.pairs, ["driver_number", "circuit_key"], "left")
        circuit = F.coalesce("_circuit_mean", F.lit(self.overall))
        return joined.withColumn("avg_speed", avg_speed()).withColumn(
            "lap_progress", lap_progress("lap_number", "typical_max_lap", K.DEFAULT_MAX_LAP)).withColumn(
            "driver_perf_score", F.coalesce(F.col("_pair_mean"), F.col("_driver_mean"), circuit) - circuit).drop(
            "typical_max_lap", "_circuit_mean", "_driver_mean", "_pair_mean")


def preprocess(dataset: DataFrame, split: str = "stratified", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Flagged, imputed, encoded and derived dataset, ready for model_columns and training.

    The flag needs only keys, so it is set first and travels through the one frozen copy.
    """
    flagged = stratified_flag(dataset) if split == "stratified" else temporal_flag(dataset)
    filled = impute(flagged, tiebreak)
    encoded = TargetEncoder.fit(filled, ["circuit_key", "year"]).apply(filled)
    return DerivedFeatures.fit(filled).apply(encoded)


def model_columns(df: DataFrame) -> list[str]:
    return [c for c in feature_columns(df, K.EXCLUDED_FEATURES) if c != "is_train"]


def train_test(df: DataFrame, flag: str = "is_train") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(flag)), df.where(~F.col(flag))
