"""Order-dependent work that survives a group holding a large share of all rows.

Groups are measured first, by their key columns alone. A group of ordinary size goes through the
built-in aggregate or window, which handles it in one task. A hot group takes the chunked way: its
rows are range-partitioned on (keys, order), so it spreads over many chunks; windows run inside a
chunk, and only one summary row per (group, chunk) travels between chunks. Both give the same rows.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lapforge.session import freeze, lookup

CHUNK = "_chunk"
# Rows one task may hold of one group: values kept in memory by an aggregate, rows sorted by a window.
HOT_VALUES = 200_000
HOT_ROWS = 1_000_000
# Ranks of a whole column are first known to within its number of values / ACCURACY.
ACCURACY = 2_000
# Marks "every group is hot" for prefix_sums.
ALL = "all"


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | str | None:
    """Keys of the groups with more than limit rows; None when there are none, ALL without keys.

    There are at most rows / limit of them.
    """
    if not keys:
        return ALL if df.count() > limit else None
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if (sizes.agg(F.max("_rows")).first()[0] or 0) <= limit:
        return None
    return lookup(sizes.where(F.col("_rows") > limit).select(*keys))


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on keys; right holds them renamed by _renamed."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_r_{k}"])
    return cond


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.withColumnRenamed(k, f"_r_{k}")
    return df


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary groups, rows of hot groups)."""
    right = _renamed(hot, keys)
    cond = _match(df, right, keys)
    return df.join(right, cond, "left_anti"), df.join(right, cond, "left_semi")


def order_chunks(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Number the range partitions of df on order_by.

    Sampled range bounds may differ between two runs of the same plan, so the numbered rows are
    frozen before anyone reads the number twice.
    """
    return freeze(df.repartitionByRange(*order_by).withColumn(CHUNK, F.spark_partition_id()))


def _by_chunk(chunks: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = _renamed(lookup(summary), [*keys, CHUNK])
    return chunks.join(right, _match(chunks, right, [*keys, CHUNK]))


def _upto(group: Sequence[str], order_by: Sequence[str]) -> Window:
    return Window.partitionBy(*group).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)


def _before(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def prefix_sums(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], sums: Sequence[str],
                hot: DataFrame | str | None = ALL) -> DataFrame:
    """Add <s>_upto (running sum, inclusive) and <s>_total for each column in sums."""
    keys, order_by, sums = list(keys), list(order_by), list(sums)
    if hot is None:
        return df.select(*df.columns, *[F.sum(s).over(_upto(keys, order_by)).alias(f"{s}_upto") for s in sums],
                         *[F.sum(s).over(Window.partitionBy(*keys)).alias(f"{s}_total") for s in sums])
    if hot is not ALL:
        ordinary, big = split_hot(df, keys, hot)
        return prefix_sums(ordinary, keys, order_by, sums, None).unionByName(prefix_sums(big, keys, order_by, sums))
    chunks = order_chunks(df, keys + order_by)
    per_chunk = chunks.groupBy(*keys, CHUNK).agg(*[F.sum(s).alias(s) for s in sums])
    offsets = per_chunk.select(
        *keys, CHUNK,
        *[F.coalesce(F.sum(s).over(_before(keys)), F.lit(0)).alias(f"_{s}_before") for s in sums],
        *[F.sum(s).over(Window.partitionBy(*keys)).alias(f"{s}_total") for s in sums])
    inside = _upto([*keys, CHUNK], order_by)
    return _by_chunk(chunks, offsets, keys).select(
        *df.columns, *[(F.col(f"_{s}_before") + F.sum(s).over(inside)).alias(f"{s}_upto") for s in sums],
        *[f"{s}_total" for s in sums])


def _values_limit(keys: Sequence[str]) -> int:
    """An aggregating task holds many groups at once, but only one group when there are no keys."""
    return HOT_VALUES if keys else HOT_ROWS


def value_counts(df: DataFrame, keys: Sequence[str], value: str, n: str = "n") -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n))


def select_quantiles(counts: DataFrame, keys: Sequence[str], value: str, n: str, probs: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles from (keys, value, n) rows of hot groups; adds the row count `n`."""
    keys = list(keys)
    ranked = prefix_sums(counts, keys, [value], [n])
    upto, total = F.col(f"{n}_upto"), F.col(f"{n}_total")

    def at(rank: Column) -> Column:
        return F.max(F.when((upto - F.col(n) <= rank) & (rank < upto), F.col(value)))

    picks, outs = [], []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (total - 1)
        picks += [at(F.floor(pos)).alias(f"_{name}_lo"), at(F.ceil(pos)).alias(f"_{name}_hi"),
                  F.max(pos - F.floor(pos)).alias(f"_{name}_t")]
        lo, hi, t = (F.col(f"_{name}_{p}") for p in ("lo", "hi", "t"))
        outs.append((lo + (hi - lo) * t).alias(name))
    return ranked.groupBy(*keys).agg(F.max(total).alias("n"), *picks).select(*keys, "n", *outs)


def _interpolated(values: Column, q: float) -> Column:
    """Quantile of a sorted array, by the very expression that select_quantiles uses: groups of any size give the same bits."""
    pos = F.lit(float(q)) * (F.size(values).cast("long") - 1)
    lo, hi, t = F.get(values, F.floor(pos).cast("int")), F.get(values, F.ceil(pos).cast("int")), pos - F.floor(pos)
    return F.when(F.size(values) > 0, lo + (hi - lo) * t)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
              hot_rows: int | None = None) -> DataFrame:
    """Exact quantiles of value per group, with the number of values `n`.

    In a hot group equal values are counted before anything is ordered.
    """
    keys = list(keys)
    hot_rows = hot_rows or _values_limit(keys)
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    hot = hot_groups(known, keys, hot_rows)
    if hot is ALL:
        return select_quantiles(value_counts(known, keys, value), keys, value, "n", probs)
    ordinary, big = (known, None) if hot is None else split_hot(known, keys, hot)
    names = list(probs)
    small = ordinary.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(value)).alias("_q")).select(
        *keys, "n", *[_interpolated(F.col("_q"), probs[q]).alias(q) for q in names])
    if not keys:
        small = small.where("n > 0")
    if big is None:
        return small
    return small.unionByName(select_quantiles(value_counts(big, keys, value), keys, value, "n", probs))


def melt(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "feature",
         value: str = "value") -> DataFrame:
    """Wide to long with the measures as doubles."""
    casted = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return casted.unpivot(list(keep), list(columns), name, value)


def _medians_within(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """Exact medians of whole columns as one row (<c>_median, <c>_nulls), with no shuffle of the values.

    Sketches of two near ranks give bounds around each median; the values below them are counted, and only those between
    them (and their copies, counted) are put in order. None if some bounds miss, as they may with NaN.
    """
    off = 2 / ACCURACY
    made = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    seen = made.agg(*[F.count(c).alias(f"{c}_n") for c in columns], *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns],
                    *[F.percentile_approx(c, [0.5 - off, 0.5 + off], ACCURACY).alias(f"{c}_near") for c in columns]).first()
    near = {c: seen[f"{c}_near"] for c in columns if seen[f"{c}_n"]}
    found = {c: None for c in columns}
    if near:
        below = made.agg(*[F.count_if(F.col(c) < F.lit(low)).alias(c) for c, (low, _) in near.items()]).first()
        inside = made.select(*[F.when(F.col(c).between(F.lit(low), F.lit(high)), F.col(c)).alias(c) for c, (low, high) in near.items()])
        counts = value_counts(inside.where(F.coalesce(*near).isNotNull()).unpivot([], list(near), "feature", "value"), ["feature"], "value")
        upto = counts.withColumn("_upto", F.sum("n").over(_upto(["feature"], ["value"])))
        middle = {c: 0.5 * (seen[f"{c}_n"] - 1) for c in near}
        hit = F.lit(False)
        for c, at in middle.items():
            ranks = (F.col("_upto") > math.floor(at) - below[c]) & (F.col("_upto") - F.col("n") <= math.ceil(at) - below[c])
            hit = hit | ((F.col("feature") == c) & ranks)
        rows = upto.where(hit).collect()
        for c, at in middle.items():
            def value(rank: int):
                return next((r["value"] for r in rows if r["feature"] == c and r["_upto"] - r["n"] <= rank - below[c] < r["_upto"]), None)
            low, high = value(math.floor(at)), value(math.ceil(at))
            if low is None or high is None:
                return None
            found[c] = low + (high - low) * (at - math.floor(at))
    schema = T.StructType([T.StructField(f"{c}_median", T.DoubleType()) for c in columns] + [T.StructField(f"{c}_nulls", T.LongType()) for c in columns])
    return df.sparkSession.createDataFrame([(*found.values(), *[seen[f"{c}_nulls"] for c in columns])], schema)


def group_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """Exact medians of several columns per group, as <c>_median, with the null count as <c>_nulls."""
    keys, columns = list(keys), list(columns)
    hot_rows = hot_rows or _values_limit(keys)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns]
    known = df.dropna(subset=keys).select(*keys, *columns) if keys else df.select(*columns)
    hot = hot_groups(known, keys, hot_rows)
    whole = _medians_within(known, columns) if hot is ALL else None
    if whole is not None:
        return whole
    ordinary, big = (known, None) if hot is None else (None, known) if hot is ALL else split_hot(known, keys, hot)
    parts = []
    if ordinary is not None:
        lists = [F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(f"_{c}") for c in columns]
        parts.append(ordinary.groupBy(*keys).agg(*lists, *nulls).select(
            *keys, *[_interpolated(F.col(f"_{c}"), 0.5).alias(f"{c}_median") for c in columns], *[f"{c}_nulls" for c in columns]))
    if big is not None:
        counts = value_counts(melt(big, keys, columns), ["feature", *keys], "value")
        long = select_quantiles(counts, ["feature", *keys], "value", "n", {"median": 0.5})
        medians = long.groupBy(*keys).agg(*[
            F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"{c}_median") for c in columns])
        if keys:
            parts.append(big.groupBy(*keys).agg(*nulls).join(medians, keys, "left"))
        else:
            found = medians.select(F.struct(*medians.columns)).scalar()
            parts.append(big.agg(*nulls).withColumn("_m", found).select(
                *[f"_m.{c}_median" for c in columns], *[f"{c}_nulls" for c in columns]))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(*keys, *[f"{c}_median" for c in columns], *[f"{c}_nulls" for c in columns])


def fill_forward(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], columns: Sequence[str],
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Replace nulls by the last non-null value at or before the row, within keys."""
    keys, order_by, columns = list(keys), list(order_by), list(columns)
    hot = hot_groups(df, keys, hot_rows)
    ordinary, big = (df, None) if hot is None else (None, df) if hot is ALL else split_hot(df, keys, hot)
    parts = []
    if ordinary is not None:
        window = _upto(keys, order_by)
        parts.append(ordinary.select(*[
            F.last(c, ignorenulls=True).over(window).alias(c) if c in columns else F.col(c) for c in df.columns]))
    if big is not None:
        parts.append(_fill_by_chunk(big, keys, order_by, columns))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _fill_by_chunk(df: DataFrame, keys: list[str], order_by: list[str], columns: list[str]) -> DataFrame:
    chunks = order_chunks(df, keys + order_by)
    place = F.struct(*order_by)
    last_of_chunk = chunks.groupBy(*keys, CHUNK).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])
    carried = last_of_chunk.select(
        *keys, CHUNK, *[F.last(c, ignorenulls=True).over(_before(keys)).alias(f"_{c}_carried") for c in columns])
    inside = _upto([*keys, CHUNK], order_by)
    return _by_chunk(chunks, carried, keys).select(*[
        F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_{c}_carried")).alias(c) if c in columns else F.col(c)
        for c in df.columns])


def positions(df: DataFrame, order_by: Sequence[str], name: str = "position", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the zero-based position of each row in the global order, and the row count as <name>_total."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    numbered = prefix_sums(one, [], order_by, ["_one"], hot_groups(df, [], hot_rows))
    return numbered.select(*df.columns, (F.col("_one_upto") - 1).alias(name),
                           F.col("_one_total").alias(f"{name}_total"))
