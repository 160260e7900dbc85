"""Projection, typing and set helpers shared by every step."""

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


class MissingColumns(ValueError):
    pass


def require(df: DataFrame, columns: Iterable[str]) -> None:
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise MissingColumns(f"missing columns: {absent}")


def conform(df: DataFrame, wanted: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Keep the wanted columns that exist, in the given order; required ones must exist."""
    require(df, required)
    return df.select(*[c for c in wanted if c in df.columns])


# A decimal number, with or without an exponent; no type suffixes, no words such as NaN or Infinity.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(c: str | Column) -> Column:
    """Text to double; null for whatever is not a finite number."""
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def to_whole(c: Column, kind: T.DataType) -> Column:
    """Value to long; null for what is not a whole number or does not fit."""
    if isinstance(kind, T.StringType):
        text = F.trim(c)
        number = to_number(text)
        return F.coalesce(F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long")), F.when(number == F.floor(number), number.try_cast("long")))
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.when(c == F.floor(c), c.try_cast("long"))
    return c.try_cast("long")


def to_utc(c: str | Column) -> Column:
    return F.try_to_timestamp((F.col(c) if isinstance(c, str) else c).cast("string"))


def typed(df: DataFrame, ints: Sequence[str] = (), doubles: Sequence[str] = (), times: Sequence[str] = (),
          bools: Sequence[str] = ()) -> DataFrame:
    """Coerce the listed columns that exist; values that do not parse become null."""
    def cast(c: str) -> Column:
        kind = df.schema[c].dataType
        if c in ints:
            return to_whole(F.col(c), kind).alias(c)
        if c in doubles:
            return (to_number(c) if isinstance(kind, T.StringType) else F.col(c).try_cast("double")).alias(c)
        if c in times:
            return F.col(c) if isinstance(kind, T.TimestampType) else to_utc(c).alias(c)
        if c in bools:
            return F.col(c).try_cast("boolean").alias(c)
        return F.col(c)
    return df.select(*[cast(c) for c in df.columns])


def nulled(raw: DataFrame, **kinds: Sequence[str]) -> DataFrame:
    """(column_name, n): how many values typed(raw, **kinds) turns into null, for each coerced column. One pass."""
    columns = [c for c in raw.columns if c in {x for names in kinds.values() for x in names}]
    before = [F.col(c).alias(f"_raw_{c}") for c in columns]
    both = typed(raw.select(*columns, *before), **kinds)
    counts = both.agg(*[F.count_if(F.col(f"_raw_{c}").isNotNull() & F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "n")


def floor_hour(c: str | Column) -> Column:
    return F.date_trunc("hour", c)


def where_given(**equals) -> Column:
    """Conjunction of column = value for the arguments that are not None; true when there are none."""
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in equals.items() if v is not None], F.lit(True))


def any_present(columns: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()


def union_named(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str]) -> DataFrame:
    """First row per key in a total order. The rank limit is applied before the shuffle as well
    (WindowGroupLimit), so a key with many copies sends one row per task."""
    return top_per_key(df, keys, order_by, 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str], n: int,
                rank: str | None = None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    ranked = df.withColumn("_rank", place).where(F.col("_rank") <= n)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def limit_sessions(df: DataFrame, n: int, key: str = "session_key") -> DataFrame:
    """Rows of the first n sessions; 0 or less keeps all."""
    if not n or n <= 0:
        return df
    return df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def columns_missing(df: DataFrame, expected: Iterable[str]) -> list[str]:
    return sorted(set(expected) - set(df.columns))


def feature_columns(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(excluded)]
