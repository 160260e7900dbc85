"""Star schema: dimension and fact shaping, declared constraints as checks."""

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lapforge import schemas
from lapforge.constants import LAP_KEY, SOURCE_FILE, TARGET
from lapforge.operators.ordered import HOT_ROWS, split_hot
from lapforge.operators.shape import first_per_key, require, to_utc, union_named
from lapforge.session import lookup

# The order in which stored facts lie.
PLACE = ["year", "circuit_key", "session_key", "driver_number", "lap_number"]


def interval(c: str | Column) -> Column:
    """'03:00:00' or '-05:30:00' as a day-time interval; null when it is not of that form."""
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    part = lambda i: F.regexp_extract(text, r"^([+-]?)(\d{1,2}):(\d{2}):(\d{2})$", i)
    sign = F.when(part(1) == "-", -1).otherwise(1)
    seconds = part(2).try_cast("int") * 3600 + part(3).try_cast("int") * 60 + part(4).try_cast("int")
    return F.make_dt_interval(secs=(sign * seconds).cast("decimal(18,6)"))


def _cast(df: DataFrame, field: T.StructField) -> Column:
    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType).alias(field.name)
    c = F.col(field.name)
    have = df.schema[field.name].dataType
    if isinstance(field.dataType, T.TimestampType):
        out = c if isinstance(have, T.TimestampType) else to_utc(c)
    elif isinstance(field.dataType, T.DayTimeIntervalType):
        out = c if isinstance(have, T.DayTimeIntervalType) else interval(c)
    elif isinstance(field.dataType, T.StringType):
        out = F.nullif(c.cast("string"), F.lit(""))
    else:
        out = F.nullif(c, F.lit("")).try_cast(field.dataType) if isinstance(have, T.StringType) else c.try_cast(field.dataType)
    return out.alias(field.name)


def _keyed(df: DataFrame, name: str, order_by: Sequence[str | Column]) -> tuple[DataFrame, list[str | Column]]:
    """The columns that matter, and the order of a key's rows: order_by, then content.

    Keys are cast before rows are compared, and so are fractions that the table holds as decimals: those are narrower in a
    shuffle. Everything else is cast only for the rows that stay.
    """
    schema, keys = schemas.STAR[name], schemas.STAR_KEYS[name]

    def early(c: str) -> bool:
        fraction = c in schema.fieldNames() and isinstance(schema[c].dataType, T.DecimalType) and isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        return c in keys or (fraction and c not in order_by)

    keyed = df.select(*[_cast(df, schema[c]) if early(c) else F.col(c) for c in df.columns if c in schema.fieldNames() or c in order_by])
    return keyed, [*order_by, *[c for c in keyed.columns if c in schema.fieldNames() and c not in keys]]


def _loaded(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[_cast(df, f) for f in schemas.STAR[name].fields])


def load_table(df: DataFrame, name: str, required: Sequence[str] = (), order_by: Sequence[str | Column] = ()) -> DataFrame:
    """Columns and types of the declared table, one row per primary key (first in order_by, then
    by content). Empty text is null, missing columns are null."""
    keys = schemas.STAR_KEYS[name]
    require(df, list(required) or keys)
    keyed, order = _keyed(df, name, order_by)
    return _loaded(first_per_key(keyed, keys, order), name)


def dim_circuits(sessions: DataFrame, order_by=("year", "meeting_key", "session_key")) -> DataFrame:
    need = ["circuit_key", "circuit_short_name", "location", "country_name", "country_code"]
    usable = [c for c in order_by if c in sessions.columns]
    return load_table(sessions.dropna(subset=["circuit_key"]), "dim_circuits", need, usable)


def dim_drivers(drivers: DataFrame, order_by=("session_key",)) -> DataFrame:
    usable = [c for c in order_by if c in drivers.columns]
    return load_table(drivers.dropna(subset=["driver_number"]), "dim_drivers", ["driver_number"], usable)


def dim_sessions(scope: DataFrame) -> DataFrame:
    return load_table(scope.dropna(subset=["session_key"]), "dim_sessions",
                      ["session_key", "meeting_key", "year", "circuit_key"], ["date_start"] if "date_start" in scope.columns else [])


def _scattered(keyed: DataFrame, hot_rows: int) -> tuple[DataFrame | None, int]:
    """(sessions in more than one year or circuit, or with more than hot_rows laps; None when there are none), and the number of laps."""
    per = keyed.groupBy("session_key", "year", "circuit_key").agg(F.count(F.lit(1)).alias("_rows"))
    sessions = lookup(per.groupBy("session_key").agg(F.count(F.lit(1)).alias("_places"), F.sum("_rows").alias("_rows")))
    odd = sessions.where((F.col("_places") > 1) | (F.col("_rows") > hot_rows))
    found = sessions.agg(F.count_if((F.col("_places") > 1) | (F.col("_rows") > hot_rows)).alias("odd"), F.sum("_rows").alias("rows")).first()
    return (lookup(odd.select("session_key")) if found["odd"] else None), found["rows"] or 0


def fact_laps(dataset: DataFrame, order_by: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Laps with a target, one per 4-column key, ranged by PLACE. The key is checked before the target, so a key
    whose first row has no target has no row.

    A session usually lies in one year and circuit. Its laps are ranged by place as they come, which brings equal keys together and
    is the order to store them in: one shuffle does both, and nothing is sorted before it. Sessions of several places, and hot
    ones, go through load_table, which sends one row per key and task, and are ranged after it.
    """
    if SOURCE_FILE in dataset.columns:
        dataset = dataset.withColumnRenamed(SOURCE_FILE, "source_file")
    required = LAP_KEY + ["year", "circuit_key", TARGET]
    require(dataset, required)
    keyed, order = _keyed(dataset, "fact_laps", order_by)
    odd, rows = _scattered(keyed, hot_rows)
    ordinary, rest = (keyed, None) if odd is None else split_hot(keyed, ["session_key"], odd)
    own = int(dataset.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = math.ceil(rows / HOT_ROWS)
    ranged = ordinary.repartitionByRange(*([tasks] if tasks > own else []), *PLACE)
    loaded = _loaded(first_per_key(ranged, [*LAP_KEY, "year", "circuit_key"], order), "fact_laps")
    if rest is not None:
        loaded = loaded.unionByName(load_table(rest, "fact_laps", required, order_by).repartitionByRange(*PLACE))
    return loaded.where(F.col(TARGET).isNotNull())


def load_star(dataset: DataFrame, sessions: DataFrame, drivers: DataFrame) -> dict[str, DataFrame]:
    return {"dim_circuits": dim_circuits(sessions), "dim_drivers": dim_drivers(drivers),
            "dim_sessions": dim_sessions(sessions), "fact_laps": fact_laps(dataset)}


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_named([df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows")
                        for n, df in tables.items()])


def load_summary(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count(F.lit(1)).alias("total_laps"), F.countDistinct("session_key").alias("sessions"),
        F.countDistinct("driver_number").alias("drivers"), F.min("year").alias("min_year"),
        F.max("year").alias("max_year"), F.round(F.avg(TARGET).cast("double"), 3).alias("avg_lap_duration"),
        F.count_if(F.col("temp").isNull()).alias("missing_temp"))


def orphans(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Number of rows whose non-null reference has no parent, as one row. References are counted
    per value first, so a hot value is one row in the join."""
    used = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return used.join(parent.select(column).distinct(), column, "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))


def constraint_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per declared constraint with the number of violating rows.

    The row-level constraints of a table share one pass; keys and references are counted per value.
    """
    ranges = {"fact_laps": ("0 < lap_duration < 3600", (F.col(TARGET) > 0) & (F.col(TARGET) < 3600)),
              "dim_sessions": ("year 2020-2030", F.col("year").between(2020, 2030)),
              "dim_drivers": ("driver_number > 0", F.col("driver_number") > 0)}
    parts = []
    for name, df in tables.items():
        nulls = reduce(or_, [F.col(c).isNull() for c in schemas.STAR_NOT_NULL[name]])
        long = reduce(or_, [F.coalesce(F.length(c) > n, F.lit(False)) for c, n in schemas.STAR_LENGTHS[name].items()
                            if c in df.columns], F.lit(False))
        counts = {f"{name}: not null": F.count_if(nulls), f"{name}: text length": F.count_if(long)}
        if name in ranges:
            label, holds = ranges[name]
            counts[f"{name}: {label}"] = F.count_if(~F.coalesce(holds, F.lit(True)))
        row = df.agg(*[c.alias(n) for n, c in counts.items()])
        parts.append(row.unpivot([], [F.col(f"`{n}`") for n in counts], "constraint_name", "violations"))
        per_key = df.groupBy(*schemas.STAR_KEYS[name]).agg(F.count(F.lit(1)).alias("n"))
        parts.append(per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(
            F.lit(f"{name}: primary key").alias("constraint_name"), "violations"))
    for child, column, parent in schemas.STAR_REFERENCES:
        parts.append(orphans(tables[child], column, tables[parent]).select(
            F.lit(f"{child}.{column} -> {parent}").alias("constraint_name"), "violations"))
    return union_named(parts)
