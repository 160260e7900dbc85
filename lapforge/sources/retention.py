"""Retention that deletes: a table by category and month loses the months past their age, and days within the month at the limit."""

from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lapforge.constants import RETENTION_DAYS
from lapforge.session import delete_folder
from lapforge.sources.sinks import retained

CATEGORY, MONTH = "category", "month"


def write_by_month(df: DataFrame, path: str, stamp: str, mode: str = "append") -> None:
    """df under category=<c>/month=<yyyy-MM>. Small months share a task, large ones are split."""
    rows = df.withColumn(MONTH, F.date_format(stamp, "yyyy-MM"))
    rows.hint("rebalance", CATEGORY, MONTH).write.mode(mode).partitionBy(CATEGORY, MONTH).parquet(path)


def read_by_month(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the table; schema is that of the rows as written, category included."""
    columns = [f for f in schema.fields if f.name != CATEGORY]
    parts = [T.StructField(CATEGORY, T.StringType()), T.StructField(MONTH, T.StringType())]
    return spark.read.schema(T.StructType([*columns, *parts])).parquet(path)


def partitions(spark: SparkSession, path: str) -> dict[tuple[str, str], str]:
    """Folder of each (category, month), from the names alone. Their number is that of categories times months."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{CATEGORY}=*/{MONTH}=*")
    found = [f.getPath() for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []]
    value = lambda folder: unquote(folder.getName().split("=", 1)[1])
    return {(value(f.getParent()), value(f)): f.toString() for f in found}


def purge(spark: SparkSession, path: str, schema: T.StructType, stamp: str, now: str, policy: Mapping[str, int] = RETENTION_DAYS) -> DataFrame:
    """Delete what `retained` would leave out, and return what was done: category, month, action, removed rows where known.

    A month whose last day is too old is dropped as a folder, unread. A month that the limit cuts is read: with no row left
    it is dropped, with all rows left it stays, otherwise it is written again by dynamic overwrite, which replaces it when
    all tasks are done. So a purge that is stopped and run again ends the same. Months of unknown categories are never read.
    Rows of a known category without a stamp have no age that could be inside the limit, and go.
    """
    folders = partitions(spark, path)
    wanted = [(c, m) for c, m in folders if c in policy]
    listed = spark.createDataFrame(wanted, f"{CATEGORY} string, {MONTH} string")
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in policy.items() for x in kv] or [F.lit(""), F.lit(0)]), F.col(CATEGORY))
    first = F.try_to_timestamp(F.concat(F.col(MONTH), F.lit("-01")), F.lit("yyyy-MM-dd"))
    day = F.to_date(F.lit(now))
    youngest, oldest = F.datediff(day, F.last_day(first)), F.datediff(day, first)
    state = F.when(first.isNull() | (youngest > limit), "dropped").when(oldest > limit, "cut").otherwise("kept")
    plan = [tuple(r) for r in listed.select(CATEGORY, MONTH, state.alias("state")).collect()]  # one row per folder
    done = [(c, m, "dropped", None) for c, m, s in plan if s == "dropped"]
    cut = spark.createDataFrame([(c, m) for c, m, s in plan if s == "cut"], f"{CATEGORY} string, {MONTH} string")
    table = read_by_month(spark, path, schema)
    # the limit's months are named in a filter, so that only their folders are read
    named = F.lit(False)
    for c, m, s in plan:
        if s == "cut":
            named = named | ((F.col(CATEGORY) == c) & (F.col(MONTH) == m))
    at_limit = table.where(named)
    kept = retained(at_limit, CATEGORY, stamp, now, policy)
    counts = at_limit.groupBy(CATEGORY, MONTH).agg(F.count(F.lit(1)).alias("n"))
    left = kept.groupBy(CATEGORY, MONTH).agg(F.count(F.lit(1)).alias("left"))
    judged = cut.join(counts, [CATEGORY, MONTH], "left").join(left, [CATEGORY, MONTH], "left").na.fill(0, ["n", "left"]).collect()
    rewrite = F.lit(False)
    for r in judged:
        if r["left"] == 0:
            done.append((r[CATEGORY], r[MONTH], "dropped", r["n"]))
        elif r["left"] < r["n"]:
            done.append((r[CATEGORY], r[MONTH], "rewritten", r["n"] - r["left"]))
            rewrite = rewrite | ((F.col(CATEGORY) == r[CATEGORY]) & (F.col(MONTH) == r[MONTH]))
    if any(action == "rewritten" for _, _, action, _ in done):
        kept.where(rewrite).hint("rebalance", CATEGORY, MONTH).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(CATEGORY, MONTH).parquet(path)
    for c, m, action, _ in done:
        if action == "dropped":
            delete_folder(spark, folders[c, m])
    return spark.createDataFrame(sorted(done, key=lambda r: r[:2]), f"{CATEGORY} string, {MONTH} string, action string, removed long")
