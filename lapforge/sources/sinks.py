"""Writers: step outputs, incremental sessions, star tables, reports, retention."""

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapforge.constants import RETENTION_DAYS


def write_step(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
               mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def pending(df: DataFrame, done: DataFrame, key: str = "session_key") -> DataFrame:
    """Rows of the sessions that are not in the output yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def write_sessions(df: DataFrame, path: str, overwrite: bool = False, key: str = "session_key") -> None:
    """One partition per session. Without overwrite, sessions already written are left alone;
    with it, only the partitions of the sessions in df are replaced.

    The rebalance hint lets AQE gather small sessions and split a large one over several tasks.
    """
    if overwrite:
        df.hint("rebalance", F.col(key)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
        return
    done = written_keys(df.sparkSession, path, key)
    todo = df if done is None else pending(df, done, key)
    todo.hint("rebalance", F.col(key)).write.mode("append").partitionBy(key).parquet(path)


def written_keys(spark: SparkSession, path: str, key: str = "session_key") -> DataFrame | None:
    """Keys present at path, or None when nothing was written yet."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path).select(key).distinct()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_star(tables: Mapping[str, DataFrame], folder: str, mode: str = "overwrite", placed: bool = False) -> None:
    """Dimensions are replaced; facts are replaced or appended, partitioned by year and clustered
    by circuit inside a year so that Parquet statistics prune circuit lookups. placed: facts are ranged already, as
    star.fact_laps returns them, and need no other shuffle."""
    for name, df in tables.items():
        path = f"{folder}/{name}"
        if name == "fact_laps":
            ranged = df if placed else df.repartitionByRange("year", "circuit_key", "session_key", "driver_number", "lap_number")
            ranged.sortWithinPartitions("year", "circuit_key", "session_key") \
                .write.mode(mode).partitionBy("year").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)


def missing_tables(spark: SparkSession, expected: Sequence[str]) -> list[str]:
    return sorted(t for t in expected if not spark.catalog.tableExists(t))


def report_table(report: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Step report: counters of the sessions that went through, and one row per failed session."""
    ok = report.withColumn("ok", F.lit(True)).withColumn("error", F.lit(None).cast("string"))
    if failed is None:
        return ok
    first = failed.groupBy("session_key").agg(F.min("error").alias("error")).withColumn("ok", F.lit(False))
    good = ok.join(first.select("session_key"), "session_key", "left_anti")
    return good.unionByName(first, allowMissingColumns=True)


def manifest(report: DataFrame, **parameters) -> dict:
    row = report.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_ko")).first()
    return {**parameters, "n_sessions": row["n_ok"] + row["n_ko"], "n_ok": row["n_ok"], "n_ko": row["n_ko"]}


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """A small JSON file next to the step's output, through Spark's own file system."""
    text = json.dumps(content, ensure_ascii=False, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def retained(df: DataFrame, category: str, stamp: str, now: str | None = None,
             policy: Mapping[str, int] = RETENTION_DAYS) -> DataFrame:
    """Rows whose category is still inside its retention window. An unknown category is kept."""
    at = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in policy.items() for x in kv]), F.col(category))
    age = F.datediff(at, F.col(stamp))
    return df.where(limit.isNull() | (age <= limit))
