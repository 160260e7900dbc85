"""Session settings, durable freezing of intermediate tables, and size-checked lookups."""

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# A lookup table is broadcast only when it is measured to be below this many bytes.
BROADCAST_BYTES = 128 * 1024 * 1024


def build_session(app: str = "lapforge", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder every executor shares.

    It is the one the cluster names in spark.checkpoint.dir. Only a local session without that
    setting gets a temporary one; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lapforge-checkpoint-"))
    return sc.getCheckpointDir()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, through the file system that its path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete what this application has frozen, stored and kept as stream state. Spark gives each application a folder of its
    own below spark.checkpoint.dir, and only that goes. For the end of a job: tables frozen before cannot be read after."""
    if spark.sparkContext.getCheckpointDir() is not None:
        delete_folder(spark, spark.sparkContext.getCheckpointDir())
    _built.clear()


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later steps neither recompute df nor lose it with
    an executor. For small tables, and for tables that are read whole once or twice."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back. For wide tables that many
    later steps read a few columns of."""
    path = fresh_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Approximate in-memory size: row count times fixed widths, plus the real length of text."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    per_row = 16 * len(df.columns) + 16
    lengths = [F.sum(F.coalesce(F.length(F.col(c)), F.lit(0))) for c in text]
    total = F.coalesce(sum(lengths, F.lit(0)), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), total.alias("chars")).first()
    return row["n"] * per_row + 4 * row["chars"]


def lookup(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Freeze a derived table and mark it for broadcast when its measured size allows it.

    Catalyst sizes an aggregate by its input, so without the check a fact table would be
    shuffled to meet a few hundred rows. Past the limit the plain table is returned and the
    join is a shuffle join, where AQE splits hot keys. Tables read straight from files need
    none of this: Catalyst knows their size.
    """
    frozen = freeze(df)
    return F.broadcast(frozen) if measured_bytes(frozen) <= limit else frozen


_built: dict[tuple[str, str, str], str] = {}


def built_once(spark: SparkSession, source: str, name: str, write: Callable[[str], None]) -> str:
    """Path of a table that this application derives from a source once: the first call writes it, later ones find it."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _built:
        path = fresh_path(spark, name)
        write(path)
        _built[key] = path
    return _built[key]
