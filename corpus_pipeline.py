"""From raw documents to packed training sequences: five stages, each one of the text-preparation operators.

A stage is (name, function); the function takes (spark, documents, folder of the given tables) and returns a DataFrame,
which is written as Parquet and read again for the next one. All but the last return the columns of documents.

A stage begins by deleting what earlier operators of this application left in the shared folder, so what it returns is to
be written before the next stage is called.
"""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapforge.llm import minhash, mixing, packing, suffixes, toxicity
from lapforge.llm.common import delete_folder, drop_stored, free_name, short_lived_shuffles, stored, table
from lapforge.llm.queries import tokenizer
from lapforge.session import fresh_path


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        drop_stored(spark)
        return fn(spark, docs, folder)
    return run_stage


@stage
def toxic_out(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    index = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, index, docs.columns).where("predicted = 0").select(docs.columns)


@stage
def near_copies_out(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; rows without an id stay."""
    i, n = free_name(docs, "kept_id"), free_name(docs, "n")
    kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(i)).agg(F.count("*").alias(n))
    kept = stored(kept, "kept")
    out = docs.join(kept, docs["doc_id"] == kept[i])
    if kept.where(F.col(n) > 1).limit(1).count():  # only then do rows have to be told apart, which takes another shuffle of texts
        out = out.where(F.col(n) == 1).unionByName(out.where(F.col(n) > 1).dropDuplicates(["doc_id"]))
    return out.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


@stage
def repeats_out(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """100-byte strings that occur earlier are cut out, in whole characters."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    # carried columns travel under names of their own, so they clash with none of the operator's
    safe = {c: f"carried_{k}" for k, c in enumerate(others)}
    cut = suffixes.kept_bytes(docs.withColumnsRenamed(safe), carry=list(safe.values()), whole_characters=True)
    text = F.col("kept").cast("string")
    made = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long"), **{c: F.col(x) for c, x in safe.items()}}
    return cut.select(*[made[c].alias(c) for c in docs.columns])


@stage
def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document in whole copies, so that each source keeps the words that the mix takes from it."""
    safe = {c: f"carried_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    return mixing.mixed_documents(docs.withColumnsRenamed(safe)).withColumnsRenamed({x: c for c, x in safe.items()}).select(docs.columns)


@stage
def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token sequences: pieces of documents with their ids, sequence and place in it."""
    return packing.pack_documents(docs, tokenizer(), special_tokens=True)


STAGES = [
    ("toxicity", toxic_out),
    ("minhash near-dedup", near_copies_out),
    ("suffix-array dedup", repeats_out),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

# Training, signatures and the tokenizer are outside of SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of folder. What a stage leaves behind is deleted when the next one's table is written."""
    docs, last = table(spark, folder, "documents"), None
    for name, apply in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        out = apply(spark, docs, folder)
        with short_lived_shuffles(spark):
            out.write.parquet(path)
        if last:
            delete_folder(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), path
    drop_stored(spark)
    return docs
