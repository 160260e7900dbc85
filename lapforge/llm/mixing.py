"""Mixing sources to target weights, in blocks of words.

A source's words, document after document, are packed into blocks of block_words (a document may span blocks). Output
shards of shard_slots slots each draw their source counts from one multinomial distribution: every slot draws a source,
by its hash. The j-th slot of a source holds block p(j mod n) of its n blocks, where p is a pseudorandom permutation for
that source and epoch (swap-or-not shuffle), so each epoch takes every block once, in an order that can be computed from
the index. Draws beyond a source's quota go to sources that fell short, so each source gets its quota exactly.
Native expressions only.
"""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapforge.llm.common import WORD, free_name, numbered, partitions_for, running, stored
from lapforge.session import lookup

WEIGHTS = [5.0, 2.0, 1.0]
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
ROUNDS = 16
UNIT_BITS = 30
SEED = 2024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of sizes (source, size): share of all words, dealt by weight, none above most times its size.

    Sources get the weights in turn, in code-point order, null last. What would exceed a source's limit goes to the others by
    weight, until none is above: with limits met in the order of limit / weight, that level is the first one that no
    further source falls below. One row per source is all that is ordered here.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    t = totals.withColumn("weight", F.element_at(cycle, (F.pmod(turn, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("limit") / F.col("weight"))
    lowest = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everyone = lowest.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = F.sum(F.col("source_size")).over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("place", F.row_number().over(lowest)).withColumn("level", rest / weight_left)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everyone)
    return t.withColumn("level", first["level"]).select(
        "source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def permuted(index: Column, n: Column, *seed: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 at index: in each round a number and its mirror swap, or not, by a hash."""
    def swap(x, r):
        mirror = F.pmod(F.pmod(F.xxhash64(*seed, r), n) - x, n)
        coin = F.xxhash64(*seed, r, F.greatest(x, mirror)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, mirror).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, swap)


def _located(df: DataFrame, at: str, parts: DataFrame, total: int, cells: int) -> DataFrame:
    """df joined to the part (with `lo`, `hi`) whose half-open interval holds df[at], 0 <= at < total. An equi-join on the
    grid cell; a part lies in as many cells as it spans, so parts + cells rows in all."""
    width = max(1, math.ceil(total / max(1, cells)))
    spread = parts.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    df = df.withColumn("cell", F.floor(F.col(at) / width))
    return df.join(lookup(spread), "cell").where((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("cell", "lo", "hi")


def draw_slots(quotas: DataFrame, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, source_key, nth): which source fills each output slot, and its how manieth it is.

    quotas (source_key, blocks, quota): one row per source. Each source gets exactly its quota.
    """
    spark = quotas.sparkSession
    row = quotas.agg(F.sum("quota").alias("slots"), F.count("*").alias("sources")).first()
    total, sources = row["slots"] or 0, row["sources"]
    upto = F.sum("quota").over(W.orderBy("source_key").rowsBetween(W.unboundedPreceding, W.currentRow))
    parts = quotas.select("source_key", "quota", (upto - F.col("quota")).alias("lo"), upto.alias("hi"))
    slots = spark.range(0, total, 1, partitions_for(spark, total, 1_000_000)).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), (F.col("id") % shard_slots).alias("slot"))
    slots = slots.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.lit(max(1, total))))
    drawn = stored(_located(slots, "u", parts, total, 4 * sources).drop("u"), "draws")
    place = [F.col("shard"), F.col("slot")]
    drawn = numbered(drawn, ["source_key"], place, F.xxhash64("shard"), "nth")
    counts = drawn.groupBy("source_key").agg(F.count("*").alias("got"))
    short = quotas.join(counts, "source_key", "left").select(
        "source_key", F.least(F.coalesce("got", F.lit(0)), F.col("quota")).alias("kept"),
        F.greatest(F.col("quota") - F.coalesce("got", F.lit(0)), F.lit(0)).alias("missing"))
    upto = F.sum("missing").over(W.orderBy("source_key").rowsBetween(W.unboundedPreceding, W.currentRow))
    short = short.withColumn("hi", upto).withColumn("lo", upto - F.col("missing"))
    missing = short.agg(F.sum("missing")).first()[0] or 0
    kept = drawn.where(F.col("nth") < F.col("quota")).select("shard", "slot", "source_key", "nth")
    spare = drawn.where(F.col("nth") >= F.col("quota")).select("shard", "slot", F.lit(0).alias("one"))
    spare = numbered(spare, ["one"], place, F.xxhash64("shard", "slot"), "at").drop("one")
    moved = _located(spare, "at", short.withColumn("start", F.col("lo")), missing, 4 * sources)
    return kept.unionByName(moved.select("shard", "slot", "source_key", (F.col("kept") + F.col("at") - F.col("start")).alias("nth")))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[float] = WEIGHTS,
        share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, plan) of a mix.

    documents: one row per row of df: id_col, source_col, size, source_size, target, taken, first_word (place of its first word in its source's stream).
    plan: shard, slot, source_col, block, nth: slot of a shard holds words block * block_words ... of the source's stream.
    Null text: size 0. Null source: a source of its own, last in order. Repeated rows: each counts, each gets its own words.
    No words at all, or an empty table: targets are 0 and the plan is empty. A block is taken at most ceil(most) times.
    The same rows give the same result, however they are partitioned. Extra columns are not used.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                     F.xxhash64(text_col).alias("text_hash"))
    rows = stored(rows, "sizes")
    targets = source_targets(rows, weights, share, most)
    targets = targets.withColumn("source_key", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))))
    targets = targets.withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    filled = F.col("source_size") / F.col("blocks")
    targets = stored(targets.withColumn("quota", F.when(F.col("blocks") > 0, F.round(F.col("target") / filled)).otherwise(0).cast("long")), "targets")
    slots = draw_slots(targets.select("source_key", "blocks", "quota"), seed)
    known = lookup(targets.select("source", "source_key", "blocks"))
    epoch = F.floor(F.col("nth") / F.col("blocks"))
    plan = slots.join(known, "source_key").withColumn("block", permuted(
        F.col("nth") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("source_key"), epoch))
    plan = stored(plan.select("shard", "slot", "source", "source_key", "block", "nth"), "plan")
    placed = running(rows, ["source"], [F.col("id"), F.col("text_hash"), F.col("size")], F.xxhash64("id", "text_hash"), F.col("size"), "first_word")
    last = F.col("first_word") + F.col("size") - 1
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first_word") / block_words), F.floor(last / block_words)))
    told = lookup(targets.select(F.col("source").alias("of"), "source_key", "source_size", "target"))
    placed = placed.join(told, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    # Repeated rows share a place only if they have no words.
    parts = placed.withColumn("block", F.explode_outer(spans)).withColumn(
        "inside", F.least(last + 1, (F.col("block") + 1) * block_words) - F.greatest(F.col("first_word"), F.col("block") * block_words))
    takes = plan.groupBy("source_key", "block").agg(F.count("*").alias("times"))
    words = parts.join(takes, ["source_key", "block"], "left")
    some = words.where("size > 0").groupBy("id", "source", "size", "source_size", "target", "first_word").agg(
        F.sum(F.col("inside") * F.coalesce("times", F.lit(0))).alias("taken"))
    none = words.where("size = 0").select(*some.columns[:-1], F.lit(0).cast("long").alias("taken"))
    documents = some.unionByName(none).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                                              F.col("taken").cast("long").alias("taken"), "first_word")
    return documents, plan.withColumnRenamed("source", source_col).drop("source_key")


def mixed_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """df with each document as often as the mix takes it, in whole copies (taken / size, halves up): none, one or two.

    Documents without words are left out. Rows that repeat are told apart by their place in the source's stream only.
    """
    documents, _ = mix(df, id_col, text_col, source_col, **options)
    copies = documents.where("size > 0").groupBy(id_col, source_col, "size").agg(
        F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).alias("copies"), F.count("*").alias("rows"))
    key, src, size, times = (free_name(df, f"mix_{c}") for c in ("id", "source", "size", "copies"))
    copies = copies.select(F.col(id_col).alias(key), F.col(source_col).alias(src), F.col("size").alias(size),
                           F.ceil(F.col("copies") / F.col("rows")).cast("int").alias(times)).where(F.col(times) > 0)
    met = df.join(copies, df[id_col].eqNullSafe(copies[key]) & df[source_col].eqNullSafe(copies[src]) & (word_count(df[text_col]) == copies[size]))
    return met.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*(df[c] for c in df.columns))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """df with each document in whole copies, so many that each source keeps the words that the mix takes from it.

    A source's documents stand in order of size, their taken / size are summed, and a document gets a copy for each whole
    number (and a half) that the sum passes. So a source's words differ from those taken by at most its longest document (in a
    source of over 200,000 documents, for each so many), and long documents are kept in the same proportion as short ones.
    Documents without words are left out. Rows that share id, source and size share their copies out evenly.
    """
    documents, _ = mix(df, id_col, text_col, source_col, **options)
    share = F.floor(F.col("taken") / F.col("size") * (1 << UNIT_BITS))
    shares = stored(documents.where("size > 0").select(F.col(id_col).alias("mix_id"), F.col(source_col).alias("mix_source"),
                                                       F.col("size").alias("mix_size"), "first_word", share.alias("share")), "shares")
    placed = running(shares, ["mix_source"], [F.col("mix_size"), F.col("mix_id"), F.col("first_word")], F.xxhash64("mix_id", "first_word"),
                     F.col("share"), "before")
    passed = lambda x: F.shiftright(x + (1 << UNIT_BITS - 1), UNIT_BITS)
    copies = placed.groupBy("mix_id", "mix_source", "mix_size").agg(
        F.sum(passed(F.col("before") + F.col("share")) - passed(F.col("before"))).alias("mix_copies"), F.count("*").alias("mix_rows"))
    # columns of any name stand beside the operator's
    key, src, size, times, alike = (free_name(df, f"mix_{c}") for c in ("id", "source", "size", "copies", "rows"))
    copies = copies.where("mix_copies > 0").withColumnsRenamed({"mix_id": key, "mix_source": src, "mix_size": size, "mix_copies": times, "mix_rows": alike})
    copies = stored(copies, "copies")

    def met(of: DataFrame) -> DataFrame:
        return df.join(of, df[id_col].eqNullSafe(of[key]) & df[source_col].eqNullSafe(of[src]) & (word_count(df[text_col]) == of[size]))

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*df.columns)

    out = repeated(met(copies.where(F.col(alike) == 1)))
    if copies.where(F.col(alike) > 1).limit(1).count():  # only then do rows have to be numbered, which takes another shuffle of texts
        several, nth = met(copies.where(F.col(alike) > 1)), free_name(df, "mix_nth")
        several = numbered(several, [key, src, size], [F.xxhash64(text_col)], F.xxhash64(text_col), nth)
        each = F.floor(F.col(times) / F.col(alike)) + (F.col(nth) < F.col(times) % F.col(alike)).cast("int")
        out = out.unionByName(repeated(several.withColumn(times, each).where(F.col(times) > 0)))
    return out
