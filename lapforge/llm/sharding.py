"""Rendezvous (highest random weight) sharding of stable record keys."""

from pyspark.sql import Column, DataFrame, functions as F

from lapforge.llm.common import numbered


def _draw(key: list[Column], shard: int, weight: float) -> Column:
    """The exponential race of one shard: -ln(u) / weight, u from the 53 top bits of a hash of key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(shard)), 11)
    u = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0 ** -53)
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("race"), F.lit(shard).alias("shard"))


def shard_of(key: list[Column], weights: list[float]) -> Column:
    """The shard whose race is won. Key and weights decide; a new shard takes keys only into itself, and a changed
    weight moves keys only into or out of that shard. Expected shares are proportional to the weights."""
    if any(w <= 0 for w in weights) or not weights:
        raise ValueError("weights must be positive")
    races = [_draw(key, s, w) for s, w in enumerate(weights)]
    return (F.array_min(F.array(*races)) if len(races) > 1 else races[0])["shard"]


def shard_records(df: DataFrame, key: list[str], shards: int, weights: list[float] | None = None,
                  out: str = "shard", slot: str = "slot", order: list[Column] | None = None,
                  chunk_rows: int = 20_000) -> DataFrame:
    """df with `out`, the shard (0 .. shards - 1), and `slot`, a gapless place from 0 in the shard.

    The shard is map-only. The slot needs one shuffle, in which a shard is split into chunks by key.
    Null keys: a key like any other (all rows with the same null pattern share a shard). Repeated rows: same shard,
    own slots. Empty table: no rows. `out` and `slot` replace columns of the same name.
    """
    df = df.drop(out, slot).withColumn(out, shard_of([F.col(k) for k in key], weights or [1.0] * shards))
    ties = order or []
    return numbered(df, [out], [*(F.col(k) for k in key), *ties], F.xxhash64(*(F.col(k) for k in key), *ties), slot, chunk_rows)
