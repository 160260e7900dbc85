"""Shards, slots and mixes: laws that must hold, on odd tables too."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lapforge.llm.mixing import mix, mixed_copies, mixed_documents, permuted, source_targets
from lapforge.llm.sharding import shard_of, shard_records
from helpers import frame, odd_texts


@pytest.mark.parametrize("chunk_rows", [3, 1000])
def test_slots_are_gapless_and_keys_decide(spark, chunk_rows):
    rows = odd_texts() + [(None, "t", "s"), (None, "u", "s"), (4, "one two", "s2"), (4, "one two", "s2")]
    df = frame(spark, rows)
    out = shard_records(df, ["doc_id"], 5, order=[F.xxhash64("text")], chunk_rows=chunk_rows)
    got = out.collect()
    assert len(got) == len(rows) and set(df.columns) <= set(out.columns)
    slots, shard = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        shard[r["doc_id"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in shard.values())
    again = shard_records(df.repartition(7), ["doc_id"], 5).select("doc_id", "shard").distinct().collect()
    assert {r["doc_id"]: {r["shard"]} for r in again} == dict(shard)
    assert shard_records(df.limit(0), ["doc_id"], 5).count() == 0


def test_growth_moves_only_into_the_new_shard_and_weights_hold(spark):
    keys = spark.range(60_000)
    w = [1.0, 2.0, 5.0]
    r = keys.select(shard_of([F.col("id")], w).alias("a"), shard_of([F.col("id")], [*w, 2.0]).alias("b"), shard_of([F.col("id")], [1.0, 2.0, 6.0]).alias("c"))
    n = Counter(map(tuple, r.collect()))
    assert all(a == b or b == 3 for a, b, _ in n) and all(a == c or c == 2 for a, _, c in n)
    share = Counter()
    for (a, _, _), k in n.items():
        share[a] += k
    assert all(abs(share[s] / 60_000 - w[s] / 8) < 0.01 for s in range(3))
    with pytest.raises(ValueError):
        shard_of([F.col("id")], [1.0, 0.0])


def test_permutations_are_permutations(spark):
    for n in (1, 2, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit("s"))).collect()]
        assert sorted(got) == list(range(n)) and (n < 50 or got != list(range(n)))


def targets_by_loop(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(names)}
    fixed, free = {}, set(names)
    while True:
        left, w = share * sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in free)
        now = {s: left * weight[s] / w for s in free}
        over = {s for s in free if now[s] > most * sizes[s]}
        if not over:
            return {**fixed, **now}
        fixed |= {s: most * sizes[s] for s in over}
        free -= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 1, "b": 1, "c": 1}, {"x": 100}, {"a": 5, "é": 0, "b": 900, "c": 3, "d": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(targets_by_loop(sizes))


def test_mix_of_odd_documents(spark):
    rows = odd_texts() + [(4, "one two", "s2"), (4, "one two", "s2"), (None, "words of no id", "s2")]
    df = frame(spark, rows)
    documents, plan = mix(df, block_words=16)
    got = documents.collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"], r["size"], r["source"]) for r in got if r["doc_id"]) == sorted(((i, words(t), s) for i, t, s in rows if i), key=lambda x: (x[0], x[1]))
    total, taken = Counter(), Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        total[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = targets_by_loop(dict(total))
    assert all(abs(taken[s] - want[s]) <= 16 for s in want), (taken, want)
    slots = plan.collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots) and max(r["slot"] for r in slots) < 4096
    for s, n in Counter((r["source"], r["block"]) for r in slots).items():
        assert n <= 2 and s[1] < math.ceil(total[s[0]] / 16)
    again = mix(frame(spark, rows[::-1]).repartition(5), block_words=16)[0].collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_empty_and_wordless_mixes(spark):
    none = frame(spark, [(1, None, "a"), (2, " ", None)])
    assert [tuple(r)[2:6] for r in mix(none)[0].collect()] == [(0, 0, 0.0, 0)] * 2
    assert mix(none.limit(0))[0].count() == 0 and mixed_copies(none).count() == 0


def test_copies_follow_the_mix(spark):
    df = frame(spark, odd_texts())
    out = mixed_copies(df, block_words=8)
    assert out.columns == df.columns
    copies = Counter(r["doc_id"] for r in out.collect())
    for r in mix(df, block_words=8)[0].collect():
        assert copies[r["doc_id"]] == (math.floor(r["taken"] / r["size"] + 0.5) if r["size"] else 0)


@pytest.mark.parametrize("ratio", [0.3, 0.4, 0.8, 1.3])
def test_the_mixing_stage_meets_its_targets(spark, ratio):
    """Also for long documents over many blocks, whose taken / size are all close to the ratio of their source."""
    sizes = [40 + 7 * k % 300 for k in range(120)] + [2000 + 97 * k % 1900 for k in range(90)]
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(n)), f"s{i % 2}") for i, n in enumerate(sizes)]
    rows += [(None, "no id here", "s0"), (None, "none as well", "s0"), (500, "a b c", "s1"), (500, "a b c", "s1"), (501, " ", "s1")]
    df = frame(spark, rows)
    out = mixed_documents(df, weights=[1.0], share=ratio)
    assert out.columns == df.columns
    got = [(len(r["text"].split()), r["source"]) for r in out.collect()]
    target = {r["source"]: r["target"] for r in mix(df, weights=[1.0], share=ratio)[0].collect()}
    for s in target:
        assert abs(sum(n for n, x in got if x == s) - target[s]) <= max(sizes) + 128, (s, ratio)
    long = sum(n for n in sizes if n >= 2000)
    assert sum(n for n, _ in got if n >= 2000) == pytest.approx(ratio * long, rel=0.1)
    assert mixed_documents(df.limit(0)).count() == 0
