"""Trees, places and proofs against a plain tree over sorted rows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lapforge.llm import manifest
from lapforge.llm.manifest import Ranks, digest, fold, hexes, packed, reduced

H = digest


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, i):
    """(sibling or None, whether it is to the left) up to the top."""
    return [(level[i >> k ^ 1] if i >> k ^ 1 < len(level) else None, bool(i >> k & 1)) for k, level in enumerate(levels[:-1])]


def climb(node, steps):
    for other, left in steps:
        node = H(node) if other is None else H(other, node) if left else H(node, other)
    return node


def plain(rows):
    """(id, group, position, leaf, subroot, root, proof, folded, verified) for rows (id, group, n)."""
    groups = {}
    for i, g, n in rows:
        claim = H(field(i), field(g), field(n + 1)) if n is not None and n % 3 == 0 else None
        groups.setdefault(g, []).append((i is not None, i or 0, H(field(i), field(g), field(n)), i, claim))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for pos, (_, _, leaf, i, claim) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = way(trees[g], pos) + way(top, at)
            folded = climb(claim or leaf, steps)
            out.append((i, g, pos, leaf, trees[g][-1][0], top[-1][0], H(*(s for s, _ in steps if s)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def by_spark(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "id long, lang string, n long").repartition(5)
    if clash:
        df = df.withColumns({c: F.lit("x") for c in ("g", "leaf", "claimed", "pos", "total", "bucket", "low", "chunk", "salt", "copies", "start", "same")})
    leaf = manifest.leaf(F.col("id"), F.col("lang"), F.col("n"))
    claim = F.when(F.col("n") % 3 == 0, manifest.leaf(F.col("id"), F.col("lang"), F.col("n") + 1))
    out = manifest.manifest(df, "id", "lang", leaf, claim)
    return sorted((tuple(r) for r in out.drop("siblings").collect()), key=repr)


def odd_rows():
    r = random.Random(1)
    rows = [(i, "en", i) for i in range(9000)]  # three arrays; the last one short
    rows += [(i * 7919 - 10**6, "fr", r.randrange(100)) for i in range(300)]  # sparse and negative ids
    rows += [(r.randrange(-2**63, 2**63), None, 4) for _ in range(50)]
    rows += [(5, "de", k % 7) for k in range(400)] + [(None, "de", k % 3) for k in range(40)] + [(6, "de", 1), (4, "de", None)]  # shared and missing ids, copies
    rows += [(1, "é", 2)] + [(1, "", 2)] + [(2**63 - 1, "z", 0), (-2**63, "z", 0), (65535, "z", 1), (65536, "z", 1), (65535, "z", 1)]
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    assert by_spark(spark, rows) == plain(rows)


def test_one_row_and_no_rows(spark):
    assert by_spark(spark, [(None, None, None)]) == plain([(None, None, None)])
    assert by_spark(spark, []) == []


def test_many_groups(spark):
    rows = [(k, f"g{k % 5000}", k) for k in range(6000)]
    assert by_spark(spark, rows, clash=False) == plain(rows)


def test_hot_bitmaps_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(manifest, "SALT_ROWS", 20)
    monkeypatch.setattr(manifest, "CHUNK_ROWS", 30)
    monkeypatch.setattr(manifest, "HOT_ROWS", 50)
    rows = [(7, "en", k) for k in range(300)] + [(k, "en", 3) for k in range(200)] + [(2**40 + k % 3, "fr", k) for k in range(200)]
    assert by_spark(spark, rows) == plain(rows)


def test_siblings_are_the_proof(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(21)], "id long, lang string")
    out = manifest.manifest(df, "id", "lang", manifest.leaf(F.col("id")), siblings=True).collect()
    assert all(hashlib.sha256(r.siblings.encode()).hexdigest() == r.proof_sha256 and r.verified and len(r.siblings) % 64 == 0 for r in out)
    assert all(r.leaf == hashlib.sha256(field(r.id).encode()).hexdigest() for r in out) and len({r.root for r in out}) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 65535)), max_size=4), st.booleans())
def test_ranks(sets, dense):
    if dense:
        sets = [*sets, set(range(100, 9000))]
    ranks, members = Ranks([packed(np.array(sorted(s), np.int64)) for s in sets]), sorted(set().union(*sets)) if sets else []
    x = np.array([0, 1, 63, 64, 65535, *members[:50]], np.int64)
    assert ranks.below(x).tolist() == [sum(m < v for m in members) for v in x.tolist()]
    assert ranks.has(x).tolist() == [v in set(members) for v in x.tolist()]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 4095, 4096])
def test_a_single_array_ends_in_its_root(n):
    nodes = [H(str(k)) for k in range(n)]
    assert reduced(nodes, n) == tree(nodes) and hexes(bytes.fromhex("".join(nodes))) == nodes


def test_one_of_several_arrays_goes_up_twelve_levels():
    levels = reduced([H("x")], 4097)
    assert len(levels) == 13 and fold(H("x"), "-" * 12, "") == levels[-1][0]
