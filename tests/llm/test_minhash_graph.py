"""SuperMinHash against the element-by-element algorithm, components and near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from lapforge.llm import minhash
from lapforge.llm.common import mixed
from lapforge.llm.graph import components
from lapforge.llm.hashing import shingle_set, word_hashes
from helpers import WORDS, frame, near_groups, odd_texts, prose, shingles


def element_by_element(elements, slots):
    """The sequential algorithm, without stopping early."""
    sig = [2**64 - 1] * slots
    for e in elements:
        place = list(range(slots))
        for j in range(slots):
            x = mixed(np.array([e], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            k = j + int((mixed(x)[0] >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32))
            place[j], place[k] = place[k], place[j]
            sig[place[j]] = min(sig[place[j]], (j << 56) | (int(x[0]) >> 8))
    return sig


@pytest.mark.parametrize("sizes", [[1, 2, 0, 5], [40, 300], [3000, 1, 700]])
def test_signatures(sizes):
    r = np.random.RandomState(3)
    sets = [np.unique(r.randint(0, 2**62, n).astype(np.uint64)) for n in sizes]
    sig = minhash.superminhash(sets, 16)
    for s, row in zip(sets, sig):
        assert row.tolist() == element_by_element(s.tolist(), 16)


def test_estimates_follow_similarity():
    r = np.random.RandomState(4)
    a = np.unique(r.randint(0, 2**62, 2000).astype(np.uint64))
    sig = minhash.superminhash([a, a[:1500], a[1000:]])
    assert abs((sig[0] == sig[1]).mean() - 0.75) < 0.12 and abs((sig[0] == sig[2]).mean() - 0.5) < 0.15


def test_words_and_shingles_like_plain_python():
    for text in (b"", b" ", b"a", b"a b\tc\x0bd\x0ce\rf\ng", b"x" * 3_000_000, ("wörd " * 400_000).encode(), b" lead and trail "):
        words = WORDS.findall(text)
        h = word_hashes(text)
        assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    for _, text, _ in odd_texts():
        assert len(shingle_set((text or "").encode(), 5)) == len(shingles(text))


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    up = {}
    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in up)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def changed(text, seed, share):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"new{r.randrange(10**6)}" for w in text.split(" "))


def test_near_duplicates_of_odd_documents(spark):
    rows = odd_texts()
    base = prose(50, 150)
    rows += [(1000 + k, changed(base, k, 0.005 * (k % 7)), "s") for k in range(60)]  # a family around the threshold
    rows += [(2000 + k, " ".join(base.split(" ")[k * 8:k * 8 + 110]), "s") for k in range(6)]  # a chain
    rows += [(7, rows[6][1], "s0")]  # a repeated row
    want = near_groups({i: t for i, t, _ in rows})
    got = minhash.near_duplicates(frame(spark, rows + [(None, base, "s")])).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            text = next(t for i, t, _ in rows if i == r["doc_id"])
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(shingles(text)), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0
