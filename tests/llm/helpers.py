"""Fixtures by hand and plain re-computations to compare with."""

import random
import re

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
CLASHING = {"chunk": "x", "doc": "x", "n": "x", "a": "x", "b": "x", "id": "x", "tie": "x", "size": "x", "block": "x", "shard": "x", "slot": "x",
            "kept": "x", "score": "x", "predicted": "x", "sequence_id": "x", "offset": "x", "length": "x", "piece": "x", "carried": "x",
            "kept_id": "x", "spans": "x", "mix_id": "x", "mix_copies": "x", "head": "x", "of": "x", "before": "x", "nth": "x", "carried_0": "x"}


def prose(seed: int, words: int, names: int = 3000) -> str:
    r = random.Random(seed)
    return " ".join(f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.randrange(names)}" for _ in range(words))


def odd_texts() -> list[tuple]:
    """(doc_id, text, source): nulls, blanks, one very long text, near and exact copies, a passage that many share."""
    shared = prose(1, 60)
    base = prose(2, 120)
    rows = [(1, None, "s1"), (2, "", "s1"), (3, " \t\n", None), (4, "one two", "s2"), (5, "One TWO", "s2"), (6, base, "s0"), (7, base, "s0"),
            (8, base.replace(" ", "\n", 3), "s0"), (9, base + " tail end", None), (10, prose(3, 30_000), "s0"), (11, "é" * 300, "s1"),
            (12, "x" + "é" * 300, "s1"), (13, "ab" * 200, "s3"), (14, "nul\x00byte and <|endoftext|> 漢字", "s3")]
    rows += [(100 + k, f"{prose(100 + k, 40)} {shared} {prose(200 + k, 40)}", f"s{k % 3}") for k in range(20)]
    return rows


def frame(spark, rows, clash: bool = True):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if clash:
        from pyspark.sql import functions as F
        df = df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    return df


def shingles(text, k=5):
    w = WORDS.findall((text or "").encode().lower())
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_groups(rows: dict) -> dict:
    """id -> smallest id reachable over links of Jaccard >= 0.75, by comparing all pairs."""
    sets, up = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def without_repeats(rows: list[tuple[int, bytes]], span: int = 100) -> list[tuple[bytes, int]]:
    """(kept bytes, number of removed runs) of each text, in order, by a set of all earlier strings."""
    seen, out = set(), []
    for _, text in rows:
        gone = bytearray(len(text))
        for p in range(len(text) - span + 1):
            s = text[p:p + span]
            if s in seen:
                gone[p:p + span] = b"\x01" * span
            seen.add(s)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((bytes(c for c, g in zip(text, gone) if not g), runs))
    return out
