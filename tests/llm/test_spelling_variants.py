"""Near words and forms against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lapforge.llm import spelling
from lapforge.llm.queries import QUERIES, misspelt
from helpers import frame, odd_texts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def by_all_pairs(counts, ratio=5):
    out, forms = {}, {}
    for w, n in counts.items():
        near = [(-m, v.encode(), v) for v, m in counts.items() if one_edit(w, v)]
        best = min(near) if near else None
        if best and -best[0] >= ratio * n:
            forms[w] = best[2]
        out[w] = (n, len(near), -best[0] if w in forms else None)
    root = {}
    for w in counts:
        r = w
        while r in forms:
            r = forms[r]
        root[w] = r
    return {(w, forms.get(w), root[w], *x) for w, x in out.items()}


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abcdé"), (3, "aeiounst")])
def test_random_words(spark, seed, letters):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(500)} | {"a" * k for k in range(1, 12)}
    counts = {w: 5 ** r.randrange(0, 8) for w in words}
    assert rows_of(spelling.variants(table(spark, counts))) == {x for x in _without_single_letters(counts)}


def _without_single_letters(counts):
    """Words of one letter are near to nothing, by the operator's definition."""
    long = {w: n for w, n in counts.items() if len(w) > 1}
    return by_all_pairs(long) | {(w, None, w, n, 0, None) for w, n in counts.items() if len(w) == 1}


def test_long_chain_and_ties(spark):
    chain = {"abcdefgh"[:k] + "x" * (8 - k): 5 ** (8 - k) for k in range(9)}
    ties = {"mmmmma": 50, "mmmmmb": 50, "mmmmmé": 50, "mmmmmc": 5, "mmmmm": 1}
    counts = chain | ties | {"🙂🙂🙂": 7, "🙂🙂🙃": 70}
    got = rows_of(spelling.variants(table(spark, counts)))
    assert got == by_all_pairs(counts)
    assert next(x for x in got if x[0] == "mmmmmc")[1] == "mmmmma" and next(x for x in got if x[0] == "abcdefgh")[2] == "xxxxxxxx"


def test_one_edit_apart_always_shares_a_signature(spark):
    r = random.Random(4)
    pairs = []
    for i in range(400):
        w = "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 14)))
        at, kind = r.randrange(len(w)), r.randrange(3)
        pairs.append((w, [w[:at] + "z" + w[at:], w[:at] + w[at + 1:], w[:at] + "z" + w[at + 1:]][kind]))
    words = {w for p in pairs for w in p if len(w) > 1}
    got = {(x.a, x.b) for x in spelling.near_pairs(table(spark, dict.fromkeys(words, 1))).select("a", "b").collect()}
    assert all((a, b) in got and (b, a) in got for a, b in pairs if min(len(a), len(b)) > 1)


def test_a_crowded_signature_does_not_lose_pairs(spark):
    """Three thousand words with the same letters."""
    r, letters = random.Random(5), list("aabbccdd")
    words = set()
    while len(words) < 2000:
        r.shuffle(letters)
        words.add("".join(letters))
    words |= {w[:-1] for w in list(words)[:50]}
    counts = dict.fromkeys(words, 5)
    assert rows_of(spelling.variants(table(spark, counts))) == by_all_pairs(counts)


def test_words_are_not_broadcast_by_the_size_of_their_file(spark):
    """Each word has 24 rows in the join, and the file of a hundred thousand words is small enough for a broadcast."""
    words = spelling.stored(table(spark, {"abcdef": 5, "abcdeg": 50}))
    for df in (spelling.near_pairs(words), spelling.variants(words)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows_of(spelling.variants(words)) == by_all_pairs({"abcdef": 5, "abcdeg": 50})


def test_odd_rows(spark):
    words = spark.createDataFrame([(None, 5), ("abc", None), ("", 3), ("abcd", 2), ("abce", 10)], "word string, n long")
    clash = words.withColumns({c: F.lit("x") for c in ("a", "b", "form", "root", "signature", "n_near", "m", "part")})
    assert rows_of(spelling.variants(clash)) == {("", None, "", 3, 0, None), ("abcd", "abce", "abce", 2, 1, 10), ("abce", None, "abce", 10, 1, None)}
    assert rows_of(spelling.variants(words.limit(0))) == set()


def test_words_of_whole_texts(spark):
    rows = odd_texts() + [(None, "Straße STRASSE straße", "s")] * 5 + [(200 + k, "naïveté ×÷× abcdef-ghijkl", "s") for k in range(200)]
    counts = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    df = frame(spark, rows).withColumns({c: F.lit("x") for c in ("run", "word")})
    assert {r.word: r.n for r in spelling.word_counts(df, reading=misspelt).collect()} == want
    assert spelling.word_counts(df.limit(0)).count() == 0


def test_query_has_forms_and_roots(spark):
    got = QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.001").collect()
    assert any(r.form for r in got) and all((r.form is None) == (r.root == r.word) == (r.form_n is None) for r in got)


def test_rounds():
    assert [spelling.rounds_needed(m, 5, 1) for m in (None, 1, 4, 5, 24, 25, 124, 125, 5 ** 5, 5 ** 8)] == [0, 0, 0, 0, 0, 1, 1, 2, 3, 3]
