"""Best-fit decreasing against the piece-by-piece algorithm; tokens against the tokenizer."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lapforge.llm.packing import best_fit_decreasing, pack, pack_documents, token_pieces
from lapforge.llm.queries import tokenizer
from helpers import frame, odd_texts


def one_by_one(lengths, capacity):
    """Remaining capacities after best-fit decreasing, bin after bin."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([40, 41, 64, 97]))
def test_runs_are_those_of_best_fit_decreasing(lengths, capacity):
    used, placed = defaultdict(list), Counter()
    for length, first, last, b, each, offset in best_fit_decreasing(Counter(lengths), capacity):
        assert placed[length] == first
        placed[length] = last
        for i in range(first, last):
            used[b + (i - first) // each].append((offset + (i - first) % each * length, length))
    assert placed == Counter(lengths)
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(x for _, x in p) for p in used.values()) == one_by_one(lengths, capacity)


def test_a_hot_length_is_split(spark):
    r = random.Random(1)
    rows = [(i, 30 if i % 3 else r.randrange(1, 100)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, length long").withColumn("nth", F.lit(1)).withColumn("chunk", F.lit(1))
    got = pack(df, 100, order=["doc_id"], chunk_rows=7).collect()
    bins = defaultdict(list)
    for x in got:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    assert len(got) == 900 and sorted(100 - sum(y for _, y in b) for b in bins.values()) == one_by_one([x for _, x in rows], 100)
    assert all(sum(y for o2, y in b if o2 < o) == o for b in bins.values() for o, _ in b)
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 101)], "doc_id long, length long"), 100)


def test_tokens_of_whole_texts(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer())
    t.encode_special_tokens = True
    rows = odd_texts() + [(15, "Ünï cöde space \x1c control 'll it's", "s"), (16, "é á\ńb", "s"), (None, "no id", "s"), (4, "one two", "s2")]
    df = frame(spark, rows)
    got = pack_documents(df, tokenizer(), capacity=500)
    seen = defaultdict(list)
    for r in got.collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        seen[r["doc_id"], r["piece"]].append(r)
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 500)):
            assert any(r["ids"] == ids[start:start + 500] and r["start"] == start for r in seen[i, piece]), i
    assert sum(len(v) for v in seen.values()) == sum(-(-len(t.encode(x or "", add_special_tokens=False).ids + [1]) // 500) for _, x, _ in rows)
    assert pack_documents(df.limit(0), tokenizer()).count() == 0
    with pytest.raises(FileNotFoundError):
        token_pieces(df, "/nowhere.json")


def test_special_tokens_are_those_of_the_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer
    from lapforge.llm.queries import QUERIES
    t = Tokenizer.from_file(tokenizer())
    texts = ["hello <|endoftext|> world<|startoftext|>", "a<|ENDOFTEXT|>b<|endoftext|>.c <|startoftext|><|endoftext|>", "é<|endoftext|>\u0301 x",
             "x,<|endoftext|>,y.<|endoftext|>'s", "<|endoftext|>", "<|endof<|endoftext|>text|> <| endoftext|>", *(x for _, x, _ in odd_texts()), "plain words."]
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in enumerate(texts)}
    assert want[0] == [3306, 49407, 1002, 49406, 1]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in token_pieces(df, tokenizer(), special_tokens=True).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == want
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    crc = {r["doc_id"]: r["ids_crc32"] for r in QUERIES["op4_best_fit_packing"](spark, str(tmp_path)).where("piece = 0").collect()}
    assert crc == {i: zlib.crc32(np.array(ids[:4096], "<u4").tobytes()) for i, ids in want.items()}


def test_letters_and_marks_are_merged_once_whatever_words_they_are_in():
    """Texts of many words made of few parts: each part is encoded once, also for later batches, and the ids are the tokenizer's."""
    import pyarrow as pa
    from tokenizers import Tokenizer
    from lapforge.llm.packing import WordIds
    t = Tokenizer.from_file(tokenizer())
    t.encode_special_tokens = True
    words = WordIds(tokenizer())
    r = random.Random(3)
    heads, marks = ["Lap", "ÉTÉ", "straße", "Ÿes", "box", ""], ["", ",", ".", "!!", "$$$", "),"]
    texts = ["", " \x0b ", *(" ".join(r.choice(heads) + r.choice(marks) for _ in range(r.randrange(60))) for _ in range(200)), "it's 3 é́ İx KKm \x85 \x1c ×,"]
    encoded = []
    learn = words.learn
    words.learn = lambda new, whole: (encoded.extend(new), learn(new, whole))
    for _ in range(2):
        ids, sizes = words.text_ids(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    odd = {"it's", "3", "é́", "İx", "kKm", "\x85", "\x1c", "×,"}
    assert len(encoded) == len(set(encoded)) and set(encoded) == {"lap", "été", "straße", "ÿes", "box", ",", ".", "!!", "$$$", "),"} | odd
