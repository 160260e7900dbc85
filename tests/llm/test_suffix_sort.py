"""Repeated strings: the sort against sorted(), removal against a set of all earlier strings."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lapforge.llm import suffixes
from lapforge.llm.common import turns
from lapforge.llm.hashing import prefix
from helpers import frame, odd_texts, prose, without_repeats


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=30, max_size=300).map(lambda b: bytes(c % 3 for c in b)), st.integers(1, 12), st.integers(1, 5))
def test_merge_sort_orders_like_sorted(data, most, segments):
    s = np.frombuffer(data, np.uint8)
    suffix = np.arange(len(s) - most)
    segment = np.sort(suffix % segments)
    order = suffixes.merge_sorted(s, prefix(s), suffix, segment, most, len(s) + 1)
    for g in set(segment.tolist()):
        own = [int(suffix[i]) for i in range(len(suffix)) if segment[i] == g]
        got = [int(suffix[i]) for i in order[segment == g]]
        assert got == sorted(own, key=lambda i: (data[i:i + most], i))


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=12, max_size=80).map(lambda b: bytes(c % 2 for c in b)))
def test_common_extension(data):
    s = np.frombuffer(data, np.uint8)
    a, b = np.meshgrid(np.arange(len(s) - 10), np.arange(len(s) - 10))
    got = suffixes.common_extension(prefix(s), a.ravel(), b.ravel(), 10, len(s) + 1)
    for i, j, n in zip(a.ravel(), b.ravel(), got):
        plain = next((k for k in range(10) if data[i + k] != data[j + k]), 10)
        assert n == plain


def texts():
    rows = odd_texts()
    passage, line = prose(70, 200), prose(71, 30)
    r = random.Random(6)
    for k in range(40):
        cut = r.randrange(0, 200)
        rows.append((300 + k, prose(400 + k, 30) + passage[cut:cut + r.randrange(90, 400)] + prose(500 + k, 20) + (line if k % 3 else ""), "s"))
    rows += [(500, "ab" * 400, "s"), (501, "a" * 500, "s"), (502, "a" * 99, "s"), (503, "a" * 100, "s"), (504, prose(80, 4000) + prose(80, 4000), "s"), (505, "日本" * 120, "s")]
    return rows


@pytest.mark.parametrize("crowd", [2, suffixes.CROWD])
def test_removal_like_a_set_of_strings(spark, crowd):
    rows = texts()
    df = frame(spark, rows).repartition(5)
    got = {r["doc_id"]: r for r in suffixes.kept_bytes(df, crowd=crowd).collect()}
    ordered = sorted(rows)
    for (i, text, _), (kept, runs) in zip(ordered, without_repeats([(i, (t or "").encode()) for i, t, _ in ordered])):
        r = got[i]
        assert hashlib.sha256(r["kept"]).digest() == hashlib.sha256(kept).digest(), i
        assert (r["n_bytes"], r["n_removed"], len(r["spans"])) == (len((text or "").encode()), len((text or "").encode()) - len(kept), runs)


def test_repeated_and_null_ids_and_carried_columns(spark):
    a, b = prose(90, 60), prose(91, 60)
    rows = [(1, a, "x"), (1, a, "x"), (2, a + b, "y"), (None, b, "z"), (None, b, "z"), (2, b, "w")]
    got = suffixes.kept_bytes(frame(spark, rows), carry=["source", "chunk"]).collect()
    left = sorted((r["doc_id"] or 99, r["source"], len(r["kept"])) for r in got)
    assert [x for x in left if x[0] == 1] == [(1, "x", len(a))] * 2  # equal rows are one document: its first place stays, in both rows
    assert [x for x in left if x[0] == 99] == [(99, "z", 0)] * 2
    assert sum(n for i, _, n in left if i == 2) <= len(b) + 100 and got[0]["chunk"] == "x"
    assert suffixes.kept_bytes(frame(spark, rows).limit(0)).count() == 0


def test_whole_characters(spark):
    long = "é" * 100
    got = suffixes.kept_bytes(frame(spark, [(1, "a" + long, "s"), (2, "bé" + long + "z", "s")]), whole_characters=True).collect()
    assert {r["doc_id"]: r["kept"].decode() for r in got}[2].startswith("b")


def test_different_windows_under_one_hash(spark, monkeypatch):
    """With a hash that says equal to everything, verification still removes nothing wrongly."""
    monkeypatch.setattr(suffixes, "common_extension", lambda p, a, b, most, stride: np.full(len(a), most))
    r = np.zeros(3, suffixes.RECORD)
    r["doc"], r["wide"] = [1, 2, 3], 1
    a, b = b"e" * 10 + b"a" * 80 + b"e" * 10, b"e" * 10 + b"b" * 80 + b"e" * 10
    rows = np.frombuffer(a + b + a, np.uint8).reshape(3, 100)
    doc, start, end = suffixes._windows(r, rows, 100)
    assert doc.tolist() == [3] and (end - start).tolist() == [100]


def whole_task(mb: int):
    """One Arrow batch of documents (doc, text) of 16 kB, as Spark hands over the texts of a task."""
    import pyarrow as pa
    letters = np.random.RandomState(3).randint(97, 123, mb << 20).astype(np.uint8).tobytes().decode()
    return pa.RecordBatch.from_arrays([pa.array(range(mb << 6)), pa.array([letters[i << 14:(i + 1) << 14] for i in range(mb << 6)])], names=["doc", "text"])


def test_memory_of_the_scan_does_not_grow_with_the_batch():
    """Anchors are held for a turn of texts: a batch three times as long takes little more. All of them are found."""
    most, found = {}, {}
    for mb in (8, 24):
        batch, records = whole_task(mb), 0
        tracemalloc.start()
        for out in suffixes._scan(100, 40, 64)([batch]):
            records += sum(out.column("n").to_pylist())
        most[mb], found[mb] = tracemalloc.get_traced_memory()[1], records
        tracemalloc.stop()
    assert most[24] < 1.5 * most[8]
    assert found[24] > 2.9 * found[8]


def test_turns_hold_every_row_once():
    import pyarrow as pa
    texts = ["a" * 10, None, "", "b" * 95, "c" * 30, "é" * 40, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["doc", "text"])
    for most in (1, 40, 100, 10_000):
        parts = list(turns(batch, "text", most))
        assert [x for p in parts for x in p.column("text").to_pylist()] == texts
        assert [x for p in parts for x in p.column("doc").to_pylist()] == list(range(7))
        for p in parts:  # beyond the limit goes only the text that reaches it
            sizes = [len((x or "").encode()) for x in p.column("text").to_pylist()]
            assert sum(sizes) - max(sizes) <= most
    assert len(list(turns(batch, "text", 10_000))) == 1 and len(list(turns(batch, "text", 100))) == 3 and not list(turns(batch.slice(0, 0), "text"))
