"""Removal of repeated 100-byte strings by a sparse suffix sort that compares by hashes.

Every window of `span` bytes has an anchor: its gram of GRAM bytes with the smallest hash (the leftmost of equals). Equal
windows have equal anchors at equal places, so only windows around equal anchor grams need to be compared, and anchors
are a few hundredths of all positions. The context of an anchor is the stretch of all windows that it stands for.

1. Each task finds the anchors of its documents, some megabytes of text at a time (a turn). Equal contexts within a turn's buffers are
   settled on the spot. One record per gram and turn goes to the bucket of the gram's hash, where grams that occur elsewhere too are found.
2. Documents learn which of their anchors repeat, and send those contexts, again after settling equal ones, to buckets.
3. In a bucket, equal contexts are settled first. The windows of the contexts that are left are suffixes of one buffer.
   Prefix polynomial hashes and binary search give the common extension of two suffixes, a mergesort orders the suffixes
   of each gram and place by it, and equal neighbours are verified byte by byte. Of each run of equal windows the first
   (smaller id, then earlier start) stays; the others are removed.
4. Documents get their removed stretches.

A gram with more than `crowd` contexts is not gathered: its windows go one by one to buckets by their own hash.
Every claim of equality is verified on bytes; hash collisions cost time, never a wrong removal.
"""


import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from lapforge.llm.common import bytes_of, mixed, stored, tidy, tidy_group, turns
from lapforge.llm.hashing import CODES, powers, prefix, stretch

SPAN, GRAM = 100, 40
CROWD = 200_000
SEGMENT = 1 << 18
TURN = 200_000
PLACE = np.uint64((1 << 22) - 1)
BUCKETS_PER_PARTITION = 4
MOST_CROWDED = 5_000_000
RECORD = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("wide", "<u2"), ("lead", "<u2"), ("count", "<u4")])


# ---- anchors ----

def _segments(texts: list[bytes], span: int):
    """Buffers of about SEGMENT bytes: (bytes, document, offset in it and start in the buffer of each piece). Long texts are cut into
    pieces that overlap by span - 1 bytes, so each window lies in exactly one piece."""
    parts, docs, offsets, starts, held = [], [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - span + 1), SEGMENT):
            piece = text[at:at + SEGMENT + span - 1]
            if len(piece) < span:
                continue
            if held and held + len(piece) > SEGMENT:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(docs), np.array(offsets), np.array(starts)
                parts, docs, offsets, starts, held = [], [], [], [], 0
            parts.append(piece)
            docs.append(i)
            offsets.append(at)
            starts.append(held)
            held += len(piece)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(docs), np.array(offsets), np.array(starts)


def _anchors(s: np.ndarray, starts: np.ndarray, span: int, gram: int):
    """Anchors of a buffer of pieces: (first window, last window, anchor position, gram hash, prefix sums)."""
    p = prefix(s)
    ends = np.append(starts[1:], len(s))
    h = mixed((p[gram:] - p[:-gram]) * powers(len(p))[1][:len(s) - gram + 1])
    low = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    width, reach = span - gram + 1, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[:reach - width], low[width - reach:])
    inside = np.zeros(len(s) + 1, np.int8)
    inside[starts] += 1
    inside[ends - span + 1] -= 1
    windows = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8)[:len(low)])
    anchor = (low[windows] & PLACE).astype(np.int64)
    new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(windows) != 1)) + 1
    first, last = windows[np.append(0, new)], windows[np.append(new - 1, len(windows) - 1)]
    where = anchor[np.append(0, new)]
    return first, last, where, h[where], p


def _contexts(s: np.ndarray, at: np.ndarray, wide: np.ndarray, longest: int, span: int) -> np.ndarray:
    """Contexts as rows of bytes, zero beyond each one's end."""
    size = wide.astype(np.int64) + span - 1
    padded = np.concatenate([s, np.zeros(longest, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, longest)[at]
    out[np.arange(longest) >= size[:, None]] = 0
    return out


def _row_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h = h * np.uint64(0x5851F42D4C957F2D) + CODES[rows[:, c]]
    return mixed(h)


def _first_of_equals(key: np.ndarray) -> np.ndarray:
    """For each entry the index of the first entry with the same key."""
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    out = np.empty(len(key), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Stretches merged where they touch, for each document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    base = np.append(0, np.cumsum(doc[1:] != doc[:-1]))
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + base * far) - base * far  # within a document: the farthest end so far
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))
    firsts = np.flatnonzero(new)
    return doc[firsts], start[firsts], reach[np.append(firsts[1:] - 1, len(doc) - 1)]


def _news(doc, a, b):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (doc, a, b)], names=["doc", "a", "b"])


def _dealt(bucket: np.ndarray, records: np.ndarray):
    """(bucket, records of it) for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(edges, np.append(edges[1:], len(bucket))):
        yield int(bucket[a]), records[a:b]


def _columns(records: np.ndarray) -> bytes:
    """Records field after field: like bytes stand together and compress."""
    return b"".join(np.ascontiguousarray(records[f]).tobytes() for f in records.dtype.names)


def _records(data: bytes, n: int) -> np.ndarray:
    out, at = np.empty(n, RECORD), 0
    for f in RECORD.names:
        kind = RECORD[f]
        out[f] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return out


BLOBS = "bucket int, n int, data binary, texts binary"


def _blob_batch(rows):
    import pyarrow as pa
    bucket, n, data, texts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary()), pa.array(texts, pa.binary())],
                                      names=["bucket", "n", "data", "texts"])


def _in_order(batch, id_col: str, text_col: str):
    """Ids and texts of a batch by id."""
    ids = np.asarray(batch.column(id_col))
    order = np.argsort(ids, kind="stable")
    texts = bytes_of(batch, text_col)
    return ids[order], [texts[i] for i in order], order


def _settled(same: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True where a row equals, byte by byte, the row that `same` names and that is not itself."""
    return (same != np.arange(len(same))) & (rows == rows[same]).all(axis=1)


# ---- the four steps ----

def _scan(span: int, gram: int, buckets: int):
    """Step 1: batches of (doc, text) to blobs of records by bucket; records with count 0 and lead 1 are settled stretches."""
    longest = 2 * span - gram

    def run(batches):
        for batch in (x for whole in batches for x in turns(whole, "text")):
            ids, texts, _ = _in_order(batch, "doc", "text")
            found, settled = [], []
            for s, docs, offsets, starts in _segments(texts, span):
                first, last, where, h, p = _anchors(s, starts, span, gram)
                piece = np.searchsorted(starts, first, side="right") - 1
                r = np.empty(len(first), RECORD)
                r["gram"], r["doc"] = h, ids[docs[piece]]
                r["at"] = offsets[piece] + first - starts[piece]
                r["wide"], r["lead"], r["count"] = last - first + 1, where - first, 1
                # equal contexts in this buffer: by hash, then by bytes
                key = mixed(stretch(p, first, last + span) + mixed(h + r["lead"].astype(np.uint64) * np.uint64(1 << 16) + r["wide"]))
                same = _first_of_equals(key)
                again = np.flatnonzero(same != np.arange(len(same)))
                done = np.zeros(len(r), bool)
                for part in np.array_split(again, max(1, len(again) // 50_000)):
                    if len(part):
                        mine = _contexts(s, first[part], r["wide"][part], longest, span)
                        theirs = _contexts(s, first[same[part]], r["wide"][same[part]], longest, span)
                        equal = (mine == theirs).all(axis=1) & (r["wide"][part] == r["wide"][same[part]])
                        done[part[equal]] = True
                gone = r[done]
                settled.append(np.stack(_spans(gone["doc"], gone["at"], gone["at"] + gone["wide"] + span - 1)))
                found.append(r[~done])
            if not found:
                continue
            r = np.concatenate(found)
            order = np.argsort(r["gram"], kind="stable")
            g = r["gram"][order]
            new = np.append(True, g[1:] != g[:-1])
            firsts = np.flatnonzero(new)
            counts = np.diff(np.append(firsts, len(g)))
            several = np.repeat(counts > 1, counts)
            one = r[order[firsts]].copy()
            one["count"] = counts
            rows = [(b, len(x), _columns(x), None) for b, x in _dealt((one["gram"] % np.uint64(buckets)).astype(np.int64), one)]
            # grams that have several contexts in this turn are known to repeat; what is known goes along, spread over buckets
            known = r[order[several]]
            d, a, b = np.concatenate(settled, axis=1)
            cut = np.zeros(len(d), RECORD)
            cut["doc"], cut["at"], cut["gram"], cut["lead"] = d, a, b, 1
            known["count"] = 0
            known["gram"] = 0
            aside = np.concatenate([known, cut])
            if len(aside):
                spread = mixed(aside["doc"].astype(np.uint64)) % np.uint64(buckets)
                kind = np.concatenate([np.zeros(len(known), bool), np.ones(len(cut), bool)])
                for is_cut in (False, True):
                    rows += [(x, len(y), _columns(y), b"cut" if is_cut else b"known")
                             for x, y in _dealt(spread[kind == is_cut].astype(np.int64), aside[kind == is_cut])]
            for i in range(0, len(rows), 256):
                yield _blob_batch(rows[i:i + 256])

    return run


def _asked(at: np.ndarray, wide: np.ndarray, lead: np.ndarray) -> np.ndarray:
    return (at << 20) | (wide.astype(np.int64) << 10) | lead.astype(np.int64)


def _repeating(span: int, crowd: int):
    """Step 1, in a bucket: (doc, a, b) rows. b = -1: a names an anchor to send; b = -2: a is a crowded gram; else a stretch a .. b to remove."""

    def run(table):
        import pyarrow as pa
        plain, out = [], []
        for n, data, tag in zip(*(table.column(c).to_pylist() for c in ("n", "data", "texts"))):
            r = _records(data, n)
            if tag == b"cut":
                out.append((r["doc"], r["at"], r["gram"].astype(np.int64)))
            elif tag == b"known":
                out.append((r["doc"], _asked(r["at"], r["wide"], r["lead"]), np.full(n, -1)))
            else:
                plain.append(r)
        if plain:
            r = np.concatenate(plain)
            r = r[np.argsort(r["gram"], kind="stable")]
            new = np.append(True, r["gram"][1:] != r["gram"][:-1])
            firsts = np.flatnonzero(new)
            size = np.diff(np.append(firsts, len(r)))
            contexts = np.add.reduceat(r["count"].astype(np.int64), firsts)
            ask = r[np.repeat(size > 1, size) & (r["count"] == 1)]
            out.append((ask["doc"], _asked(ask["at"], ask["wide"], ask["lead"]), np.full(len(ask), -1)))
            full = r["gram"][firsts[contexts > crowd]]
            out.append((np.zeros(len(full), np.int64), full.view(np.int64), np.full(len(full), -2)))
        doc, a, b = (np.concatenate(x) for x in zip(*out))
        return pa.Table.from_batches([_news(doc, a, b)])

    return run


def _gram_hash(rows: np.ndarray, lead: np.ndarray, gram: int) -> np.ndarray:
    """The gram hash of step 1, from contexts."""
    p, _ = powers(gram)
    at, h = np.arange(len(rows)), np.zeros(len(rows), np.uint64)
    for i in range(gram):
        h += CODES[rows[at, lead + i]] * p[i]
    return mixed(h)


def _send(span: int, gram: int, buckets: int, crowded: np.ndarray):
    """Step 2: (doc, text, asked) to blobs of contexts by bucket; contexts that are equal within a batch are settled here."""
    longest = 2 * span - gram

    def run(batches):
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in (x for whole in batches for x in turns(whole, "text")):
            ids, texts, order = _in_order(batch, "doc", "text")
            lists = batch.column("asked")
            edges, flat = np.asarray(lists.offsets), np.asarray(lists.flatten())
            edges = edges - edges[0]
            # several texts in one buffer, long ones alone
            group, held = [], 0
            groups = []
            for i, text in enumerate(texts):
                if held and held + len(text) > 4 * SEGMENT:
                    groups.append(group)
                    group, held = [], 0
                group.append(i)
                held += len(text)
            groups.append(group)
            for group in groups:
                s = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
                base = np.cumsum([0, *(len(texts[i]) for i in group)])
                asks = [np.sort(flat[edges[order[i]]:edges[order[i] + 1]]) for i in group]
                n = np.array([len(x) for x in asks])
                if not n.sum():
                    continue
                ask = np.concatenate(asks)
                r = np.zeros(len(ask), RECORD)
                r["doc"] = np.repeat(ids[group], n)
                r["at"], r["wide"], r["lead"] = ask >> 20, (ask >> 10) & 1023, ask & 1023
                rows = _contexts(s, r["at"] + np.repeat(base[:-1], n), r["wide"], longest, span)
                r["gram"] = _gram_hash(rows, r["lead"].astype(np.int64), gram)
                same = _first_of_equals(mixed(_row_hash(rows) + r["gram"] + r["wide"] * np.uint64(977) + r["lead"]))
                same = np.where((r["wide"] == r["wide"][same]) & (r["lead"] == r["lead"][same]), same, np.arange(len(same)))
                done = _settled(same, rows)
                gone = r[done]
                d, a, b = _spans(gone["doc"], gone["at"], gone["at"] + gone["wide"] + span - 1)
                out = []
                if len(d):
                    cut = np.zeros(len(d), RECORD)
                    cut["doc"], cut["at"], cut["gram"] = d, a, b
                    out += [(x, len(y), _columns(y), None) for x, y in _dealt((mixed(d.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), cut)]
                r, rows = r[~done], rows[~done]
                many = np.isin(r["gram"], crowded)
                if many.any():
                    own = np.repeat(np.flatnonzero(many), r["wide"][many])
                    step = np.arange(len(own)) - np.repeat(np.cumsum(r["wide"][many]) - r["wide"][many], r["wide"][many]).astype(np.int64)
                    w = np.zeros(len(own), RECORD)
                    w["doc"], w["at"], w["wide"] = r["doc"][own], r["at"][own] + step, 1
                    window = np.zeros((len(own), longest), np.uint8)
                    window[:, :span] = rows[own[:, None], step[:, None] + np.arange(span)]
                    w["gram"] = _row_hash(window[:, :span])
                    same = _first_of_equals(w["gram"])
                    again = _settled(same, window)
                    gone = w[again]
                    d, a, b = _spans(gone["doc"], gone["at"], gone["at"] + span)
                    if len(d):
                        cut = np.zeros(len(d), RECORD)
                        cut["doc"], cut["at"], cut["gram"] = d, a, b
                        out += [(x, len(y), _columns(y), None) for x, y in _dealt((mixed(d.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), cut)]
                    r, rows = np.concatenate([r[~many], w[~again]]), np.concatenate([rows[~many], window[~again]])
                by_gram = np.argsort(r["gram"], kind="stable")
                r, rows = r[by_gram], rows[by_gram]
                bucket = (r["gram"] % np.uint64(buckets)).astype(np.int64)
                by_bucket = np.argsort(bucket, kind="stable")
                sizes = np.bincount(bucket, minlength=buckets)
                at = 0
                for b in np.flatnonzero(sizes):
                    part = by_bucket[at:at + sizes[b]]
                    at += sizes[b]
                    out.append((int(b), len(part), _columns(r[part]), squeeze.compress(rows[part].tobytes())))
                if out:
                    yield _blob_batch(out)

    return run


def common_extension(p: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, stride: int) -> np.ndarray:
    """Length of the common extension of suffixes a and b, up to most: binary search on hashes of stretches. p holds prefix sums of
    rows of `stride` places each."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
    inverse = powers(stride)[1]
    of_a, of_b = inverse[a % stride], inverse[b % stride]
    while (low < high).any():
        middle = (low + high + 1) // 2
        equal = (p[a + middle] - p[a]) * of_a == (p[b + middle] - p[b]) * of_b
        low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
    return low


def merge_sorted(s: np.ndarray, p: np.ndarray, suffix: np.ndarray, segment: np.ndarray, most: int, stride: int) -> np.ndarray:
    """Order of suffixes within their segments by their first `most` bytes, equal ones in the given order.

    segment is sorted. All segments are merged at once, bottom-up: a suffix moves by the number of suffixes of the
    neighbouring run that come before it, found by binary search with one common extension per step.
    """
    n = len(suffix)
    order = np.arange(n)
    firsts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    size = np.diff(np.append(firsts, n))
    base, count = np.repeat(firsts, size), np.repeat(size, size)
    width = 1
    while len(size) and width < size.max():
        live = np.flatnonzero(count > width)
        rank = live - base[live]
        mine = rank // width
        other = (mine ^ 1) * width
        total = count[live]
        low = np.minimum(other, total)
        start, stop = low.copy(), np.minimum(other + width, total)
        right = (mine & 1) == 1
        x, high = suffix[order[live]], stop.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            a, b = x[open_], suffix[order[base[live[open_]] + middle]]
            same = common_extension(p, a, b, most, stride)
            over = same >= most
            less = np.where(over, right[open_], s[np.minimum(b + same, len(s) - 1)] < s[np.minimum(a + same, len(s) - 1)])
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        to = base[live] + (mine - right) * width + rank % width + (low - start)
        moved = order.copy()
        moved[to] = order[live]
        order = moved
        width *= 2
    return order


def _sorted_out(span: int, gram: int):
    """Step 3, in a bucket: stretches to remove as (doc, a, b)."""
    longest = 2 * span - gram

    def run(table):
        import pyarrow as pa
        import zstandard
        expand = zstandard.ZstdDecompressor()
        out, parts, texts = [], [], []
        for n, data, packed in zip(*(table.column(c).to_pylist() for c in ("n", "data", "texts"))):
            r = _records(data, n)
            if packed is None:
                out.append((r["doc"], r["at"], r["gram"].astype(np.int64)))
            else:
                parts.append(r)
                texts.append(np.frombuffer(expand.decompress(packed), np.uint8).reshape(n, longest))
        if parts:
            r, rows = np.concatenate(parts), np.concatenate(texts)
            del parts, texts
            first = np.lexsort((r["at"] + r["lead"], r["doc"], r["gram"]))
            r, rows = r[first], rows[first]
            same = _first_of_equals(mixed(_row_hash(rows) + r["gram"] + r["wide"] * np.uint64(977) + r["lead"]))
            same = np.where((r["wide"] == r["wide"][same]) & (r["lead"] == r["lead"][same]) & (r["gram"] == r["gram"][same]), same, np.arange(len(same)))
            done = _settled(same, rows)
            gone = r[done]
            out.append(_spans(gone["doc"], gone["at"], gone["at"] + gone["wide"] + span - 1))
            r, rows = r[~done], rows[~done]
            group = np.append(0, np.cumsum(r["gram"][1:] != r["gram"][:-1]))
            size = np.bincount(group)
            # contexts of one gram meet; whole grams at a time, about TURN windows each
            keep = size[group] > 1
            r, rows, group = r[keep], rows[keep], group[keep]
            load = np.cumsum(r["wide"].astype(np.int64)) // TURN
            edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))[:len(r)]
            turn = np.repeat(load[edges], np.diff(np.append(edges, len(r)))) if len(r) else load
            for t in np.unique(turn):
                out.append(_windows(r[turn == t], rows[turn == t], span))
        doc, a, b = (np.concatenate(x) for x in zip(*out))
        return pa.Table.from_batches([_news(*_spans(doc, a, b))])

    return run


def _windows(r: np.ndarray, rows: np.ndarray, span: int):
    """Windows of contexts (sorted by gram, document and place) that have an equal earlier one."""
    stride = rows.shape[1] + 1
    s = np.zeros((len(rows), stride), np.uint8)
    s[:, :-1] = rows
    p = np.zeros((len(rows), stride), np.uint64)
    np.cumsum(CODES[rows] * powers(stride)[0][:stride - 1], axis=1, out=p[:, 1:])
    s, p = s.ravel(), p.ravel()
    wide = r["wide"].astype(np.int64)
    own = np.repeat(np.arange(len(r)), wide)
    step = np.arange(len(own)) - np.repeat(np.cumsum(wide) - wide, wide)
    suffix = own * stride + step
    # Equal windows have one gram, one place, and equal first and last eight bytes: what differs in these need not be sorted together.
    eights = np.lib.stride_tricks.sliding_window_view(s, 8)
    ends = [np.ascontiguousarray(eights[x]).view("<u8").ravel() for x in (suffix, suffix + span - 8)]
    place = (r["lead"].astype(np.int64)[own] - step).astype(np.uint64)
    key = mixed(ends[0] + mixed(ends[1] + mixed(r["gram"][own] + place)))
    by = np.argsort(key, kind="stable")  # stable: within a key by document and start
    segment = np.cumsum(np.append(0, key[by][1:] != key[by][:-1]))
    several = np.bincount(segment)[segment] > 1
    by, segment = by[several], segment[several]
    out = []
    starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))[:len(segment)]
    turn = starts // TURN
    for t in np.unique(turn):  # whole segments, about TURN suffixes at a time
        first = starts[np.searchsorted(turn, t)]
        after = np.searchsorted(turn, t, side="right")
        part = slice(first, starts[after] if after < len(starts) else len(by))
        out.append(_sorted_part(r, s, p, own, step, suffix, by[part], segment[part], span, stride))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.empty(0, np.int64) for _ in range(3))


def _sorted_part(r, s, p, own, step, suffix, by, segment, span, stride):
    order = merge_sorted(s, p, suffix[by], segment, span, stride)
    by, segment = by[order], segment[order]
    x = suffix[by]
    beside = (segment[1:] == segment[:-1]) & (common_extension(p, x[1:], x[:-1], span, stride) >= span)
    # verification: bytes of neighbours that the hashes call equal
    at = np.flatnonzero(beside)
    for part in np.array_split(at, max(1, len(at) // 20_000)):
        if not (s[x[part][:, None] + np.arange(span)] == s[x[part + 1][:, None] + np.arange(span)]).all():
            return _by_bytes(r, s, own, step, x, by, segment, span)
    again = by[1:][beside]
    return _spans(r["doc"][own[again]], r["at"][own[again]] + step[again], r["at"][own[again]] + step[again] + span)


def _by_bytes(r, s, own, step, x, by, segment, span):
    """The same without hashes, for the turn in which two different windows had one hash."""
    seen, again = set(), []
    for i in np.lexsort((r["at"][own[by]] + step[by], r["doc"][own[by]])):
        key = (segment[i], s[x[i]:x[i] + span].tobytes())
        if key in seen:
            again.append(by[i])
        seen.add(key)
    again = np.array(again, np.int64)
    return _spans(r["doc"][own[again]], r["at"][own[again]] + step[again], r["at"][own[again]] + step[again] + span)


def _keyed(df: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents, rows): rows (doc, text, carried columns) for each row of df, doc being in the order of the ids; documents (doc, text), each
    doc once. Only if ids repeat or are null, docs are numbers by id and hash of the text; rows alike in both are one document."""
    plain = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.struct(F.col(id_col), *carry).alias("carried"))
    if not plain.groupBy("doc").count().where("count > 1 OR doc IS NULL").limit(1).count():
        return plain.select("doc", "text"), plain
    tied = plain.withColumn("tie", F.xxhash64("text"))
    order = stored(tied.select("doc", "tie").distinct(), "ties").orderBy(F.col("doc").asc_nulls_last(), "tie")
    numbers = stored(order.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])).toDF("i long, t long, number long"), "numbers")
    rows = tied.join(numbers, tied["doc"].eqNullSafe(numbers["i"]) & (tied["tie"] == numbers["t"])).select(F.col("number").alias("doc"), "text", "carried")
    rows = stored(rows, "keyed")
    return rows.select("doc", "text").dropDuplicates(["doc"]), rows


def repeated_stretches(docs: DataFrame, span: int = SPAN, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc, stretches): for documents (doc, text) with unique ids, the stretches start << 24 | length (may touch or overlap) to remove."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_PER_PARTITION * parts
    scanned = docs.mapInArrow(tidy(_scan(span, gram, buckets)), BLOBS)
    news = stored(scanned.groupBy("bucket").applyInArrow(tidy_group(_repeating(span, crowd)), "doc long, a long, b long"), "anchors")
    crowded = [r[0] for r in news.where("b = -2").select("a").distinct().limit(MOST_CROWDED).collect()]
    crowded = np.sort(np.array(crowded, np.int64).view(np.uint64))
    asked = news.where("b = -1").groupBy("doc").agg(F.collect_list("a").alias("asked"))
    told = docs.join(asked, "doc").select("doc", "text", "asked")
    sent = told.mapInArrow(tidy(_send(span, gram, buckets, crowded)), BLOBS)
    found = stored(sent.groupBy("bucket").applyInArrow(tidy_group(_sorted_out(span, gram)), "doc long, a long, b long"), "stretches")
    both = found.unionByName(news.where("b >= 0"))
    longest = (1 << 24) - 1
    pieces = both.select("doc", F.explode(F.transform(F.sequence(F.col("a"), F.col("b") - 1, F.lit(longest)),
                         lambda x: F.shiftleft(x, 24).bitwiseOR(F.least(F.col("b") - x, F.lit(longest))))).alias("piece"))
    return pieces.groupBy("doc").agg(F.collect_list("piece").alias("stretches"))


def _whole_characters(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The stretch without the bytes of characters that are only partly in it."""
    while a < b and 0x80 <= text[a] < 0xC0:
        a += 1
    while b > a and b < len(text) and 0x80 <= text[b] < 0xC0:
        b -= 1
    return a, b


def kept_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, crowd: int = CROWD,
               carry: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
    """(id_col, carried columns, n_bytes, n_removed, spans, kept) for each row of df: spans (start, end) of removed bytes, kept the
    bytes that remain. With whole_characters, a character goes only if all its bytes do, so that kept is text again.

    Null text: empty. Texts shorter than span bytes: whole. Rows that repeat an id: judged in the order of a hash of their
    text; rows alike in both are one document and get one result each. Null ids come last. Empty table: no rows.
    """
    carry = carry or []
    docs, rows = _keyed(df, id_col, text_col, carry)
    cut = repeated_stretches(docs, span, gram, crowd)
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([rows.schema["carried"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", spans_type), T.StructField("kept", T.BinaryType())])

    def apply(batches):
        import pyarrow as pa
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in (x for whole in batches for x in turns(whole, "text")):
            lists = batch.column("stretches")
            out = []
            for i, text in enumerate(bytes_of(batch, "text")):
                spans, kept = [], text
                if lists[i].is_valid:
                    x = np.asarray(lists[i].values)
                    _, a, b = _spans(np.zeros(len(x), np.int64), x >> 24, (x >> 24) + (x & ((1 << 24) - 1)))
                    spans = list(zip(a.tolist(), b.tolist()))
                    if whole_characters:
                        spans = [(a, b) for a, b in (_whole_characters(text, *x) for x in spans) if a < b]
                    edges = [0, *(e for x in spans for e in x), len(text)]
                    kept = b"".join(text[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2))
                out.append((len(text), len(text) - len(kept), [{"start": a, "end": b} for a, b in spans], kept))
            if out:
                n, gone, spans, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind),
                                                  pa.array(kept, pa.binary())], names=schema.names)

    return rows.join(cut, "doc", "left").mapInArrow(tidy(apply), schema).select("carried.*", "n_bytes", "n_removed", "spans", "kept")
