"""Near-duplicate documents by SuperMinHash.

Each element of a document's shingle set gives every signature slot a rank at most once: its own pseudorandom permutation
of the slots is drawn step by step, and step j offers slot p(j) the value j + u. Once all slots of a document hold values
below j + 1, later steps cannot change it and it is done: large documents need one step, small ones some more. Bands of
the signature give candidates, which are verified on the full sets. Equal sets are one class from the start.

Candidates are never all pairs of a band. Each band first links its members to its smallest one; components of verified
links follow. Then members of one band that are still in different components meet: those outside the band's largest
component and all others, in blocks, by an inverted index of their shingles that writes out only links. After that, each
candidate pair is either verified or joined.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from lapforge.llm.common import bytes_of, mixed, stored, tidy, tidy_group, turns
from lapforge.llm.graph import components
from lapforge.llm.hashing import shingle_set

WORDS, PERCENT = 5, 75
SLOTS, ROWS = 128, 4
PLANE = 1 << 17  # elements that hold a permutation at a time
OUTSIDERS, MEMBERS = 512, 2048  # most outsiders and members of a band in one cell, on average


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures of sets of distinct 64-bit hashes: len(sets) x slots numbers, step in the high byte, draw below.
    An empty set has the largest value in all slots."""
    sizes = np.array([len(s) for s in sets], np.int64)
    sig = np.full((len(sets), slots), ~np.uint64(0))
    if not sizes.sum():
        return sig
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat, h = sig.reshape(-1), np.concatenate(sets)
    place = None
    for j in range(slots):
        x = mixed(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = j + ((mixed(x) >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if place is None:
            slot = k
        else:
            row = np.arange(len(h))
            slot = place[row, k].astype(np.int64)
            place[row, k] = place[row, j]
        np.minimum.at(flat, owner * slots + slot, np.uint64(j << 56) | (x >> np.uint64(8)))
        open_docs = sig.max(axis=1) >= np.uint64((j + 1) << 56) if j < 127 else np.zeros(len(sets), bool)
        going = open_docs[owner]
        n = int(going.sum())
        if not n or j == slots - 1:
            break
        if place is None:
            h, owner, k = h[going], owner[going], k[going]
            place = np.tile(np.arange(slots, dtype=np.uint8), (n, 1))
            place[np.arange(n), k] = 0
        elif n < 0.7 * len(h):
            h, owner, place = h[going], owner[going], place[going]
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band: equal keys, up to collisions, mean equal signature rows in the same band."""
    bands = sig.reshape(len(sig), -1, rows)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
    for r in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    return key.view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, n, d1, d2, bands, packed): set size, a 128-bit digest of the set, band keys, and the compressed text."""
    schema = "id long, n long, d1 long, d2 long, bands array<long>, packed binary"

    def sign(batches):
        import pyarrow as pa
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=3)

        def out(ids, sets, packed):
            digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            keys, n = band_keys(superminhash(sets)), np.array([len(s) for s in sets])
            some = np.where(n > 0, keys.shape[1], 0)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]).astype(np.int32)), pa.array(keys[n > 0].reshape(-1)))
            return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), bands, pa.array(packed, pa.binary())],
                                              names=["id", "n", "d1", "d2", "bands", "packed"])

        for batch in (x for whole in batches for x in turns(whole, text_col)):
            ids, first, sets, packed, held = batch.column(0), 0, [], [], 0
            for i, text in enumerate(bytes_of(batch, text_col)):
                sets.append(shingle_set(text, words))
                packed.append(squeeze.compress(text))
                held += len(sets[-1])
                if held > PLANE:
                    yield out(ids.slice(first, len(sets)), sets, packed)
                    first, sets, packed, held = i + 1, [], [], 0
            if sets:
                yield out(ids.slice(first, len(sets)), sets, packed)

    return df.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(tidy(sign), schema)


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union. texts: (id, packed)."""
    def sides(name):
        return texts.select(F.col("id").alias(name), F.col("packed").alias(f"text_{name}"))

    def confirm(batches):
        import pyarrow as pa
        import zstandard
        expand = zstandard.ZstdDecompressor()
        last, mine = None, None
        for batch in batches:
            keep = []
            for i, (a, ta, tb) in enumerate(zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"))):
                if a != last:
                    last, mine = a, shingle_set(expand.decompress(ta.as_py()), words)
                other = shingle_set(expand.decompress(tb.as_py()), words)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    # the side that repeats most (a band's smallest member) is joined last, so its set is made once for a run of pairs
    met = pairs.join(sides("b"), "b").join(sides("a"), "a").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(tidy(confirm), "a long, b long")


def _meet(words: int, percent: int):
    """Links between the outsiders and the members of one cell of a band; the sets are met by an inverted index, no pair is written out."""

    def run(table):
        import pyarrow as pa
        import zstandard
        expand = zstandard.ZstdDecompressor()
        band = table.column("band")[0].as_py()
        ids, n, component, outside = (np.asarray(table.column(c).combine_chunks()) for c in ("id", "n", "component", "outside"))
        bands = np.asarray(table.column("bands").combine_chunks().flatten()).reshape(len(ids), -1)
        sets = [shingle_set(expand.decompress(x.as_py()), words) for x in table.column("packed")]
        m = np.flatnonzero(outside == 0)
        flat, owner = np.concatenate([sets[i] for i in m]), np.repeat(np.arange(len(m)), [len(sets[i]) for i in m])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        links = []
        for x in np.flatnonzero(outside == 1):
            # a pair is looked at once: in the first band that both are in, and from the smaller id if both are outsiders
            first = np.argmax(bands[m] == bands[x], axis=1)
            ok = (component[m] != component[x]) & (bands[x][first] == band) & (100 * np.minimum(n[m], n[x]) >= percent * np.maximum(n[m], n[x]))
            if not ok.any():
                continue
            low, high = np.searchsorted(flat, sets[x], side="left"), np.searchsorted(flat, sets[x], side="right")
            size = high - low
            hits = owner[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
            both = np.bincount(hits, minlength=len(m))
            good = np.flatnonzero(ok & (100 * both >= percent * (n[m] + n[x] - both)))
            if len(good):  # one link to each component is enough
                _, one = np.unique(component[m][good], return_index=True)
                links += [(int(min(ids[x], ids[m][i])), int(max(ids[x], ids[m][i]))) for i in good[one]]
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def across(split: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT, outsiders: int = OUTSIDERS, members: int = MEMBERS) -> DataFrame:
    """Verified links (a, b) between different components of a band. split: band, id, n, component, main (the band's largest
    component), members and largest (its sizes); texts: id, bands, packed.

    A band's outsiders, which are not in its main component, meet all its members in cells of bounded size: a band is cut
    into as many blocks of outsiders and of members as it needs.
    """
    rows = split.join(texts, "id")
    across_ = F.ceil((F.col("members") - F.col("largest")) / outsiders).cast("int")
    down = F.ceil(F.col("members") / members).cast("int")
    rows = rows.withColumn("across", F.greatest(across_, F.lit(1))).withColumn("down", F.greatest(down, F.lit(1)))
    spread = F.xxhash64("id", F.lit("cell"))
    block = F.pmod(spread, F.col("down")).cast("int")
    turn = F.pmod(spread, F.col("across")).cast("int")
    columns = ["band", "id", "n", "component", "bands", "packed"]
    as_member = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("across") - 1))).select(*columns, "x", block.alias("y"), F.lit(0).alias("outside"))
    as_outsider = rows.where("component <> main").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("down") - 1))).select(
        *columns, turn.alias("x"), "y", F.lit(1).alias("outside"))
    cells = as_member.unionByName(as_outsider).groupBy("band", "x", "y")
    return cells.applyInArrow(tidy_group(_meet(words, percent)), "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of df.

    component_id is the smallest id reachable over links of at least percent; kept marks the row with that id. Null or
    blank text: no shingles, linked with nothing. Rows that share an id are one node of the graph. A null id: linked with
    nothing, component null, kept. Empty table: no rows. Other columns are not used.
    """
    rows = stored(signatures(df, id_col, text_col, words), "signatures")
    named = rows.where("n > 0 AND id IS NOT NULL")
    classes = named.groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    member = stored(named.select("id", "n", "d1", "d2").join(classes, ["d1", "d2"]).select("id", "n", "rep").distinct(), "classes")
    # one text and one band list per class: that of its smallest id (of rows that share that id, the first digest)
    reps = classes.groupBy("rep").agg(F.min(F.struct("d1", "d2")).alias("d")).select("rep", "d.d1", "d.d2")
    # rows that repeat an id with its text are dropped before their bands are written out
    own = named.join(classes, ["d1", "d2"]).where("id = rep").select("d1", "d2", "id", "n", "bands").dropDuplicates(["d1", "d2"])
    bands = stored(own.select("id", "n", F.explode("bands").alias("band")), "bands")
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    centres = bands.groupBy("band").agg(F.min("id").alias("a"), F.min_by("n", "id").alias("m"), F.count("*").alias("members")).where("members > 1")
    # written once: the three readers below do not bring bands and centres together again
    crowded = stored(bands.join(centres.select("band", "a", "m"), "band"), "crowded")
    # texts only of documents that share a band; whole rows are shuffled once
    asked = reps.join(crowded.select(F.col("id").alias("rep")).distinct(), "rep").withColumnRenamed("rep", "id")
    texts = stored(named.select("id", "d1", "d2", "bands", "packed").join(asked, ["id", "d1", "d2"]).dropDuplicates(["id", "d1", "d2"]).drop("d1", "d2"), "texts")
    first = stored(crowded.where(fits & (F.col("id") > F.col("a"))).select("a", F.col("id").alias("b")).distinct(), "pairs")
    links = stored(verified(first, texts.select("id", "packed"), words, percent), "links")
    # rows that share an id tie their classes together: each class to the smallest of its id
    first_of = member.groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("id", "least")
    shared = member.join(first_of, "id").where("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    links = links.unionByName(shared)
    found = components(links)

    placed = crowded.select("band", "id", "n").join(found, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    parts = placed.groupBy("band", "component").count()
    groups = parts.groupBy("band").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("parts"),
                                       F.sum("count").alias("members"), F.max("count").alias("largest")).where("parts > 1")
    split = stored(placed.join(groups, "band").select("band", "id", "n", "component", "main", "members", "largest"), "split")
    more = stored(across(split, texts, words, percent), "links")
    if more.limit(1).count():
        found = components(links.unionByName(more))
    found = stored(found, "components")
    named_rows = member.join(found, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("component"))
    named_rows = named_rows.groupBy("id").agg(F.min("component").alias("component"))
    out = rows.select(F.col("id"), "n").join(named_rows, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"),
                      F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
