"""A Merkle manifest of a dataset, with a proof for each row, over bitmap ranks instead of a sort.

The ids of each group are held as bitmaps of 65,536 ids, compressed: few ids as a list of 16-bit numbers, many as bits
with a directory of popcounts. Tasks make them from the rows they have; merging is a bitwise or. An id's rank, which is
its leaf's place in the group, is the row count of the bitmaps before its own plus a popcount. Ids that several rows
share are counted in further planes of bitmaps, one for each binary digit of the number of extra rows, so ranks stay sums.

Leaves then go to slot arrays keyed by their place, 4,096 in each, and every array is reduced by twelve levels in its
task. The same is done with the arrays' tops until each group has one, and with the groups' subroots. Paths go the other
way: an array gets the siblings above it and adds its own.
"""

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lapforge.llm.common import free_name, stored, tidy
from lapforge.operators.ordered import HOT_ROWS, hot_groups, positions, prefix_sums
from lapforge.session import lookup

BITS, LEVELS = 16, 12
SPAN, SLOTS = 1 << BITS, 1 << LEVELS
LISTED = 4096  # ids up to which a bitmap is a list
CHUNK_ROWS, SALT_ROWS = 1 << 16, 200_000
NO_ID = -(1 << 47) - 1  # bitmap number of rows without an id: before all others
HEAD = -1  # place of the path of a group's last array
PRESENT = -1  # the plane that marks which ids there are


def field(value: Column) -> Column:
    """A value as it enters a leaf: its length in bytes, a colon and the value, or - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- bitmaps ----

def packed(low: np.ndarray) -> bytes:
    """A set of numbers below SPAN: a list of 16-bit numbers, or bits."""
    if len(low) <= LISTED:
        return b"l" + np.sort(low).astype("<u2").tobytes()
    bits = np.zeros(SPAN, np.uint8)
    bits[low] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


class Ranks:
    """The union of packed sets, which tells how many members are below a number, and which numbers are members."""

    def __init__(self, sets: list[bytes]):
        lists = [np.frombuffer(s, "<u2", offset=1) for s in sets if s[:1] == b"l"]
        self.members = None
        if len(lists) == len(sets) and sum(map(len, lists)) <= LISTED:
            self.members = np.unique(np.concatenate(lists)).astype(np.int64) if lists else np.empty(0, np.int64)
            return
        words = np.zeros(SPAN // 64, np.uint64)
        for s in sets:
            if s[:1] == b"b":
                words |= np.frombuffer(s, "<u8", offset=1)
        for own in lists:
            np.bitwise_or.at(words, own >> 6, np.uint64(1) << (own & 63).astype(np.uint64))
        self.words, self.before = words, np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    def below(self, x: np.ndarray) -> np.ndarray:
        if self.members is not None:
            return np.searchsorted(self.members, x)
        mask = (np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[x >> 6] + np.bitwise_count(self.words[x >> 6] & mask).astype(np.int64)

    def has(self, x: np.ndarray) -> np.ndarray:
        if self.members is not None:
            return np.isin(x, self.members)
        return (self.words[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1) == 1


def bitmaps(counts: DataFrame) -> DataFrame:
    """(g, bucket, plane, rows, bits): what each task's rows of counts (g, bucket, low, n) add to the bitmaps. rows is in the PRESENT plane only."""
    def make(batches):
        import pyarrow as pa
        for batch in batches:
            t = pa.Table.from_batches([batch])
            g = t.column("g").combine_chunks().dictionary_encode()
            code, bucket, low, n = np.asarray(g.indices), *(np.asarray(t.column(c)) for c in ("bucket", "low", "n"))
            order = np.lexsort((bucket, code))
            code, bucket, low, n = code[order], bucket[order], low[order], n[order]
            edges = np.flatnonzero(np.diff(code) | np.diff(bucket)) + 1
            names, out = g.dictionary.to_pylist(), []
            for a, b in zip([0, *edges], [*edges, len(code)]):
                if a == b:
                    continue
                own, more = low[a:b], n[a:b] - 1
                row = names[code[a]], int(bucket[a])
                out.append((*row, PRESENT, int(more.sum()) + b - a, packed(own)))
                out += [(*row, k, 0, packed(own[more >> k & 1 == 1])) for k in range(int(more.max()).bit_length()) if (more >> k & 1).any()]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                                             names=["g", "bucket", "plane", "rows", "bits"])

    return counts.select("g", "bucket", "low", "n").mapInArrow(tidy(make), "g string, bucket long, plane int, rows long, bits binary")


def _rank(left, right):
    """Places of the rows of one chunk of bitmaps: (.., start, same): rows of the group before its id, and rows with its id."""
    import pyarrow as pa
    bucket, low = np.asarray(left.column("bucket")), np.asarray(left.column("low"))
    start, same = np.zeros(len(bucket), np.int64), np.ones(len(bucket), np.int64)
    sets, base = {}, {}
    for b, plane, bits, at in zip(*(right.column(c).to_pylist() for c in ("bucket", "plane", "bits", "base"))):
        sets.setdefault(b, {}).setdefault(plane, []).append(bits)
        base[b] = at
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, edges) if len(order) else []:
        b, x = int(bucket[rows[0]]), low[rows]
        start[rows] = base[b]
        for plane, own in sets[b].items():
            ranks, weight = Ranks(own), 1 << max(plane, 0)
            start[rows] += weight * ranks.below(x)
            if plane != PRESENT:
                same[rows] += weight * ranks.has(x)
    keep = left.select(["g", "id", "leaf", "claimed", "copies", "total"])
    return keep.append_column("start", pa.array(start)).append_column("same", pa.array(same))


def places(leaves: DataFrame) -> DataFrame:
    """(g, id, leaf, claimed, pos, total): each leaf's place in its group, ids ascending (null first), and the group's row count.

    Rows that share an id follow one another by their leaf; equal rows take any of their places.
    """
    bucket = F.coalesce(F.shiftright("id", BITS), F.lit(NO_ID)).alias("bucket")
    low = F.coalesce(F.col("id").bitwiseAND(SPAN - 1), F.lit(0)).alias("low")
    rows = stored(leaves.groupBy("g", "id", "leaf", "claimed").agg(F.count("*").alias("copies")), "leaves")
    counts = rows.groupBy("g", "id").agg(F.sum("copies").alias("n")).select("g", bucket, low, "n")
    maps = stored(bitmaps(counts), "bitmaps")
    sizes = maps.groupBy("g", "bucket").agg(F.sum("rows").alias("rows"))
    sums = prefix_sums(sizes, ["g"], ["bucket"], ["rows"], hot_groups(sizes, ["g"], HOT_ROWS))
    before = F.col("rows_upto") - F.col("rows")
    directory = lookup(sums.select(F.col("g").alias("dg"), F.col("bucket").alias("db"), before.alias("base"), F.col("rows_total").alias("total"),
                                   F.floor(before / CHUNK_ROWS).alias("chunk"), F.ceil(F.col("rows") / SALT_ROWS).cast("int").alias("salts")))
    # bitmaps that follow one another share a task; a bitmap of very many rows (of few ids) is met by several
    asked = rows.select("g", "id", bucket, low, "leaf", "claimed", "copies")
    asked = asked.join(directory, (F.col("g") == F.col("dg")) & (F.col("bucket") == F.col("db"))).select(
        "g", "id", "bucket", "low", "leaf", "claimed", "copies", "total", "chunk", F.pmod(F.xxhash64("leaf"), F.col("salts")).cast("int").alias("salt"))
    held = maps.join(directory, (F.col("g") == F.col("dg")) & (F.col("bucket") == F.col("db"))).select(
        F.col("g").alias("map_g"), F.col("chunk").alias("map_chunk"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("map_salt"),
        "bucket", "plane", "bits", F.col("base").alias("base"))
    found = asked.groupBy("g", "chunk", "salt").cogroup(held.groupBy("map_g", "map_chunk", "map_salt")).applyInArrow(
        _rank, "g string, id long, leaf binary, claimed binary, copies long, total long, start long, same long")
    found = stored(found, "ranks")
    alone = found.where("same = copies")
    mixed = found.where("same > copies")
    if mixed.limit(1).count():  # an id with different rows: they follow each other by leaf
        order = ["leaf", "claimed"]
        upto = prefix_sums(mixed, ["g", "start"], order, ["copies"], hot_groups(mixed, ["g", "start"], HOT_ROWS))
        upto = upto.withColumn("start", F.col("start") + F.col("copies_upto") - F.col("copies")).select(found.columns)
        alone = alone.unionByName(upto)
    each = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("copies") - 1)).alias("pos")
    return alone.select("g", "id", "leaf", "claimed", each, "total")


# ---- slot arrays ----

def reduced(nodes: list[str], total: int) -> list[list[str]]:
    """The levels over nodes: LEVELS of them if the array is one of many, as many as it takes to one node if it is the only one."""
    levels = [nodes]
    while len(levels) <= LEVELS if total > SLOTS else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return levels


def hexes(blob: bytes) -> list[str]:
    text = blob.hex()
    return [text[i:i + 64] for i in range(0, len(text), 64)]


def _array(table):
    """One slot array as a row: (g, block, total, ids, leaves, claims, top)."""
    import pyarrow as pa
    pos, size = np.asarray(table.column("pos")), len(table)
    slot = pa.array(np.argsort(pos & (SLOTS - 1)))  # where the slots' rows are
    table = table.take(slot)
    own = table.column("leaf").to_pylist()
    claims = [c or d for c, d in zip(table.column("claimed").to_pylist(), own)]
    total, leaves = table.column("total")[0].as_py(), b"".join(own)
    top = reduced(hexes(leaves), total)[-1][0]
    ids = table.column("id").combine_chunks()
    return pa.table({"g": table.column("g").slice(0, 1), "block": pa.array([int(pos[0]) >> LEVELS]), "total": pa.array([total]),
                     "ids": pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), ids), "leaves": pa.array([leaves]),
                     "claims": pa.array([b"".join(claims)]), "top": pa.array([bytes.fromhex(top)])})


ARRAY = "g string, block long, total long, ids array<long>, leaves binary, claims binary, top binary"
PATH = "g string, pos long, subroot string, root string, sides string, siblings string"
PROOF = "g string, id long, pos long, leaf string, subroot string, root string, siblings string, proof_sha256 string, folded_root string"


def arrays(nodes: DataFrame) -> list[DataFrame]:
    """Slot arrays, level by level, of nodes (g, pos, total, leaf, id, claimed) until every group has a single one."""
    out = []
    while True:
        block = F.shiftright("pos", LEVELS).alias("block")
        out.append(stored(nodes.groupBy("g", block).applyInArrow(_array, ARRAY), "arrays"))
        nodes = out[-1].where(F.col("total") > SLOTS).select(
            "g", F.col("block").alias("pos"), F.ceil(F.col("total") / SLOTS).cast("long").alias("total"), F.col("top").alias("leaf"),
            F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claimed"))
        if not nodes.limit(1).count():
            return out


def tops(levels: list[DataFrame]) -> DataFrame:
    """(g, top): the node that each group's arrays end in."""
    out = [x.where(F.col("total") <= SLOTS).select("g", "top") for x in levels]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def fold(node: str, sides: str, siblings: str) -> str:
    """The node at the end of a path: sides has L, R or - (no sibling) for each level, siblings their digests one after the other."""
    at = 0
    for side in sides:
        if side == "-":
            node = digest(node)
            continue
        other = siblings[at:at + 64]
        at += 64
        node = digest(other, node) if side == "L" else digest(node, other)
    return node


def _paths(batch):
    """(position in the array, array's row, sides, siblings) for each node of each array, siblings above the array included."""
    for k, row in enumerate(batch.to_pylist()):
        nodes = hexes(row["leaves"])
        levels = reduced(nodes, row["total"])[:-1]
        for i in range(len(nodes)):
            sides, siblings = [], []
            for up, level in enumerate(levels):
                j = (i >> up) ^ 1
                if j < len(level):
                    sides.append("L" if j < i >> up else "R")
                    siblings.append(level[j])
                else:
                    sides.append("-")
            yield i, row, nodes[i], "".join(sides) + row["sides"], "".join(siblings) + row["siblings"]


def _expand(batches):
    import pyarrow as pa
    for batch in batches:
        for one in range(batch.num_rows):
            rows = [(row["g"], row["block"] * SLOTS + i, row["subroot"], row["root"], sides, siblings)
                    for i, row, _, sides, siblings in _paths(batch.slice(one, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), *[pa.string()] * 4))],
                                             names=["g", "pos", "subroot", "root", "sides", "siblings"])


def _prove(with_siblings: bool):
    def run(batches):
        import pyarrow as pa
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6]
        names = [x.split()[0] for x in PROOF.split(", ")]
        for batch in batches:
            for one in range(batch.num_rows):
                part = batch.slice(one, 1)
                claims, ids = hexes(part.column("claims")[0].as_py()), part.column("ids")[0].as_py()
                rows = [(row["g"], ids[i], row["block"] * SLOTS + i, own, row["subroot"], row["root"], siblings if with_siblings else None,
                         digest(siblings), fold(claims[i], sides, siblings)) for i, row, own, sides, siblings in _paths(part)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    return tidy(run)


def with_path(level: DataFrame, path: DataFrame) -> DataFrame:
    path = lookup(path.select(F.col("g").alias("pg"), F.col("pos").alias("pb"), "subroot", "root", "sides", "siblings"))
    block = F.when(F.col("total") <= SLOTS, F.lit(HEAD)).otherwise(F.col("block"))
    return level.join(path, (F.col("g") == F.col("pg")) & (block == F.col("pb"))).drop("pg", "pb")


def downwards(levels: list[DataFrame], heads: DataFrame) -> DataFrame:
    """The arrays of the lowest level, each with the path above it. heads: the path (PATH, pos HEAD) of each group's last array."""
    path = heads
    for below in reversed(levels[1:]):
        path = heads.unionByName(with_path(below, path).mapInArrow(tidy(_expand), PATH))
    return with_path(levels[0], path)


def manifest(df: DataFrame, id_col: str, group_col: str, leaf_hex: Column, claimed_hex: Column | None = None, siblings: bool = False) -> DataFrame:
    """A row for each row of df: its place in the tree, its proof, and what its claim folds to.

    Returns id_col, group_col, position, leaf, subroot, root, siblings (null unless asked for: the digests of the proof, one
    after the other), proof_sha256, folded_root, verified. leaf_hex is the leaf's digest in hexadecimal; claimed_hex, where not
    null, is the one to be checked against the tree instead. Groups are strings, in byte order, null first; ids are whole
    numbers. Rows without an id come first in their group; rows that share an id follow one another by leaf, so the root does
    not depend on the order of the input. Empty table: no rows. Other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    claim = F.lit(None).cast("string") if claimed_hex is None else claimed_hex
    leaves = df.select(key.alias("g"), F.col(id_col).cast("long").alias("id"), F.unhex(leaf_hex).alias("leaf"), F.unhex(claim).alias("claimed"))
    levels = arrays(places(leaves))
    subroots = stored(positions(tops(levels), ["g"], "pos"), "subroots")
    # the groups are the leaves of one more tree; a group's key comes back by its place
    upper = arrays(subroots.select(F.lit("").alias("g"), "pos", F.col("pos_total").alias("total"), F.col("top").alias("leaf"),
                                   F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claimed")))
    root = tops(upper).select(F.lit("").alias("g"), F.lit(HEAD).cast("long").alias("pos"), F.lit("").alias("subroot"), F.lower(F.hex("top")).alias("root"),
                              F.lit("").alias("sides"), F.lit("").alias("siblings"))
    ways = downwards(upper, root).mapInArrow(tidy(_expand), PATH)
    heads = stored(subroots.join(ways.drop("g", "subroot"), "pos").select(
        "g", F.lit(HEAD).cast("long").alias("pos"), F.lower(F.hex("top")).alias("subroot"), "root", "sides", "siblings"), "heads")
    proofs = downwards(levels, heads).mapInArrow(_prove(siblings), PROOF)
    group = F.when(F.col("g") != "", F.expr("substring(g, 2)"))
    return proofs.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), group.alias(group_col), F.col("pos").alias("position"), "leaf", "subroot",
                         "root", "siblings", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
