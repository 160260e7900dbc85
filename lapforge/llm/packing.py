"""Best-fit decreasing packing of documents into fixed-length token sequences.

The packing needs only how many pieces there are of each length, at most `capacity` numbers. Bins of the same remaining
capacity are alike, so runs of bins are filled at once: a segment tree over the remaining capacities finds the tightest
one that fits in logarithmic time, and the result is the one that best-fit decreasing gives piece by piece. The plan is
a small table of runs; each piece finds its run by its length and its number among the pieces of that length.
"""

import os
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from lapforge.llm.common import free_name, numbered, stored, tidy

CAPACITY = 4096
END_ID = 1
CACHED_WORDS = 600_000  # of a worker, which keeps them from task to task
WORDS_PER_CALL = 256
TEXT_BYTES = 1 << 22


class Openings:
    """Segment tree over remaining capacities: which ones have open bins; runs of bins at each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.runs = [[] for _ in range(self.leaves)]

    def add(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            self.runs[room].append((first, bins))
            node = room + self.leaves
            while node and not self.some[node]:
                self.some[node] = 1
                node //= 2

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            node = room + self.leaves
            self.some[node] = 0
            while node > 1:
                node //= 2
                self.some[node] = self.some[2 * node] | self.some[2 * node + 1]
        return run

    def tightest(self, length: int) -> int:
        """The smallest remaining capacity of at least length that has an open bin; 0 if there is none."""
        node = length + self.leaves
        while not self.some[node]:
            while node & 1:  # a right child: all to the right of it is under an ancestor's sibling
                node //= 2
            if node <= 1:
                return 0
            node += 1
        while node < self.leaves:
            node = 2 * node if self.some[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, last, bin, each, offset) for counts of pieces by length (1 .. capacity).

    Piece number i of a length (first <= i < last) lies in bin + (i - first) // each, at offset + (i - first) % each * length.
    """
    tree, out, bins = Openings(capacity), [], 0

    def fill(length, done, left, first, free, room):
        """Put up to left pieces into the run of bins; returns how many."""
        each = room // length
        whole = min(free, left // each)
        if whole:
            out.append((length, done, done + whole * each, first, each, capacity - room))
            tree.add(room - each * length, first, whole)
        rest = left - whole * each if whole < free else 0
        rest = min(rest, each)
        if rest:
            out.append((length, done + whole * each, done + whole * each + rest, first + whole, each, capacity - room))
            tree.add(room - rest * length, first + whole, 1)
        tree.add(room if room < capacity else 0, first + whole + bool(rest), free - whole - bool(rest))
        return whole * each + rest

    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            room = tree.tightest(length)
            if room:
                first, free = tree.take(room)
            else:
                each = capacity // length
                room, first, free = capacity, bins, -(-(n - done) // each)
                bins += free
            done += fill(length, done, n - done, first, free, room)
    return out


# Latin letters that are whole characters already and have one lower-case form, then ASCII marks but the apostrophe, which can begin a
# pre-token of its own with letters: a run of the one and a run of the other are one pre-token each, and nothing in them is normalised.
PARTS = r"^(?P<letters>[a-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values from each start on, as many as its size says, one run after the other."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return values[at]


class WordIds(dict):
    """Numbers of words, and the ids that each number stands for. Words end at white space, which the vocabulary drops and never joins
    across; a run of letters and a run of marks in a word count as words of their own."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers as P
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # texts are cut at the literals before; a word that lower-cases to one is not one
        added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {k: added[k] for k in sorted(added, key=len, reverse=True)}
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, self.special)) + b")") if self.special else None
        self.single = Tokenizer(self.tokenizer.model)  # for what is one pre-token already
        self.single.pre_tokenizer = P.Sequence([P.WhitespaceSplit(), P.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[""] = 0
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(2, np.int64)  # the ids of number k end at ends[k + 1]

    def learn(self, words: list[str], whole: bool) -> None:
        """Know the ids of words, encoded many at a time with spaces between. whole: they are one pre-token each and in lower case;
        of others, a token's offset tells the word."""
        ids, sizes = [self.ids], []
        for at in range(0, len(words), WORDS_PER_CALL):
            part = words[at:at + WORDS_PER_CALL]
            got = (self.single if whole else self.tokenizer).encode(" ".join(part), add_special_tokens=False)
            ids.append(np.array(got.ids, np.int32))
            if whole:
                sizes.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
            else:
                starts = np.fromiter((x for x, _ in got.offsets), np.int64)
                sizes.append(np.diff(np.searchsorted(starts, np.cumsum([len(w) + 1 for w in part])), prepend=0))
        if words:
            self.update(zip(words, range(len(self.ends) - 1, len(self.ends) - 1 + len(words))))
            self.ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(np.concatenate(sizes))])
            self.ids = np.concatenate(ids)

    def numbers(self, words, whole: bool) -> np.ndarray:
        """The number of each word of an Arrow array."""
        import pyarrow as pa
        import pyarrow.compute as pc
        coded = words.dictionary_encode()
        if not len(coded.dictionary):
            return np.zeros(0, np.int64)
        offsets = pa.array([0, len(coded.dictionary)], pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, coded.dictionary.cast(pa.binary())), b" ")[0].as_py()
        distinct = joined.decode("utf-8", "replace").split(" ")
        self.learn(list({w: None for w in distinct if w not in self}), whole)
        return np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]

    def text_ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of texts, one after the other, and how many each text has."""
        import pyarrow.compute as pc
        if len(self) > CACHED_WORDS:
            self.forget()
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        parts = pc.extract_regex(words, PARTS)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        parts, pairs = parts.drop_null(), np.zeros((len(words), 2), np.int64)
        pairs[plain, 0] = self.numbers(pc.utf8_lower(parts.field("letters")), whole=True)
        pairs[plain, 1] = self.numbers(parts.field("marks"), whole=True)
        pairs[~plain, 0] = self.numbers(words.filter(~plain), whole=False)
        each = self.ends[pairs + 1] - self.ends[pairs]
        ids, each = gathered(self.ids, self.ends[pairs].ravel(), each.ravel()), each.sum(axis=1)
        word = coded.indices.to_numpy()
        sizes = each[word]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return gathered(ids, (np.cumsum(each) - each)[word], sizes), np.diff(upto[lists.offsets.to_numpy()])


_loaded: dict[str, WordIds] = {}


def token_pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, special_tokens: bool = False) -> DataFrame:
    """Pieces (id_col, piece, start, length, ids, ids_crc32) of every whole text's ids and end_id.

    Only documents of more than capacity ids are cut, each cut after capacity ids. Null or empty text: one piece with
    end_id. ids_crc32 is the checksum of the ids as little-endian unsigned 32-bit numbers. With special_tokens, a special
    token's literal in a text is that token, as for the tokenizer by itself; without, it is text like any other.
    """
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("ids_crc32", T.LongType())])

    def cut(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        words = _loaded.get(tokenizer_path) or _loaded.setdefault(tokenizer_path, WordIds(tokenizer_path))

        def split(texts, words):
            """Parts of the texts between special literals, the id behind each part, and the place of each text's last part."""
            if not special_tokens or not any(pc.any(pc.match_substring(texts, x)).as_py() for x in words.special):
                return texts, end_id, np.arange(len(texts))
            cuts = [words.cut.split(x) for x in texts.cast(pa.binary()).to_pylist()]
            behind = [i for own in cuts for i in (*map(words.special.__getitem__, own[1::2]), end_id)]
            parts = pa.array([x for own in cuts for x in own[::2]], pa.binary())
            return parts.view(pa.string()), behind, np.cumsum([(len(own) + 1) // 2 for own in cuts]) - 1

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).fill_null("")
            edges, held = [0], 0
            for i, size in enumerate(pc.binary_length(texts).to_pylist()):  # documents of about TEXT_BYTES at a time
                held += size
                if held > TEXT_BYTES or i == len(texts) - 1:
                    edges.append(i + 1)
                    held = 0
            for first, last in zip(edges, edges[1:]):
                # Each part of a text has one id behind it: that of a special token, or end_id.
                parts, behind, closing = split(texts.slice(first, last - first), words)
                found, sizes = words.text_ids(parts)
                ends = np.cumsum(sizes + 1)
                ids, own = np.empty(len(found) + len(sizes), np.int32), np.ones(len(found) + len(sizes), bool)
                own[ends - 1] = False
                ids[own], ids[ends - 1] = found, behind
                rows, begin, raw = [], 0, ids.astype("<u4")
                for i, end in enumerate(ends[closing].tolist(), first):
                    for piece, at in enumerate(range(begin, end, capacity)):
                        upto = min(at + capacity, end)
                        rows.append((i, piece, at - begin, upto - at, zlib.crc32(raw[at:upto])))
                    begin = end
                at, piece, start, length, crc = zip(*rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                                  pa.array(length, pa.int64()), lists, pa.array(crc, pa.int64())], names=schema.names)

    if not os.path.exists(tokenizer_path):
        raise FileNotFoundError(tokenizer_path)
    return df.select(id_col, text_col).mapInArrow(tidy(cut), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: list[str] | None = None, chunk_rows: int = 20_000) -> DataFrame:
    """pieces (with `length`, 1 .. capacity) with `sequence_id` and `offset`, packed by best-fit decreasing.

    Only the counts by length reach the driver: at most capacity rows. Pieces of one length are told apart by `order`
    (default: all columns but arrays); equal pieces take any of their places. Repeated rows: each gets its own place.
    Empty table: no rows. A null length or one outside 1 .. capacity ends the job with a message.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(k is None or not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths must be in 1 .. {capacity}")
    pieces = pieces.drop("sequence_id", "offset")
    order = order or [f.name for f in pieces.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType))]
    nth = free_name(pieces, "nth")
    runs = spark.createDataFrame(best_fit_decreasing(counts, capacity),
                                 "run_length long, first long, last long, bin long, each long, base long")
    n = numbered(pieces, ["length"], [F.col(c) for c in order], F.xxhash64(*order), nth, chunk_rows)
    since = F.col(nth) - F.col("first")
    # the plan's size depends on capacity alone, not on the number of documents
    met = n.join(F.broadcast(runs), (n["length"] == runs["run_length"]) & (n[nth] >= runs["first"]) & (n[nth] < runs["last"]), "left")
    return met.select(*(n[c] for c in pieces.columns), (F.col("bin") + F.floor(since / F.col("each"))).cast("long").alias("sequence_id"),
                      (F.col("base") + since % F.col("each") * n["length"]).cast("long").alias("offset"))


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   end_id: int = END_ID, special_tokens: bool = False) -> DataFrame:
    """Tokenize whole texts and pack the pieces: id_col, piece, start, length, ids, ids_crc32, sequence_id, offset."""
    pieces = stored(token_pieces(df, tokenizer_path, id_col, text_col, capacity, end_id, special_tokens), "pieces")
    return pack(pieces, capacity, order=[id_col, "piece", "ids_crc32"])
