"""Toxicity by nearest labelled examples.

A bounded sample of labelled documents gives the vocabulary (terms that stand out in toxic examples) and the examples.
Document frequencies are counted over all documents. A document's neighbours are the examples of largest TF-IDF cosine,
found exactly: an inverted index in blocks keeps the largest weight of each term in a block, blocks are opened in the
order of their bounds, and the search ends at the first block whose bound is below the k-th similarity. Neighbours vote
with weights that fall with distance, and the votes are calibrated on the examples, each left out in turn.
"""

import math
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lapforge.llm.common import free_name, tidy, turns

EXAMPLES = 20_000
NEIGHBOURS = 15
BLOCK = 64
PRIOR_VOTE = 1.0
LEAST_EXAMPLES = 3
PREFIXES = (4, 5)
CACHED_WORDS = 100_000
COUNTED_TERMS = 100_000
THRESHOLD = 0.7
SPLITS = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased runs of letters and digits (any character outside ASCII counts as a letter)."""
    return text.lower().encode("utf-8", "replace").translate(SPLITS).split()


def terms_of(word: bytes) -> list[bytes]:
    """Terms of a word: itself, and its first bytes, which its inflections share."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


class Terms(dict):
    """The vocabulary's term numbers in a word; words are looked up once."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> tuple:
        if len(self) > CACHED_WORDS:
            self.clear()
        found = tuple(self.vocabulary[t] for t in terms_of(word) if t in self.vocabulary)
        self[word] = found
        return found

    def counted(self, text: str) -> tuple[tuple, tuple]:
        """Term numbers in a text, ascending, and how often each occurs."""
        found = Counter(chain.from_iterable(map(self.__getitem__, words(text))))
        t = tuple(sorted(found))
        return t, tuple(found[x] for x in t)


def held_out(doc_id):
    """Rows that labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


class Index:
    """Examples by vector: block-max inverted index with exact search. Equal vectors are one entry that counts its examples."""

    def __init__(self, vocabulary: dict[bytes, int], idf: np.ndarray, rows: list[tuple[int, int, tuple, tuple]]):
        """rows: (doc_id, toxic, term numbers, term counts), terms ascending."""
        self.terms, self.idf = Terms(vocabulary), idf
        merged: dict = {}
        self.bare = [0, 0]
        for doc, toxic, t, n in sorted(rows):
            if not t:
                self.bare[0] += toxic
                self.bare[1] += 1
                continue
            entry = merged.setdefault((tuple(t), tuple(n)), [doc, 0, 0])
            entry[1] += toxic
            entry[2] += 1
        keys = sorted(merged, key=lambda k: (k[0], k[1]))  # like vectors side by side make tight blocks
        self.doc, self.toxic, self.count = (np.array([merged[k][i] for k in keys], np.int64) for i in range(3))
        self.own = {k: i for i, k in enumerate(keys)}
        self.blocks = -(-len(keys) // BLOCK)
        entry, term, weight = [], [], []
        for i, (t, n) in enumerate(keys):
            entry.append(np.full(len(t), i))
            term.append(np.array(t))
            weight.append(self.weights(t, n))
        self.postings, self.tops = {}, {}
        if keys:
            entry, term, weight = np.concatenate(entry), np.concatenate(term), np.concatenate(weight)
            order = np.argsort(term, kind="stable")
            entry, term, weight = entry[order], term[order], weight[order]
            edges = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(term))):
                e, w = entry[a:b], weight[a:b]
                starts = np.flatnonzero(np.append(True, e[1:] // BLOCK != e[:-1] // BLOCK))
                self.postings[int(term[a])] = (e, w)
                self.tops[int(term[a])] = (e[starts] // BLOCK, np.maximum.reduceat(w, starts), np.append(starts, len(e)))
        self.steps = [(0.0, 0.0), (1.0, 1.0)]
        self.known: dict = {}

    def weights(self, t, n) -> np.ndarray:
        w = (1 + np.log(np.array(n, np.float64))) * self.idf[list(t)]
        return w / max(math.sqrt(float(w @ w)), 1e-12)

    def nearest(self, t, n, k: int = NEIGHBOURS, left_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The entries of the k largest cosines (ties to the smaller entry) and the cosines; entry left_out does not count."""
        q = self.weights(t, n)
        bound = np.zeros(self.blocks)
        used = [(x, w) for x, w in zip(t, q) if x in self.tops and w > 0]
        for x, w in used:
            at, top, _ = self.tops[x]
            bound[at] += w * top
        open_ = np.flatnonzero(bound > 0)
        open_ = open_[np.argsort(-bound[open_], kind="stable")]
        best_i, best_s = np.empty(0, np.int64), np.empty(0)
        for b in open_:
            if len(best_s) == k and bound[b] < best_s[-1] - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for x, w in used:
                at, _, starts = self.tops[x]
                j = np.searchsorted(at, b)
                if j < len(at) and at[j] == b:
                    e, p = self.postings[x]
                    scores[e[starts[j]:starts[j + 1]] - b * BLOCK] += w * p[starts[j]:starts[j + 1]]
            here = np.flatnonzero(scores > 0)
            i, s = here + b * BLOCK, scores[here]
            i, s = np.append(best_i, i[i != left_out]), np.append(best_s, s[i != left_out])
            keep = np.lexsort((i, -np.round(s, 12)))[:k]
            best_i, best_s = i[keep], s[keep]
        return best_i, best_s

    def vote(self, t, n, leave: int = -1) -> tuple[float, list]:
        """Share of distance-weighted votes for toxic, and the neighbours. leave: the label (0 or 1) of the example that asks, which
        does not vote for itself."""
        me = self.own.get((tuple(t), tuple(n)), -1) if leave >= 0 else -1
        drop = me if me >= 0 and self.count[me] == 1 else -1
        i, s = self.nearest(t, n, left_out=drop)
        if not len(i):
            return -1.0, []
        count, toxic = self.count[i].astype(np.float64), self.toxic[i].astype(np.float64)
        if me >= 0 and drop < 0:
            count[i == me] -= 1
            toxic[i == me] -= leave
        w = s / (1.05 - np.minimum(s, 1.0)) * np.log1p(count) / np.maximum(count, 1)
        # far neighbours alone weigh little against the rate among examples without any term
        share = (float((w * toxic).sum()) + PRIOR_VOTE * self.base()) / (float((w * count).sum()) + PRIOR_VOTE)
        return share, [(int(self.doc[x]), float(y), float(self.toxic[x] / self.count[x])) for x, y in zip(i[:3], s[:3])]

    def calibrate(self, asked: list[tuple[float, int]]) -> None:
        """Isotonic regression of labels on left-out votes, each level pulled a little towards the overall rate."""
        asked = sorted(x for x in asked if x[0] >= 0)
        if not asked:
            return
        rate = sum(y for _, y in asked) / len(asked)
        levels: list[list[float]] = []  # lowest vote, highest vote, toxic, all
        for v, y in asked:
            if levels and levels[-1][1] == v:
                levels[-1][2] += y
                levels[-1][3] += 1
            else:
                levels.append([v, v, y, 1])
            while len(levels) > 1 and levels[-2][2] * levels[-1][3] >= levels[-1][2] * levels[-2][3]:
                _, high, y1, n1 = levels.pop()
                levels[-1] = [levels[-1][0], high, levels[-1][2] + y1, levels[-1][3] + n1]
        self.steps = []
        for low, high, y, n in levels:
            p = (y + 2 * rate) / (n + 2)
            self.steps += [(low, p)] + ([(high, p)] if high > low else [])

    def score(self, text: str) -> tuple[float, list]:
        t, n = self.terms.counted(text)
        if not t:
            return self.base(), []
        if (t, n) not in self.known:
            share, near = self.vote(t, n)
            x, y = zip(*self.steps)
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[t, n] = (self.base(), near) if share < 0 else (float(np.interp(share, x, y)), near)
        return self.known[t, n]

    def base(self) -> float:
        """Rate among examples without any term of the vocabulary, with one example of either kind added to a prior of 1 in 100."""
        return (self.bare[0] + 0.01) / (self.bare[1] + 1)


def _stood_out(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Twice the log-likelihood ratio of a term's toxic share against the base rate; 0 if it is not above the base rate."""
    base, n = all_toxic / max(1, all_toxic + all_clean), toxic + clean
    p = toxic / n
    if p <= base or base in (0.0, 1.0):
        return 0.0
    return 2 * (toxic * math.log(p / base) + (clean * math.log((1 - p) / (1 - base)) if clean else 0.0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        examples: int = EXAMPLES) -> Index:
    """The index. examples bounds the labelled sample (those of smallest id hash); document frequencies are those of all docs.

    Labelled rows that are held out, unlabelled, or labelled twice with different labels teach nothing; equal texts teach once.
    """
    spark: SparkSession = docs.sparkSession
    i = F.col(id_col)
    known = labels.where(i.isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(i)).groupBy(id_col).agg(
        F.min(label_col).alias("toxic"), F.max(label_col).alias("most")).where("toxic = most").select(F.col(id_col).alias("known_id"), "toxic")
    picked = known.orderBy(F.xxhash64("known_id"), "known_id").limit(examples)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the sample is bounded by `examples` rows of two numbers
    sample = texts.join(F.broadcast(picked), F.col("id") == F.col("known_id")).select("id", "text", "toxic")
    sample = sample.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(
        F.min_by(F.struct("id", "text", "toxic"), "id").alias("x")).select("x.*")

    def term_counts(batches):
        import pyarrow as pa
        counts: dict = {}

        def out():
            names, n = zip(*counts.items())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([x[1] for x in n], pa.int64()), pa.array([x[0] for x in n], pa.int64())],
                                              names=["term", "toxic", "clean"])

        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                for w in {None, *chain.from_iterable(map(terms_of, set(words(text))))}:
                    counts.setdefault(w, [0, 0])[toxic] += 1
                if len(counts) > COUNTED_TERMS:  # partial counts, summed below
                    yield out()
        if counts:
            yield out()

    counts = sample.mapInArrow(tidy(term_counts), "term binary, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = counts.where(F.col("term").isNull() | (F.col("toxic") >= LEAST_EXAMPLES)).collect()
    total = next(((r["toxic"], r["clean"]) for r in counts if r["term"] is None), (0, 0))
    # as many terms are tried, so much has a term to stand out: about one of all would by chance
    least = 2 * math.log(max(2, len(counts))) + 2
    chosen = sorted(bytes(r["term"]) for r in counts if r["term"] is not None and _stood_out(r["toxic"], r["clean"], *total) >= least)
    vocabulary = {w: k for k, w in enumerate(chosen)}
    shared = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches):
        import pyarrow as pa
        known, df, n = Terms(shared.value), np.zeros(len(shared.value) + 1, np.int64), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                for k in set(chain.from_iterable(map(known.__getitem__, words(text)))):
                    df[k] += 1
                n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["k", "n"])

    # one row per term of the vocabulary, which the sample bounds
    df = {r["k"]: r["n"] for r in texts.select("text").mapInArrow(tidy(frequencies), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    n = df.get(len(chosen), 0)
    idf = np.array([math.log((n + 1) / (df.get(k, 0) + 1)) + 1 for k in range(len(chosen))])

    def vectors(batches):
        import pyarrow as pa
        known = Terms(shared.value)
        for b in batches:
            found = [known.counted(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("toxic"), pa.array([list(x[0]) for x in found], pa.list_(pa.int64())),
                                              pa.array([list(x[1]) for x in found], pa.list_(pa.int64()))], names=["id", "toxic", "t", "n"])

    kinds = {f.name: f.dataType for f in sample.schema.fields}
    schema = T.StructType([T.StructField("id", kinds["id"]), T.StructField("toxic", kinds["toxic"]), T.StructField("t", T.ArrayType(T.LongType())),
                           T.StructField("n", T.ArrayType(T.LongType()))])
    rows = [(r["id"], int(r["toxic"]), tuple(r["t"]), tuple(r["n"])) for r in sample.mapInArrow(vectors, schema).collect()]
    index = Index(vocabulary, idf, rows)
    with_terms = [r[1:] for r in rows if r[2]]
    if with_terms:
        base = spark.sparkContext.broadcast(index)

        def ask(batches):
            import pandas as pd
            for p in batches:
                yield pd.DataFrame({"share": [base.value.vote(tuple(t), tuple(n), int(y))[0] for y, t, n in zip(p["y"], p["t"], p["n"])], "y": p["y"]})

        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        asked = spark.createDataFrame([(y, list(t), list(n)) for y, t, n in with_terms], "y int, t array<long>, n array<long>").repartition(parts)
        index.calibrate([(r[0], r[1]) for r in asked.mapInPandas(ask, "share double, y int").collect()])
    return index


def score(docs: DataFrame, index: Index, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Columns `keep` of docs with score, predicted (1 from threshold up) and evidence (nearest examples: doc_id, similarity,
    toxic, the share of toxic among the examples of that vector).

    Null and empty texts, and texts without a term of the vocabulary: the rate among such examples, no evidence. Rows that
    repeat get equal scores. Empty table: no rows. Columns of docs called score, predicted or evidence are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    keep = [c for c in keep if c not in ("score", "predicted", "evidence")]
    asked = free_name(docs.select(*keep), "asked_text")
    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("toxic", T.DoubleType())]))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                           T.StructField("evidence", evidence)])

    def run(batches):
        import pyarrow as pa
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.float64())]))
        for b in (x for whole in batches for x in turns(whole, asked)):
            found = [shared.value.score(x or "") for x in b.column(asked).to_pylist()]
            scores = [min(1.0, max(0.0, s)) for s, _ in found]
            near = [[{"doc_id": d, "similarity": s, "toxic": t} for d, s, t in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                                              pa.array(near, kind)], names=[*keep, "score", "predicted", "evidence"])
        # the index stays with the worker for its next task; what it remembers of these texts goes
        shared.value.known.clear()
        shared.value.terms.clear()

    return docs.select(*keep, F.col(text_col).alias(asked)).mapInArrow(tidy(run), schema)
