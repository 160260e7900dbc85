"""Groups of spelling variants by PartEnum signatures.

A word's multiset of letters is a binary vector: one dimension for each letter and each time it occurs. A letter put in or
taken out changes one dimension and a letter replaced two, so words one edit apart have vectors at a Hamming distance of
at most two. The dimensions are dealt over PARTS parts; two vectors at that distance agree on all but two parts. A
signature for each choice of PARTS - 2 parts holds exactly what the vector has there: words that are near share a
signature, and an equi-join on signatures misses none. Each pair that meets is verified by its edit distance.

Words with the same letters in another order share all signatures. So a signature goes together with one half of the
word: of two words one edit apart, the shorter of length m, one is also equal in the first m // 2 or the last m // 2
letters. That is exact too, and it keeps the groups of the join small.
"""

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from lapforge.llm.common import stored

PARTS, DISTANCE = 4, 2
LATIN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = LATIN, least_letters: int = LEAST_LETTERS,
                least_count: int = LEAST_COUNT, reading: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n): the words of at least least_letters code points that occur least_count times or more in all texts.

    A word is a longest run of pattern with A-Z lower-cased; reading(id, run), if given, is what is counted in its stead. Null
    and empty texts have none. Words are summed before the shuffle, so a very common one is no hot key.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text_col), CAPITALS, CAPITALS.lower()), F.lit(f"({pattern})"), F.lit(1))
    each = df.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    word = reading(F.col("id"), F.col("run")) if reading else F.col("run")
    counts = each.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def letter_dimensions(word: Column) -> Column:
    """The dimensions that are set in the vector of a word: its letters in order, each with how often it came before."""
    letters = F.array_sort(F.split(word, ""))
    return F.transform(letters, lambda x, i: F.concat(x, (i + 1 - F.array_position(letters, x)).cast("string")))


def part_enum(words: DataFrame) -> DataFrame:
    """(signature, word, n, is_short): the signatures of each word, with either half of it, for pairs whose shorter word has
    its length (is_short) and for those whose shorter word has one letter less."""
    def part(p: int) -> Column:
        return F.array_join(F.filter("dimensions", lambda x: F.pmod(F.xxhash64(x), F.lit(PARTS)) == p), ",")

    parts = words.select("word", "n", letter_dimensions(F.col("word")).alias("dimensions")).select(
        "word", "n", F.array(*map(part, range(PARTS))).alias("part"), F.length("word").alias("m"))
    kept = list(combinations(range(PARTS), PARTS - DISTANCE))

    def halves(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        return [F.struct(m.alias("shorter"), F.lit(side).alias("side"), F.substring("word", start, half).alias("half"))
                for side, start in ((0, F.lit(1)), (1, F.col("m") - half + 1))]

    ways = parts.select("word", "n", "part", "m", F.explode(F.array(*halves(F.col("m")), *halves(F.col("m") - 1))).alias("way"))
    # a hash of the parts stands for them: should two signatures collide, the pairs are verified like any other
    signatures = F.array(*(F.xxhash64(F.lit(k), *(F.col("part")[p] for p in own), "way.shorter", "way.side", "way.half") for k, own in enumerate(kept)))
    return ways.select(F.explode(signatures).alias("signature"), "word", "n", (F.col("way.shorter") == F.col("m")).alias("is_short"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), once each way: the words (word, n) that differ by one code point put in, taken out or replaced.

    Pairs are looked at inside the join and leave it only when they are near, so no list of candidates is written. Both sides
    are shuffled: Spark sizes the 24 rows of a word by the compressed file of the words, and would broadcast what no driver holds.
    """
    rows = part_enum(words)
    short = rows.where("is_short").select("signature", F.col("word").alias("a"), F.col("n").alias("n_a"))
    other = rows.select("signature", F.col("word").alias("b"), F.col("n").alias("n_b"), "is_short")
    met = short.hint("merge").join(other.hint("merge"), "signature").where((~F.col("is_short") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    once = met.select("a", "n_a", "b", "n_b").distinct()
    turn = F.array(F.struct("a", "n_a", "b", "n_b"), F.struct(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    return once.select(F.explode(turn).alias("p")).select("p.*")


def rounds_needed(most: int | None, ratio: int, least: int) -> int:
    """Doublings until the longest chain of forms is followed: each form is ratio times as frequent as the word before it."""
    longest = 0
    while least * ratio ** (longest + 1) <= (most or 0):
        longest += 1
    return math.ceil(math.log2(longest)) if longest > 1 else 0


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of words (word, n), whose words are distinct.

    form is the near word of the largest n (ties: the smallest in code-point order) if that is at least ratio times the
    word's; root is where following forms ends, the word itself if it has none. Rows with a null word or n are left out,
    words shorter than two letters are near to nothing, other columns are not read. Empty table: no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = stored(words.where("word IS NOT NULL AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_pairs(words.where(F.length("word") > 1)).groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    out = words.join(best, F.col("word") == F.col("a"), "left").select(
        "word", F.when(enough, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.less")).alias("form_n"))
    out = stored(out, "forms")
    # a form is more frequent than its word, so the chains end; each round follows them twice as far. Stored words are sized by
    # their compressed files here, too, so they are never broadcast
    range_ = words.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    root = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(rounds_needed(range_["most"], ratio, max(range_["least"] or 1, 1))):
        step = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        root = stored(root.join(step.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return out.join(root.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
