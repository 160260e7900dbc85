"""Token counts by a whole-token shortcut.

A vocabulary's strings are tried out once, before any text is read: `whole_tokens` encodes each of them alone and keeps
those that the tokenizer's own normalising, splitting and merging turn into one token. Texts are then split into
pre-tokens only. A pre-token that is proven counts as one token without being merged; only the rest goes to the merges,
each distinct one once per task and cache fill. The tokenizer never joins across pre-tokens, so the sum is its own count.
"""

import json
import os
import re

from pyspark.sql import DataFrame, functions as F, types as T

from lapforge.llm.common import tidy

LIMIT = 2048
CACHED = 300_000  # merged pre-tokens a task remembers
LONGEST_CACHED = 200  # characters; longer ones are merged each time
SEGMENT = 1 << 20  # characters of a text that are split at a time

# Fixed values of the word-end vocabulary: its splitting pattern, and its classes among the characters below U+0180, which no
# release of Unicode moves. Characters from U+0180 up are left to the tokenizer's own classes.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS, DIGITS, BLANKS = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾", "\\x09-\\x0d\\x20\u0085 "
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{BLANKS}{LETTERS}{DIGITS}]+")
SETTLED = re.compile("[\x00-ſ]*")
ASCII_BLANKS = re.compile("[\x09-\x0d\x20]+")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Splitter:
    """A tokenizer file taken apart: special literals, pre-tokens, merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.word_ends = kinds == ["NFC", "Replace", "Lowercase"] and bool(parts) and parts[0].get("pattern") == {"Regex": WORD_PATTERN}
        if spec["model"]["type"] != "BPE" or "ByteLevel" not in json.dumps(spec.get("pre_tokenizer")):
            raise ValueError("a byte-level BPE tokenizer file is needed")
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, special))) if special else None
        self.letters = dict(enumerate(byte_letters()))
        self.model = self.tokenizer.model

    def letters_of(self, piece: str) -> str:
        """A pre-token as the vocabulary writes it."""
        if piece.isascii() and piece.isprintable() and " " not in piece:
            return piece
        return piece.encode().decode("latin-1").translate(self.letters)

    def pre_tokens(self, text: str) -> tuple[list[str], list[str]]:
        """Pre-tokens of a text without special literals: (as characters, as the vocabulary writes them)."""
        if not self.word_ends:
            return [], self.own_pre_tokens(text)
        if SETTLED.fullmatch(text):
            return SPLIT.findall(text.lower()), []
        # nothing is normalised or merged across ASCII white space, so words of settled characters need not wait for the others
        words = ASCII_BLANKS.split(text)
        settled = [bool(SETTLED.fullmatch(w)) for w in words]
        return (SPLIT.findall(" ".join(w for w, s in zip(words, settled) if s).lower()),
                self.own_pre_tokens(" ".join(w for w, s in zip(words, settled) if not s)))

    def own_pre_tokens(self, text: str) -> list[str]:
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def merged(self, letters: str) -> int:
        return len(self.model.tokenize(letters))


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings, without their word end, that the tokenizer at path turns into exactly one token when they stand alone.

    Each is encoded by the whole tokenizer. It counts as proven if splitting leaves it in one piece that is itself and one
    token comes out. The set is no larger than the vocabulary, whatever the corpus is.
    """
    s = Splitter(path)
    back = {c: b for b, c in s.letters.items()}
    surfaces = {}
    for entry in s.tokenizer.get_vocab(with_added_tokens=False):
        if entry.endswith(s.suffix) and all(c in back for c in entry.removesuffix(s.suffix)):
            letters = entry.removesuffix(s.suffix)
            try:
                surfaces[letters] = bytes(back[c] for c in letters).decode()
            except UnicodeDecodeError:  # part of a character: never a pre-token by itself
                continue
    found = s.tokenizer.encode_batch(list(surfaces.values()), add_special_tokens=False)
    return frozenset(text for (letters, text), e in zip(surfaces.items(), found)
                     if len(e.ids) == 1 and s.own_pre_tokens(text) == [letters])


def segments(text: str):
    """The text in parts of about SEGMENT characters that end at white space; one longer word stays whole."""
    at = 0
    while len(text) - at > SEGMENT:
        blank = ASCII_BLANKS.search(text, at + SEGMENT)
        if not blank:
            break
        yield text[at:blank.end()]
        at = blank.end()
    yield text[at:]


class Merges(dict):
    """How many tokens a pre-token is merged to. Keeps at most CACHED answers, and starts anew when it is full."""

    def __init__(self, split: Splitter, written):
        super().__init__()
        self.split, self.written = split, written

    def __missing__(self, piece: str) -> int:
        n = self.split.merged(self.written(piece))
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = n
        return n


_loaded: dict[str, Splitter] = {}


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", whole: frozenset[str] | None = None) -> DataFrame:
    """(id_col, n_bytes, n_pretokens, n_whole, n_tokens) of every whole text, a row for each row of df, in one pass without a shuffle.

    n_whole of the n_pretokens took the shortcut. Special literals in a text are one token each, as for the tokenizer by itself,
    and are in neither of those two. Null or empty text: zeros. Repeated rows and null ids stay as they are; empty table: no
    rows; other columns are not read. whole: what `whole_tokens` returned, if it is kept; it is made here otherwise.
    """
    if not os.path.exists(tokenizer_path):
        raise FileNotFoundError(tokenizer_path)
    proven = df.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer_path) if whole is None else whole)
    numbers = ["n_bytes", "n_pretokens", "n_whole", "n_tokens"]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in numbers)])

    def count(batches):
        import pyarrow as pa
        split = _loaded.get(tokenizer_path) or _loaded.setdefault(tokenizer_path, Splitter(tokenizer_path))
        single, single_written = proven.value, frozenset(map(split.letters_of, proven.value))
        plain_cost, written_cost = Merges(split, split.letters_of), Merges(split, str)

        def one(text: str) -> tuple[int, int, int]:
            pre = short = special = merged = 0
            parts = [text]
            if split.cut is not None and split.cut.search(text):
                parts = split.cut.split(text)
                special = len(parts) - 1
            for part in parts:
                for segment in segments(part) if split.word_ends else [part]:
                    plain, written = split.pre_tokens(segment)
                    rest = [p for p in plain if p not in single]
                    rest_written = [p for p in written if p not in single_written]
                    pre += len(plain) + len(written)
                    short += len(plain) + len(written) - len(rest) - len(rest_written)
                    merged += sum(map(plain_cost.__getitem__, rest)) + sum(map(written_cost.__getitem__, rest_written))
            return pre, short, special + short + merged

        for batch in batches:
            texts = batch.column(text_col)
            rows = [one(t) if t else (0, 0, 0) for t in texts.to_pylist()]
            sizes = [len(t) if t is not None else 0 for t in texts.cast(pa.binary()).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in (sizes, *(zip(*rows) if rows else ([], [], [])))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(tidy(count), schema)
