"""Token counts against the untouched tokenizer."""

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lapforge.llm import tokens
from lapforge.llm.queries import QUERIES, tokenizer
from helpers import frame, odd_texts

ODD = ["Ünï cöde space \x1c control 'll it's 'LL", "é á\ńb", "ΑΣ Σ ὈΔΥΣΣΕΎΣ İstanbul ſtraße", "hello <|endoftext|> world<|startoftext|>",
       "a<|ENDOFTEXT|>b<|endoftext|>.c", "a\u0085b c d　e", "²³¼ 12345 ½x", "ªº µm ×÷ ́x", "àªª ãģĢ ߯ ߯", "x'sx 're''ve", "漢字かな交じり文 عربى हिन्दी",
       "\x00\x01\x7f\xa0\xad", "tab\tline\r\n\x0b\x0cend", "<|endoftext|>", "   ", "ꟁ Ꟃ 𞤀 𐐀", "🙂🙂 👩‍👩‍👧"]


def counts(spark, rows, path, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in tokens.token_counts(df, path, **kw).collect()), key=repr)


def by_tokenizer(rows, path):
    t = Tokenizer.from_file(path)
    return sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows), key=repr)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_texts_count_as_by_the_tokenizer(spark, name):
    path = public_tokenizers.path(name)
    rows = [(i, x) for i, x, _ in odd_texts()] + list(enumerate(ODD, 500)) + [(None, "no id"), (None, None), (4, "one two")]
    got = counts(spark, rows, path)
    assert sorted(((i, b, n) for i, b, _, _, n in got), key=repr) == by_tokenizer(rows, path)
    assert all(0 <= w <= p and w <= n for _, _, p, w, n in got) and any(w for _, _, _, w, _ in got)


def test_extra_columns_empty_table_and_missing_file(spark):
    clash = frame(spark, odd_texts()).withColumns({c: F.lit("x") for c in ("n_bytes", "n_tokens", "n_whole", "n_pretokens")})
    assert tokens.token_counts(clash, tokenizer()).count() == len(odd_texts())
    assert tokens.token_counts(clash.limit(0), tokenizer()).columns == ["doc_id", "n_bytes", "n_pretokens", "n_whole", "n_tokens"]
    assert tokens.token_counts(clash.limit(0), tokenizer()).count() == 0
    with pytest.raises(FileNotFoundError):
        tokens.token_counts(clash, "/nowhere.json")


def test_every_proven_string_is_one_token_and_no_single_token_is_missed():
    t, proven = Tokenizer.from_file(tokenizer()), tokens.whole_tokens(tokenizer())
    assert len(proven) > 20_000
    assert all(len(e.ids) == 1 for e in t.encode_batch(list(proven), add_special_tokens=False))
    split = tokens.Splitter(tokenizer())
    assert {split.letters_of(x) + "</w>" for x in proven} <= set(t.get_vocab())


def test_result_is_the_same_without_the_shortcut(spark):
    rows = [(i, x) for i, x, _ in odd_texts()] + list(enumerate(ODD, 500))
    with_it, without = counts(spark, rows, tokenizer()), counts(spark, rows, tokenizer(), whole=frozenset())
    assert [(r[0], r[4]) for r in with_it] == [(r[0], r[4]) for r in without] and not any(r[3] for r in without)


SPLIT, T = tokens.Splitter(tokenizer()), Tokenizer.from_file(tokenizer())


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x250, exclude_categories=["Cs"]), st.sampled_from("'stredvml \n.,!aé́Σ🙂")), max_size=60))
def test_any_text(text):
    total = 0
    for part in SPLIT.cut.split(text):
        plain, written = SPLIT.pre_tokens(part)
        total += sum(SPLIT.merged(SPLIT.letters_of(p)) for p in plain) + sum(map(SPLIT.merged, written))
    assert total + len(SPLIT.cut.findall(text)) == len(T.encode(text, add_special_tokens=False).ids)


def test_long_texts_are_split_at_white_space_only(monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 10)
    text = "one two three\tfour " + "x" * 50 + " five\nsix" + "é" * 30
    assert "".join(tokens.segments(text)) == text and len(list(tokens.segments(text))) == 3
    assert all(p[-1].isspace() for p in list(tokens.segments(text))[:-1])


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_token_counts"](spark, folder).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == by_tokenizer(rows, tokenizer())
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
