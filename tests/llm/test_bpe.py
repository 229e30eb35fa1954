"""Ids and texts against the tokenizers library."""

import functools
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lethe.llm import bpe, queries

from .frames import DATA, clashing, documents, small

CASES = [
    "", " ", "\n\n  x", "don't WON'T it's we'll 'tis", "naïve café — “quoted”…", "日本語テキスト と 漢字", "emoji 👩‍👩‍👧‍👦 🏳️‍🌈!", "tabs\t\tand nbsp　wide", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext|",
    "1234567890 3.14 ½ ٣٤", "x" * 63 + " " + "x" * 64 + " " + "x" * 65, "ab" * 5000, "\u0085line sep", "é" * 40, "\x00\x01\x7f", "ſ K 'ſ", "﻿bom", " " * 300 + "a", "a" + " " * 300,
]


@functools.cache
def library():
    return Tokenizer.from_file(queries.vocabulary())


def ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    model = bpe.load(queries.vocabulary())
    assert model.encode(text).tolist() == ids(text)
    assert model.decode(ids(text)) == library().decode(ids(text), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab' \n\t1é.stlrev×漢", max_size=200))
def test_any_text(text):
    assert bpe.load(queries.vocabulary()).encode(text).tolist() == ids(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab' \n\t1é.stlrev÷<|endoftext|>", max_size=40) | st.just("<|endoftext|>"), max_size=8))
def test_many_texts_at_once(texts):
    """Texts lie side by side in one array and don't touch each other."""
    assert [x.tolist() for x in bpe.load(queries.vocabulary()).encode_many(texts)] == [ids(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_any_ids(found):
    """Bytes that aren't UTF-8 decode as the library's do."""
    assert bpe.load(queries.vocabulary()).decode(found) == library().decode(found, skip_special_tokens=False)


def test_both_ways_of_merging_agree():
    model = bpe.Bpe(queries.vocabulary())
    for _, text in small()[:40]:
        for word in set(model.tokens(text or "")):
            raw = word.encode()
            if len(raw) <= bpe.SHORT:
                assert model.merge_block([raw])[0].tolist() == model._merge_long([model.single[b] for b in raw])


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    model = bpe.Bpe(queries.vocabulary())
    for _, text in small()[:60]:
        assert model.encode(text).tolist() == ids(text)


def test_query(spark):
    rows = {r["doc_id"]: r for r in queries.op1_bpe(spark, DATA).collect()}
    assert len(rows) == len(small())
    for doc_id, text in small():
        want = ids(text)
        decoded = library().decode(want, skip_special_tokens=False)
        assert rows[doc_id]["n_tokens"] == len(want)
        assert rows[doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert rows[doc_id]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_tables(spark):
    texts = [None, "", "same text", "same text", "word " * 30000]
    frame = clashing(documents(spark, texts))
    encoded = bpe.encode(frame, queries.vocabulary())
    found = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert found == {i: ids(t) for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, queries.vocabulary()).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip(frame.where("doc_id < 0"), queries.vocabulary()).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), queries.vocabulary()).first()["text"] is None
