"""Paths against enumeration; accuracy on rows held out; texts without a language."""

import itertools
import zlib

import numpy as np
import pytest

from lethe.llm import langid, queries

from .frames import clashing, documents

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{DATA}/documents.parquet").where(~langid.held_out()))


@pytest.mark.parametrize("seed", range(30))
def test_path_is_best(seed):
    rng = np.random.default_rng(seed)
    scores = -rng.integers(0, 9, (7, 3)).astype(np.float32)
    penalty = float(rng.choice([0.5, 3.0, 14.0]))
    value = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    assert abs(value(langid.path(scores, penalty).tolist()) - max(map(value, itertools.product(range(3), repeat=7)))) < 1e-4


def test_held_out_accuracy(spark):
    got = queries.op3_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    judged = [r for r in got if r["held_out"] and r["lang"] and any(map(str.isalpha, r["text"] or ""))]
    assert len(judged) > 100 and sum(r["lang"] == r["lang_pred"] for r in judged) / len(judged) > 0.97
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) for r in got)


def test_spans_of_mixed_text(spark, model):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) > 800").orderBy("doc_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r["lang"], r["text"][:400].strip())
    one, two = sorted(k for k in by if k)[:2]
    text = by[one] + " " + by[two]
    (_, _, spans), = langid.label_many([text], langid.Scorer(model), langid.PENALTY)
    assert [x for _, _, x in spans] == [one, two]
    assert abs(spans[1][0] - len(by[one])) < 40 and spans[0][0] >= 0 and spans[-1][1] <= len(text)


def test_capital_dotted_i_keeps_spans(spark, model):
    rows = {r["doc_id"]: r["spans"] for r in langid.predict(documents(spark, ["\u0130 the old man and the sea", " I the old man and the sea"]), model).collect()}
    assert [(x["start"], x["end"], x["lang"]) for x in rows[0]] == [(0, 25, "en")] and [(x["start"], x["end"]) for x in rows[1]] == [(1, 26)]


def test_tables(spark, model):
    texts = [None, "", "123 ... \n", "the of and", "the of and", "漢字", "word " * 30000, "ª"]
    frame = clashing(documents(spark, texts))
    rows = {r["doc_id"]: r for r in langid.predict(frame, model).collect()}
    assert len(rows) == len(texts) and [rows[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and rows[0]["score"] == 0
    assert rows[3] == rows[4].__class__(**(rows[4].asDict() | {"doc_id": 3})) and rows[5]["lang_pred"] in model.languages
    kept = langid.accept(frame, model)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if rows[i]["lang_pred"] != "und"]
    assert langid.predict(frame.where("doc_id < 0"), model).count() == 0


def test_nothing_to_learn(spark):
    frame = documents(spark, ["a text", None])
    model = langid.fit(frame.where("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(frame, model).collect()} == {"und"}


def test_other_columns_are_no_inputs(spark, model):
    frame = documents(spark, ["the old man and the sea"])
    other = frame.selectExpr("doc_id + 7 as doc_id", "text", "'xx' as lang", "'zz' as source")
    assert langid.predict(frame, model).drop("doc_id").collect() == langid.predict(other, model).drop("doc_id").collect()
