"""Each stage against a brute-force version on its own input, then the whole."""

import pytest

import corpus_pipeline
from lethe.llm import pii

from .test_exact import brute as equal_groups
from .test_minhash import brute as components
from .test_packing import encoded, judge
from .frames import DATA, documents


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found.append(docs.collect())
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return found


def by_id(rows):
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r for r in rows}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "redact_pii", "pack"]


def test_language(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    assert after == {i: r for i, r in before.items() if any(map(str.isalpha, r["text"] or ""))}


def test_exact(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    kept = {i for i, w in equal_groups([(i, r["text"]) for i, r in before.items()]).items() if w[2]}
    assert after == {i: before[i] for i in kept} and len(after) < len(before)


def test_near(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    ids = list(before)
    kept = {i for i, (_, c) in zip(ids, components(ids, [before[i]["text"] for i in ids], 5, 80)) if c == i}
    assert after == {i: before[i] for i in kept} and len(after) < len(before)


def test_redaction(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert before.keys() == after.keys() and before != after
    for i, r in before.items():
        spans = pii.spans_of(r["text"])[1]
        assert after[i].asDict() == r.asDict() if not spans else after[i]["n_chars"] == len(after[i]["text"])
        assert not pii.plain(after[i]["text"] or "")


def test_packing(stages, spark):
    want = {i: encoded(r["text"] or "") for i, r in by_id(stages[4]).items()}
    cut = [r.asDict() | {"ids": want[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]} for r in stages[5]]
    judge(cut, want)
    assert len(corpus_pipeline.run(spark, DATA).collect()) > 0


def test_empty_table(spark, tmp_path):
    documents(spark, []).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
