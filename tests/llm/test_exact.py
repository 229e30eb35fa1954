"""Groups of equal texts against a dictionary."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lethe.llm import exact

from .frames import clashing, documents


def brute(rows):
    """keep_id, group_size and digest of each (id, text)."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    return {i: (min(groups[norm(t)])[1], len(groups[norm(t)]), min(groups[norm(t)])[1] == i, hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}


TEXTS = ["a b c", "abc", "a  b  c", "abc", None, "", " \t\n\x0b\x0c\r", " ", "\x1c", "é x", "é x", "éx", "long " * 5000, "long" * 5000, "A b c", "日本 語", "日本語", " "]


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 50, "memory": 100}, {"bucket_bytes": 1, "memory": 1}])
def test_groups(spark, options):
    frame = clashing(documents(spark, TEXTS)).repartition(3)
    rows = exact.dedup(frame, **options).collect()
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows}
    want = brute(list(enumerate(TEXTS)))
    assert len(rows) == len(TEXTS) and got == want
    kept = exact.keep_first(frame, **options)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])


def test_repeated_rows_null_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, "y")], "doc_id long, text string")
    rows = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.dedup(frame).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [(1, 1, 3, True), (1, 1, 3, False), (None, 1, 3, False), (None, None, 1, True)]))
    assert exact.keep_first(frame).count() == 2
    assert exact.dedup(frame.where("doc_id > 5")).count() == 0 and exact.keep_first(frame.where("doc_id > 5")).count() == 0


def test_colliding_hashes_are_chained(spark, monkeypatch):
    """With one hash for all texts the owner still tells them apart, though no bucket can be split."""
    record = exact._record
    monkeypatch.setattr(exact, "_record", lambda *a: record(*a).withColumn("hash", F.lit(0).cast("long")))
    got = {r["doc_id"]: r["keep_id"] for r in exact.dedup(documents(spark, TEXTS), bucket_bytes=10).collect()}
    assert got == {i: w[0] for i, w in brute(list(enumerate(TEXTS))).items()}


def test_directory_doubles(spark):
    heads = spark.range(200).selectExpr("xxhash64(id) as hash", "100L as bytes").union(spark.range(50).selectExpr("7L as hash", "100L as bytes"))
    buckets = exact.directory(heads, 1000)
    first = [k for k, _ in buckets]
    assert first == sorted(set(first)) and first[0] == 0
    hashes = [r["hash"] % (1 << 64) for r in heads.collect()]
    for (low, size), high in zip(buckets, [*first[1:], 1 << 64]):
        inside = [h for h in hashes if low <= h < high]
        assert len(inside) * 100 == size and (size <= 1000 or len(set(inside)) == 1)


def test_directory_of_thousands_of_buckets(spark, monkeypatch):
    heads = spark.range(100000).selectExpr("xxhash64(id) as hash", "1000L as bytes")
    buckets = exact.directory(heads, 20000)
    assert 5000 < len(buckets) < 20000 and sum(n for _, n in buckets) == 10**8 and max(n for _, n in buckets) <= 20000
    first = exact.owners(buckets, 100000)
    sizes = [sum(n for k, n in buckets if low <= k < high) for low, high in zip(first.tolist(), [*first.tolist()[1:], 1 << 64])]
    assert sum(sizes) == 10**8 and max(sizes) <= 100000 and len(sizes) < 2 * 10**8 / 100000
    monkeypatch.setattr(exact, "MOST_BITS", 6)
    assert len(exact.directory(heads, 20000)) <= 64


def test_empty_directory(spark):
    assert exact.directory(spark.range(0).selectExpr("id as hash", "id as bytes"), 10) == [(0, 0)]
