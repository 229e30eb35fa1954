"""Every token in one piece, sequences without gaps, little padding; subset sums against brute force."""

import itertools
import random
import zlib
from collections import defaultdict

import pytest

from lethe.llm import bpe, packing, queries

from .frames import DATA, clashing, documents, small


@pytest.mark.parametrize("seed", range(40))
def test_fill_comes_closest(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
    capacity, first = 60, rng.randint(1, 60)
    counts = {x: lengths.count(x) for x in lengths}
    chosen, slack = packing.fill(counts, first, capacity)
    assert all(chosen.count(x) <= counts[x] for x in chosen) and first + sum(chosen) + slack == capacity
    sums = {sum(c) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k)}
    assert slack == capacity - first - max(s for s in sums if s <= capacity - first)


def judge(rows, want, capacity=1024):
    """rows: doc_id, start, length, ids, doc_tokens, sequence_id, offset; want: ids by document."""
    documents_of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents_of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert documents_of.keys() == want.keys()
    for doc_id, pieces in documents_of.items():
        at, found = 0, b""
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] * 4 == len(p["ids"]) and p["length"] > 0 and p["doc_tokens"] * 4 == len(want[doc_id])
            at, found = at + p["length"], found + bytes(p["ids"])
        assert found == want[doc_id]
    padded = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    assert padded == 0


def encoded(text):
    return bpe.load(queries.vocabulary()).encode(text).astype("<u4").tobytes() + bytes(4)


def test_tables(spark):
    texts = [None, "", "same", "same", "word " * 9000, *(f"text {i} " * (i % 37) for i in range(300))]
    frame = clashing(documents(spark, texts)).repartition(3)
    judge(packing.pack(frame, queries.vocabulary()).collect(), {i: encoded(t or "") for i, t in enumerate(texts)})
    assert packing.pack(frame.where("doc_id < 0"), queries.vocabulary()).count() == 0


def test_small_pool_and_capacity():
    rng = random.Random(3)
    packer, want = packing.Packer(64, 0, 8), {}
    for i in range(500):
        want[i] = rng.randbytes(4 * rng.randint(1, 200))
        packer.add(i, want[i])
        assert packer.n < 8
    packer.finish()
    names = ("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset")
    judge([dict(zip(names, x)) | {"length": len(x[2]) // 4} for x in packer.done], want, 64)


def test_query(spark):
    want = {i: encoded(t or "") for i, t in small()}
    rows = queries.op8_packing(spark, DATA).collect()
    cut = [r.asDict() | {"ids": want[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]} for r in rows]
    judge(cut, want)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in cut)
