import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lethe.functions import columns as C
from lethe.plans import components


def one(spark, data, column):
    return spark.createDataFrame([(bytearray(data),)], "data binary").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("data", [b"", b"a", b"q" * 4096, b"r" * 4097, bytes(range(256)) * 40])
def test_pieces_and_fingerprints(spark, data):
    want = [data[i : i + 4096] for i in range(0, max(1, len(data)), 4096)]
    assert [bytes(x) for x in one(spark, data, C.pieces("data"))] == want
    assert [(x["fp"], x["n"]) for x in one(spark, data, C.piece_structs("data"))] == [(hashlib.sha256(p).hexdigest(), len(p)) for p in want]


@pytest.mark.parametrize("data, left", [(b"line ALICE\nline BOB\n", b"line BOB\n"), (b"\xff\x00alIce\n\xfe\x80", b"\xfe\x80"), (b"", b""), (b"a\n\n", b"a\n\n"), ("alİce\nalKce".encode(), "alİce\nalKce".encode())])
def test_lines_of_a_subject_go(spark, data, left):
    assert bytes(one(spark, data, C.strip_lines("data", F.lit("Alice")))) == left


def test_share_rule(spark):
    rows = spark.createDataFrame([(c,) for c in C.CLASSES], "file_class string")
    got = {(w, p): [r[0] for r in rows.select(C.shares("file_class", w, p)).collect()] for w in C.WRAP_MODES for p in C.MIXED_POLICIES}
    assert all(v == [True, w != "no-cross-user", w != "no-cross-user" and p == "or-wrap"] for (w, p), v in got.items())


def test_hold_predicate(spark):
    recipes = spark.createDataFrame([("a", "t0", "p"), ("b", "t1", "p")], "subject string, snapshot_id string, path string")
    holds = spark.createDataFrame([("h1", "a", None, None), ("h2", None, "t1", ""), ("h3", None, None, None), ("h4", "", "", ""), ("h5", "a", "t1", None)], "hold_id string, subject string, snapshot_id string, path string")
    got = recipes.alias("r").join(holds.alias("h"), C.held()).select("h.hold_id", "r.subject").collect()
    assert sorted(map(tuple, got)) == [("h1", "a"), ("h2", "b")]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (5, 5), (60, 61), (61, 60), (500, 501), (500, 502), (503, 501)]
    got = {r["node"]: r["label"] for r in components.labels(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100, 61: 60, 501: 500, 502: 500, 503: 500}


def test_masks_miss_nothing(spark):
    """Every id is in its mask, of other ids hardly any; a mask of none has no bit."""
    ids = spark.range(-5000, 5000)
    mask = C.mask(ids, "id")
    assert ids.join(F.broadcast(mask), C.in_mask("id"), "left_semi").count() == 10000
    assert spark.range(10000, 60000).join(F.broadcast(mask), C.in_mask("id"), "left_semi").count() < 500
    assert ids.join(F.broadcast(C.mask(ids.limit(0), "id")), C.in_mask("id"), "left_anti").count() == 10000


def test_masks_grow_with_their_ids(spark):
    """However many ids a mask has, of other ids hardly any seem to be of it; few ids take a small one."""
    for n, words in ((10, C.MASK_LEAST), (700000, 1 << 19)):
        mask = C.mask(spark.range(n), "id")
        assert mask.select(F.size("mask")).first()[0] == words
        assert spark.range(n, n + 100000).join(F.broadcast(mask), C.in_mask("id"), "left_semi").count() < 600
        assert spark.range(n).join(F.broadcast(mask), C.in_mask("id"), "left_anti").isEmpty()
    assert [C.mask_words(x) for x in (0, 512, 4 << 20, 1 << 40)] == [C.MASK_LEAST, 1 << 9, C.MASK_MOST, C.MASK_MOST]


def test_packed_pieces(spark):
    """Pieces come back, alone and joined end to end; text takes less than half, other bytes 16 more, null stays null."""
    text, noise = b"the same words again and again, \n" * 120, random.Random(3).randbytes(4096)
    frame = spark.createDataFrame([(0, bytearray(text)), (1, bytearray(noise)), (2, bytearray()), (3, None)], "id long, piece binary").withColumn("packed", C.pack("piece"))
    got = {r["id"]: r for r in frame.select("*", C.unpack("packed").alias("back"), F.octet_length("packed").alias("n")).collect()}
    assert [got[i]["back"] for i in range(4)] == [text, noise, b"", None] and got[0]["n"] < len(text) / 2 and got[1]["n"] <= 4096 + 16 and got[3]["n"] is None
    joined = frame.agg(F.expr("listagg(packed) within group (order by id)").alias("all")).select(C.unpack("all").alias("back")).first()
    assert bytes(joined["back"]) == text + noise
