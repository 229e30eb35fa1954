"""Stored media against payloads; members read again by offset."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyarrow import fs

from lethe.llm import media, queries

from .frames import DATA, clashing, documents, small

TEXTS = [None, "", "a", "x" * 64, "x" * 65, "é日本", "same", "same", "long " * 40000, "\x00"]


def check(row, text):
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    png = media.to_png(payload)
    assert media.from_png(png) == payload == decoded(png)
    assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
    assert (row["tail_crc32"], row["media_bytes"], row["media_sha256"]) == (zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest())
    assert row["feature"] == media.features(payload)
    plain(payload[:6400])


def decoded(png):
    """The samples of a grey PNG of eight bits, by the format's own rules."""
    assert png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10]) and png[12:16] == b"IHDR"
    width, height = int.from_bytes(png[16:20], "big"), int.from_bytes(png[20:24], "big")
    assert list(png[24:29]) == [8, 0, 0, 0, 0]
    at, data = 8, b""
    while at < len(png):
        n, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        assert zlib.crc32(png[at + 4 : at + 8 + n]) == int.from_bytes(png[at + 8 + n : at + 12 + n], "big")
        data += png[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    raw = zlib.decompress(data)
    assert len(raw) == height * (width + 1) and not any(raw[:: width + 1])
    return b"".join(raw[i * (width + 1) + 1 : (i + 1) * (width + 1)] for i in range(height))


def plain(payload):
    """The features by one sample at a time."""
    n, mean = len(payload), sum(payload) / len(payload)
    std = (sum((x - mean) ** 2 for x in payload) / n) ** 0.5
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
    columns = [sum(payload[i::64]) / (n // 64) for i in range(64)]
    bits = "".join("01"[x >= sum(columns) / 64] for x in columns)
    size, *rest = media.features(payload).split(";")
    got = dict(x.split("=") for x in rest)
    assert size == f"64x{n // 64}" and got["ahash"] == f"{int(bits, 2):016x}"
    assert all(abs(float(got[k]) - v) < 1e-3 for k, v in (("mean", mean), ("std", std), ("entropy", entropy)))


def test_tables(spark):
    frame = clashing(documents(spark, TEXTS)).repartition(3)
    rows = {r["doc_id"]: r for r in media.describe(frame).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        check(rows[i], text)
    assert media.describe(frame.where("doc_id < 0")).count() == 0


def test_repeated_rows(spark):
    frame = documents(spark, ["x"]).union(documents(spark, ["x"]))
    assert [r["n_bytes"] for r in media.describe(frame).collect()] == [1, 1]


def test_byte_ranges_read_every_member_once(spark, tmp_path):
    frame = documents(spark, [f"text {i} " * i for i in range(200)]).repartition(2)
    path = f"file://{tmp_path}/archives"
    media.store(frame, path, archive_bytes=4000)
    assert len(list((tmp_path / "archives").glob("*.zip"))) > 2
    whole = sorted(r["member"] for r in media.load(spark, path).collect())
    parts = media.load(spark, path, split=700)
    assert sorted(r["member"] for r in parts.collect()) == whole and len(whole) == 200 and parts.rdd.getNumPartitions() > 10


def test_unlisted_archives_are_left_alone(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    media.store(documents(spark, ["one"]).coalesce(1), path)
    (tmp_path / "archives" / "0000000-00000-lost.zip").write_bytes(b"half an archive")
    assert media.load(spark, path).count() == 1


def test_repeated_attempts_count_once(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    media.store(documents(spark, ["one", "two"]).coalesce(1), path)
    media.store(documents(spark, ["one", "two"]).coalesce(1), path)
    assert len(list((tmp_path / "archives").glob("0000000-*.list"))) == 2
    assert sorted(r["member"] for r in media.load(spark, path).collect()) == ['[0, "0", 3]', '[1, "1", 3]']


def test_members_are_tried_again(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/archives"
    media.store(documents(spark, ["one", "two", "three"]).coalesce(1), path)
    reader = media.ArchiveReader({"path": path, "attempts": "3"})
    (part,) = [p for p in reader.partitions() if p.archive]
    good, calls = media.ArchiveReader._member, []

    def shaky(handle, offset, length, crc):
        calls.append(offset)
        if calls.count(offset) < 3:
            raise OSError("lost connection")
        return good(handle, offset, length, crc)

    monkeypatch.setattr(media.ArchiveReader, "_member", staticmethod(shaky))
    assert sum(b.num_rows for b in reader.read(part)) == 3 and len(calls) == 9


def test_damage_is_reported(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    media.store(documents(spark, ["some text " * 50]).coalesce(1), path)
    reader = media.ArchiveReader({"path": path, "attempts": "2"})
    (part,) = [p for p in reader.partitions() if p.archive]
    files, _ = fs.FileSystem.from_uri(path)
    with files.open_input_file(part.archive) as f:
        raw = bytearray(f.read())
    raw[100] ^= 255
    with files.open_output_stream(part.archive) as f:
        f.write(bytes(raw))
    with pytest.raises(ValueError, match="damaged"):
        list(reader.read(part))
    with pytest.raises(ValueError):
        media.from_png(b"not an image")


def test_query(spark):
    rows = {r["doc_id"]: r for r in queries.op5_media(spark, DATA).collect()}
    assert len(rows) == len(small())
    for doc_id, text in small():
        check(rows[doc_id], text)
