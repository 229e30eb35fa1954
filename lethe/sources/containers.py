"""Mailboxes and photo folders as inner objects: subject, path, data, file_class.

Classes come from all members at once, whatever their order: content that several single owners hold
is identical, what names several people is mixed and stays so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from email import message_from_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OWNER_HEADER = "X-Backup-Subject"
PEOPLE = ("alice", "bob")


def split_mbox(data: bytes) -> list[bytes]:
    """Messages of a mailbox; without a leading ``From `` line all of it is one."""
    found = re.split(rb"(?m)(?=^From )", data) if data.startswith(b"From ") else [data]
    return [m for m in found if m.strip()]


def owners_of(message, people: tuple[str, ...]) -> list[str]:
    """The owners' header, else the first known person in From, else ``unknown``."""
    named = [p.strip().lower() for p in str(message.get(OWNER_HEADER, "")).split(",") if p.strip()]
    sender = str(message.get("From") or "").lower()
    return named or [p for p in people if p in sender][:1] or ["unknown"]


def body_of(message, raw: bytes) -> bytes:
    """Decoded body; parts of a multipart message are joined by a newline."""
    if message.is_multipart():
        parts = [p.get_payload(decode=True) or b"" for p in message.walk() if p.get_content_maintype() != "multipart"]
        return (b"\n".join(parts) or raw).strip()
    return (message.get_payload(decode=True) or b"").strip()


def mbox(boxes: DataFrame, people: tuple[str, ...] = PEOPLE) -> DataFrame:
    """Inner objects of mailboxes (container, data), with container, ordinal and owner position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, raw in enumerate(split_mbox(data or b"")):
                    message = message_from_bytes(raw)
                    owners = owners_of(message, people)
                    body = body_of(message, raw)
                    for k, owner in enumerate(owners):
                        path = f"{name}/msg/{i}" if len(owners) > 1 else f"{name}/msg/{i}/{owner}"
                        out.append((name, i, k, owner, path, body, len(owners) > 1))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], ["container", "msg", "owner", "subject", "path", "data", "mixed"])

    rows = boxes.select("container", "data").mapInArrow(run, "container string, msg long, owner long, subject string, path string, data binary, mixed boolean")
    return _classed(rows, ["container"], same_owner_identical=False)


def _classed(rows: DataFrame, within: list[str], *, same_owner_identical: bool) -> DataFrame:
    """file_class from the single owners of equal data; joined by hash, so payloads aren't grouped."""
    rows = rows.withColumn("__hash", F.sha2("data", 256))
    several = F.min("subject") != F.max("subject")
    if same_owner_identical:
        several = several | (F.count("*") > 1)
    seen = rows.where("not mixed").groupBy(*within, "__hash").agg(several.alias("__several"))
    joined = rows.join(seen, [*within, "__hash"], "left")
    kind = F.when(F.col("mixed"), "mixed").when(F.col("__several"), "identical").otherwise("unique")
    return joined.withColumn("file_class", kind).drop("__hash", "__several", "mixed")


def photos(files: DataFrame, people: tuple[str, ...] = PEOPLE) -> DataFrame:
    """Inner objects of photos (path, data): owners by the names in the file's stem."""
    stem = F.lower(F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"(?<=.)\.[^.]*$", ""))
    named = F.filter(F.array(*(F.lit(p) for p in people)), lambda p: F.contains(stem, p))
    rows = files.withColumn("__named", named).withColumn("mixed", (F.size("__named") > 1) | F.contains(stem, F.lit("group")))
    everyone, first = F.array(*(F.lit(p) for p in people)), F.array(F.lit(people[0]))
    owners = F.when(F.size("__named") > 0, F.col("__named")).when(F.col("mixed"), everyone).otherwise(first)
    rows = rows.select(F.concat(F.lit("photos/"), F.col("path")).alias("path"), "data", "mixed", F.posexplode(owners).alias("owner", "subject"))
    return _classed(rows, [], same_owner_identical=True)


def photo_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``) and data of all files whose name doesn't begin with a dot.

    The folder is listed through Hadoop, names only, and the files are read on the executors by their
    paths.  Spark's reader leaves out names that begin with an underscore, so those are read by pyarrow.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    base = hadoop.Path(root)
    found, files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    start = found.makeQualified(base).toUri().getPath().rstrip("/") + "/"
    listed = found.listFiles(base, True)
    while listed.hasNext():
        path = listed.next().getPath()
        if not path.getName().startswith("."):
            files.append((path.toUri().getPath().removeprefix(start), path.toString()))
    left_out = [x for x in files if x[0].rpartition("/")[2].startswith("_") or x[0].endswith("._COPYING_")]
    seen = [x for x in files if x not in left_out]
    rows = spark.createDataFrame(left_out, "path string, uri string").mapInArrow(_read_files, "path string, data binary")
    if not seen:
        return rows
    # a glob sign in a path is taken literally
    read = spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?,])", r"\\\1", uri) for _, uri in seen]).select(F.col("path").alias("uri"), F.col("content").alias("data"))
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    names = spark.createDataFrame(seen, "path string, named string")
    return read.join(names, bare(read["uri"]) == bare(names["named"])).select("path", "data").union(rows)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for path, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            scheme, _, rest = uri.partition(":")
            files, name = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(uri)
            with files.open_input_stream(name) as stream:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([stream.read()], pa.binary())], ["path", "data"])


def binary_file(spark: SparkSession, path: str) -> bytes:
    """One whole file."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def as_log(rows: DataFrame, snapshot_id: str, order: list[str]) -> DataFrame:
    """Inner objects as a log to ingest; ``order`` gives seq, which rises with gaps: rows are sorted in ranges, not in one task."""
    numbered = rows.orderBy(*order).withColumn("seq", F.monotonically_increasing_id())
    return numbered.select("seq", "subject", F.lit(snapshot_id).alias("snapshot_id"), "path", "data", "file_class")


def ingest_mbox(store, spark: SparkSession, data: bytes, snapshot_id: str, container: str = "inbox.mbox", people: tuple[str, ...] = PEOPLE) -> DataFrame:
    boxes = spark.createDataFrame([(container, bytearray(data))], "container string, data binary")
    rows = mbox(boxes, people)
    store.ingest(as_log(rows, snapshot_id, ["container", "msg", "owner"]))
    return rows


def ingest_photos(store, spark: SparkSession, root: str, snapshot_id: str, people: tuple[str, ...] = PEOPLE) -> DataFrame:
    rows = photos(photo_files(spark, root), people)
    store.ingest(as_log(rows, snapshot_id, ["path", "owner"]))
    return rows


#: What an erasure of the first person must take from the sample.
HOME = b"7 Quay Street"
#: Owners and body of each message: each person's own, one of both, and one that both have.
SAMPLE = (("alice", b"I live at 7 Quay Street now."), ("bob", b"The lease is signed."), ("alice, bob", b"Notes by Alice and Bob."), ("alice", b"SetupProgram-same-bytes"), ("bob", b"SetupProgram-same-bytes"))


def sample_mbox() -> bytes:
    """The messages of ``SAMPLE`` in one mailbox."""
    head = b"From %s@example.com Mon Jan  5 09:00:00 2026\n" + OWNER_HEADER.encode() + b": %s\n\n%s\n\n"
    return b"".join(head % (owners.split(",")[0].encode(), owners.encode(), body) for owners, body in SAMPLE)
