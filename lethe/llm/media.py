"""Media columns: payloads as images in archives, read by a Spark data source.

``store`` writes each text's bytes, padded to a multiple of 64, as the rows of an 8-bit grey PNG of
width 64 into zip archives of about ``archive_bytes`` in the shared folder.  An archive is written under
a name of its own; an attempt's archives count once its list file, of a name of its own too, is moved
into place, so a lost or repeated attempt leaves nothing that is read and no file is ever replaced.

``ArchiveSource`` reads archives: its partitions are byte ranges of archives, and a task reads the
archive's directory and the members whose offset lies in its range, as Arrow batches of a few
megabytes.  Each member is read again by its offset, up to ``attempts`` times, before the task fails.
List files are read by many threads at once; of a task's repeated attempts one list counts.

Null counts as empty: 64 zero bytes.  Rows are stored each for themselves, so repeated rows give
repeated rows, and equal texts have equal media.  An empty table gives no rows.
"""

from __future__ import annotations

import binascii
import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lethe.plans import scratch

WIDTH, LISTERS = 64, 32
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", binascii.crc32(kind + body))


def to_payload(text: bytes) -> bytes:
    """The bytes, with zero bytes up to a positive multiple of the width."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b"\0")


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image whose rows are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image written by ``to_png``; raises ValueError for anything else."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, height, data = 8, 0, 0, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != binascii.crc32(kind + body):
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, color, interlace) != (8, 0, 0):
                raise ValueError("not a plain 8-bit grey image")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Size, mean, deviation and entropy of the samples, and a 64-bit average hash."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    deviation = max(0.0, float(counts @ np.arange(256) ** 2) / len(samples) - mean * mean) ** 0.5
    columns = samples.reshape(-1, WIDTH).mean(axis=0)
    bits = int.from_bytes(np.packbits(columns >= columns.mean()).tobytes(), "big")
    return f"{WIDTH}x{len(samples) // WIDTH};mean={mean:.4f};std={deviation:.4f};entropy={-float(share @ np.log2(share)):.4f};ahash={bits:016x}"


def store(df: DataFrame, path: str, *, text: str = "text", key: str = "doc_id", archive_bytes: int = 64 << 20) -> None:
    """Write every row's media into archives below ``path``, a URI that all executors reach."""
    source = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        part, names, n = TaskContext.get().partitionId(), [], 0
        archive, stream, size = None, None, 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if archive is None:
                    names.append(f"{part:07d}-{len(names):05d}-{uuid.uuid4().hex}.zip")
                    stream = files.open_output_stream(f"{root}/{names[-1]}")
                    archive, size = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), 0
                value = value or b""
                media = to_png(to_payload(value))
                archive.writestr(zipfile.ZipInfo(json.dumps([n, name, len(value)])), media)
                n, size = n + 1, size + len(media)
                if size >= archive_bytes:
                    archive.close()
                    stream.close()
                    archive = None
        if archive is not None:
            archive.close()
            stream.close()
        listed = f"{root}/{part:07d}-{uuid.uuid4().hex}"
        with files.open_output_stream(f"{listed}.tmp") as out:
            out.write(json.dumps(names).encode())
        files.move(f"{listed}.tmp", f"{listed}.list")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    source.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveSource(DataSource):
    """Members of zip archives.  Options: path; split (bytes of a partition); attempts."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary"

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split, self.attempts = options["path"], int(options.get("split", 16 << 20)), int(options.get("attempts", 4))

    def partitions(self) -> list[Range]:
        files, root = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        sizes = {f.base_name: f.size for f in found}
        lists = {name.partition("-")[0]: name for name in sorted(sizes, reverse=True) if name.endswith(".list")}

        def names(listed: str) -> list[str]:
            with files.open_input_stream(f"{root}/{listed}") as f:
                return json.loads(f.read())

        with ThreadPoolExecutor(LISTERS) as pool:
            archives = [name for found in pool.map(lambda x: self._again(lambda: names(x)), lists.values()) for name in found]
        out = [Range(f"{root}/{name}", at, at + self.split) for name in sorted(archives) for at in range(0, sizes[name], self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        directory = self._again(lambda: self._directory(files, partition.archive))
        rows, size = [], 0
        handle = None
        for member, offset, length, crc in directory:
            if not partition.start <= offset < partition.end:
                continue

            def one():
                nonlocal handle
                if handle is None:
                    handle = files.open_input_file(partition.archive)
                try:
                    return self._member(handle, offset, length, crc)
                except Exception:
                    handle = None  # the next attempt opens the archive anew
                    raise

            media = self._again(one)
            rows.append((partition.archive.rpartition("/")[2], member, offset, media))
            size += length
            if size >= 4 << 20:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _again(self, what):
        for attempt in range(self.attempts):
            try:
                return what()
            except (OSError, ValueError, zipfile.BadZipFile):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.05 * 2**attempt)

    @staticmethod
    def _directory(files: fs.FileSystem, archive: str) -> list[tuple[str, int, int, int]]:
        with files.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
            return sorted(((i.filename, i.header_offset, i.compress_size, i.CRC) for i in z.infolist()), key=lambda x: x[1])

    @staticmethod
    def _member(handle, offset: int, length: int, crc: int) -> bytes:
        head = handle.read_at(30, offset)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no member at {offset}")
        name, extra = struct.unpack_from("<HH", head, 26)
        media = handle.read_at(length, offset + 30 + name + extra)
        if len(media) != length or binascii.crc32(media) != crc:
            raise ValueError(f"a damaged member at {offset}")
        return media

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.binary()))], ["archive", "member", "offset", "media"])


def load(spark: SparkSession, path: str, *, split: int = 16 << 20, attempts: int = 4) -> DataFrame:
    """archive, member, offset, media of all members below ``path``."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive_members").option("path", path).option("split", split).option("attempts", attempts).load()


def describe(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store every row, read it back: ``key``, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    path = scratch.new_path(df.sparkSession, "media")
    store(df, path, text=text, key=key)
    names = (("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for member, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, name, n = json.loads(member)
                payload = from_png(media)
                ids.append(name)
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *(pa.array([x[i] for x in out], k) for i, (_, k) in enumerate(names))], ["key", *(c for c, _ in names)])

    schema = "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    read = load(df.sparkSession, path).select("member", "media").mapInArrow(run, schema)
    return read.select(F.col("key").cast(df.schema[key].dataType).alias(key), *(c for c, _ in names))
