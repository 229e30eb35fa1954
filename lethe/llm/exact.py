"""Exact deduplication with an extendible-hash index on shared files.

1. Record file.  Each task reads its rows, deletes white space, hashes the rest and keeps the
   distinct texts it has met (up to ``memory`` bytes of objects); a row is a *head*, the first with its text in
   the task, or a member of one.  All rows go to a Parquet table in the shared folder, with a
   summary row for each head: copies of a text within one task cost one entry from here on.
2. Directory.  Heads are counted by a prefix of their 64-bit hash, about as long as buckets of
   ``bucket_bytes`` need.  The directory starts with one bucket and doubles: a bucket over that size
   is split by the next bit of the hash, again and again, with a longer prefix for the heads of those
   that one count can't split; a bucket of one single hash can't be split and overflows.  Not more than
   2**``MOST_BITS`` counts reach the driver at once, and about as many buckets there are at most: where
   more would be needed, buckets are larger.
3. Owners.  Consecutive buckets are packed into key ranges of about ``bucket_bytes``, and each range's
   heads go to a task of their own, sorted by hash.  There they are chained: a head joins the chain
   entry with the same bytes or appends its own, so hashes that collide stay apart.  Only one hash's
   distinct texts are held at a time, so a large bucket costs time but no memory.
4. Groups are aggregated from the heads' summaries, and rows look theirs up by (task, head).

Null counts as empty; all texts that are empty after normalising form one group.  Of equal texts the
row with the most code points in the original text stays, then the one with the smallest id (a null
id last), then the first in the record file: of rows repeated whole exactly one stays.  Extra columns
are kept apart in a struct, so their names may clash with ours.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm.words import slices
from lethe.plans import scratch

BLANK = b" \t\n\x0b\x0c\r"
#: Bits of a hash that the directory looks at in one count, at most.
MOST_BITS = 18
#: Bytes of the objects that a remembered text needs besides its own.
ENTRY = 700


@dataclass
class Index:
    """records: the record file; heads: (part, head) to its group."""

    records: DataFrame
    heads: DataFrame


def _record(df: DataFrame, text: str, key: str, memory: int) -> DataFrame:
    """Rows as ``row`` with tags; summaries have a null ``row``, n > 0 and the best member."""
    kind = df.schema[key].dataType
    source = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"))
    at_text, at_key = df.columns.index(text), df.columns.index(key)
    schema = T.StructType().add("row", source.schema["row"].dataType)
    for name, t in (("part", "long"), ("seq", "long"), ("head", "long"), ("is_head", "boolean"), ("hash", "long"), ("sha", "string"), ("points", "long"), ("n", "long")):
        schema = schema.add(name, t)
    schema = schema.add("id", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        known: dict[bytes, list] = {}  # text: head, n, points, id, seq, hash, sha
        made, types = 0, None

        def summaries() -> pa.RecordBatch:
            found = list(known.values())
            columns = [
                pa.nulls(len(found), types[0]), pa.array([part] * len(found), pa.int64()), pa.array([x[4] for x in found], pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([False] * len(found)),
                pa.array([x[5] for x in found], pa.int64()), pa.array([x[6] for x in found], pa.string()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[3] for x in found], types[1]),
            ]
            return pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

        for batch in batches:
            types = (batch.column(0).type, batch.column(0).type.field(at_key).type)
            for a, b in slices(batch.column(0).field(at_text)):
                rows = batch.column(0).slice(a, b - a)
                texts, keys = rows.field(at_text), rows.field(at_key)
                points = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
                tags: list[tuple] = []
                for raw, length, key_value in zip(texts.cast(pa.binary()), points, keys.to_pylist()):
                    body = (raw.as_py() or b"").translate(None, BLANK)
                    entry = known.get(body)
                    is_head = entry is None
                    if is_head:
                        digest = hashlib.sha256(body)
                        entry = known[body] = [made, 0, -1, None, 0, int.from_bytes(digest.digest()[:8], "big", signed=True), digest.hexdigest()]
                        made += 1
                        size += len(body) + ENTRY
                    entry[1] += 1
                    if length > entry[2] or length == entry[2] and key_value is not None and (entry[3] is None or key_value < entry[3]):
                        entry[2:5] = length, key_value, seq
                    tags.append((seq, entry[0], is_head, entry[5], entry[6], length))
                    seq += 1
                columns = [rows, pa.array([part] * len(tags), pa.int64())]
                columns += [pa.array([t[i] for t in tags], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([0] * len(tags), pa.int64()), keys], [f.name for f in schema])
                if size > memory:
                    yield summaries()
                    known.clear()
                    size = 0
        if known:
            yield summaries()

    return source.mapInArrow(run, schema)


def directory(heads: DataFrame, bucket_bytes: int) -> list[tuple[int, int]]:
    """First key (hash as unsigned) and bytes of each bucket, in order, after all splits; heads: hash, bytes."""
    total = heads.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    limit = max(bucket_bytes, total >> (MOST_BITS - 2))
    done: list[tuple[int, int]] = []
    low, bits = 0, min(MOST_BITS, (2 * total // limit).bit_length() + 1)
    full = [0]  # prefixes of ``low`` bits to split: each over ``limit``, so fewer than total / limit
    while full:
        found = heads
        if low:
            wanted = heads.sparkSession.createDataFrame([(p,) for p in full], "prefix long")
            found = heads.join(wanted, F.shiftrightunsigned("hash", 64 - low) == F.col("prefix"), "left_semi")
        leaf = F.shiftrightunsigned("hash", 64 - bits) if bits < 64 else F.col("hash")
        counted = found.groupBy(leaf.alias("leaf")).agg(F.sum("bytes").alias("bytes"), (F.min("hash") == F.max("hash")).alias("single")).toArrow()
        leaves = counted["leaf"].to_numpy().view(np.uint64)
        order = np.argsort(leaves)
        leaves, single = leaves[order], counted["single"].to_numpy()[order]
        before = np.concatenate([[0], np.cumsum(counted["bytes"].to_numpy()[order])]).tolist()
        place = lambda prefix, depth: int(np.searchsorted(leaves, np.uint64(prefix << (bits - depth)))) if prefix >> depth == 0 else len(leaves)
        todo, full = [(low, p, place(p, low), place(p + 1, low)) for p in full], []  # depth, prefix, and the leaves that begin with it
        while todo:
            depth, prefix, a, b = todo.pop()
            size = before[b] - before[a]
            if size <= limit or b - a == 1 and single[a] or depth == 64:
                done.append((prefix << (64 - depth), size))
            elif depth == bits:
                full.append(prefix)
            else:
                half = place(2 * prefix + 1, depth + 1)
                todo += [(depth + 1, 2 * prefix, a, half), (depth + 1, 2 * prefix + 1, half, b)]
        low, bits = bits, min(64, bits + max(1, MOST_BITS - len(full).bit_length()))
    return sorted(done)


def owners(buckets: list[tuple[int, int]], most: int) -> np.ndarray:
    """First key of each owner's range: consecutive buckets of ``most`` bytes together, or one that is larger."""
    first, size = [0], 0
    for start, n in buckets:
        if size and size + n > most:
            first.append(start)
            size = 0
        size += n
    return np.array(first, dtype=np.uint64)


def build(df: DataFrame, *, text: str = "text", key: str = "doc_id", bucket_bytes: int = 32 << 20, memory: int = 32 << 20) -> Index:
    """Write the record file, grow the directory and let the owners chain the heads."""
    records = scratch.table(_record(df, text, key, memory), "exact-records")
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    heads = records.where("is_head").select("hash", "part", "head", body.alias("text"))
    buckets = directory(heads.select("hash", F.octet_length("text").alias("bytes")), bucket_bytes)
    first = owners(buckets, max([bucket_bytes, *(n for _, n in buckets)]))

    @F.pandas_udf("int")
    def owner(hashes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(first, hashes.to_numpy().view(np.uint64), side="right") - 1)

    owned = heads.repartitionById(len(first), owner("hash")).sortWithinPartitions("hash", "part", "head")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chain = None, []
        for batch in batches:
            hashes, links = batch.column(0).to_pylist(), []
            for h, raw in zip(hashes, batch.column(3).cast(pa.binary())):
                text_bytes = raw.as_py().translate(None, BLANK)
                if h != current:
                    current, chain = h, []
                place = next((i for i, known in enumerate(chain) if known == text_bytes), len(chain))
                if place == len(chain):
                    chain.append(text_bytes)
                links.append(place)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(links, pa.int64())], ["hash", "part", "head", "link"])

    chained = scratch.table(owned.select("hash", "part", "head", "text").mapInArrow(own, "hash long, part long, head long, link long"), "exact-index")
    summaries = records.where("n > 0").select("part", "head", "seq", "points", "n", "id")
    with_group = chained.join(summaries, ["part", "head"])
    order = F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), F.col("id"), F.col("part"), F.col("seq"))
    groups = with_group.groupBy("hash", "link").agg(F.sum("n").alias("group_size"), F.min(order).alias("best"))
    found = chained.join(groups, ["hash", "link"]).select("part", "head", "group_size", F.col("best.id").alias("keep_id"), F.col("best.part").alias("keep_part"), F.col("best.seq").alias("keep_seq"))
    return Index(records.where("n = 0"), found)


def dedup(df: DataFrame, *, text: str = "text", key: str = "doc_id", bucket_bytes: int = 32 << 20, memory: int = 32 << 20) -> DataFrame:
    """One row for each input row: ``key``, keep_id, group_size, kept, text_sha256."""
    index = build(df, text=text, key=key, bucket_bytes=bucket_bytes, memory=memory)
    rows = index.records.select(F.col("id"), "part", "seq", "head", F.col("sha").alias("text_sha256"))
    stays = (F.col("part") == F.col("keep_part")) & (F.col("seq") == F.col("keep_seq"))
    return rows.join(index.heads, ["part", "head"]).select(F.col("id").alias(key), "keep_id", "group_size", stays.alias("kept"), "text_sha256")


def keep_first(df: DataFrame, *, text: str = "text", key: str = "doc_id", bucket_bytes: int = 32 << 20, memory: int = 32 << 20) -> DataFrame:
    """The rows that stay, with all their columns."""
    index = build(df, text=text, key=key, bucket_bytes=bucket_bytes, memory=memory)
    kept = index.heads.select(F.col("keep_part").alias("part"), F.col("keep_seq").alias("seq")).distinct()
    return index.records.select("row", "part", "seq").join(kept, ["part", "seq"], "left_semi").select("row.*")
