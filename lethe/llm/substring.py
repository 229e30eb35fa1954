"""Substring deduplication: words covered by a window of ``window`` words that begins elsewhere too.

Level-wise doubling.  Windows of the shortest length are counted first; only where one is repeated
can a window of twice its length be, so the candidates of each level are the windows of the next,
until the full length is reached.  [18, 35] are the levels of a window of 35.

Not every window need be counted below the full length.  A full window is represented by the
sub-window with the least hash in it, its anchor, and equal windows have equal anchors, so a full
window whose anchor is alone is alone.  Consecutive windows share anchors: about one word in nine is
one.  At the full length the windows of one anchor form a run; equal runs are joined before their
windows are counted, and of runs found twice no window needs a look-up.

Keys and memory: texts are known by two 64-bit hashes; windows are equal when their hash and their
anchor's are.  Tasks hold a few megabytes of text at a time.  Groups of equal runs and anchors are
counted with partial aggregation, and joins put rows of one key into no single list.

Null and empty texts have no words; texts shorter than a window keep all; repeated rows count as
different places, so both lose what they share.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm import words as W
from lethe.plans import scratch

SHORTEST = 16


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths from the shortest to ``window``, each at most twice the one before."""
    out = [window]
    while (half := (out[0] + 1) // 2) >= shortest:
        out.insert(0, half)
    return out


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Place of the least of each n consecutive values, the first of equal ones."""
    at, width = np.arange(len(values)), 1
    while width < n:
        step = min(width, n - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        width += step
    return at


def _runs(words: np.ndarray, lengths: np.ndarray, window: int, level: int, allowed: np.ndarray | None) -> tuple[W.Windows, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of full windows with one anchor: text, first start, number of starts, anchor (in all words)."""
    hashes = W.Windows(words)
    text = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    starts = np.flatnonzero(np.arange(len(words)) + window <= ends[text]) if len(words) else np.zeros(0, np.int64)
    if allowed is not None:
        starts = starts[allowed[starts]]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return hashes, none, none, none, none
    anchor = _least(hashes(level), window - level + 1)[starts]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(starts) != 1) | (np.diff(text[starts]) != 0)]))
    return hashes, text[starts[new]], starts[new], np.diff([*new, len(starts)]), anchor[new]


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and hashes of all words."""
    found = W.cut(texts)
    return found.lengths, found.hashes()


def _allowed(runs: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """Which words begin a window of the runs (start << 16 | number of starts) of their text."""
    first = np.concatenate([[0], np.cumsum(lengths)])
    packed = runs.flatten().to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
    at = first[text] + (packed >> 16)
    edge = np.zeros(first[-1] + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (packed & 0xFFFF), -1)
    return np.cumsum(edge)[:-1] > 0


def _anchors(df: DataFrame, window: int, level: int, only_hash: bool) -> DataFrame:
    """h, and t1, t2, run of every run; df: t1, t2, text and perhaps runs."""
    limited = "runs" in df.columns
    schema = "h long" if only_hash else "h long, t1 long, t2 long, run long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                lengths, words = _split(part.column(2))
                hashes, text, start, n, anchor = _runs(words, lengths, window, level, _allowed(part.column(3), lengths) if limited else None)
                if not len(text):
                    continue
                columns = [pa.array(hashes(level)[anchor].view(np.int64))]
                if not only_hash:
                    first = np.concatenate([[0], np.cumsum(lengths)])
                    columns += [part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array((start - first[text]) << 16 | n)]
                yield pa.RecordBatch.from_arrays(columns, ["h", "t1", "t2", "run"][: len(columns)])

    return df.select("t1", "t2", "text", *(["runs"] if limited else [])).mapInArrow(run, schema)


def _full(df: DataFrame, window: int, level: int, with_windows: bool) -> DataFrame:
    """Runs of full windows: r1, r2 (hash of the run); and anchor, copies, windows, or t1, t2, start, n."""
    schema = "r1 long, r2 long, anchor long, copies long, windows array<long>" if with_windows else "r1 long, r2 long, t1 long, t2 long, start long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                lengths, words = _split(part.column(2))
                hashes, text, start, n, anchor = _runs(words, lengths, window, level, _allowed(part.column(3), lengths))
                if not len(text):
                    continue
                full, anchors = hashes(window), hashes(level)[anchor]
                raw, heads = full.tobytes(), anchors.tobytes()
                digests = b"".join([xxhash.xxh3_128_digest(heads[8 * i : 8 * i + 8] + raw[8 * s : 8 * (s + k)]) for i, (s, k) in enumerate(zip(start.tolist(), n.tolist()))])
                keys = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
                columns = [pa.array(keys[:, 0]), pa.array(keys[:, 1])]
                where = pa.array(text)
                if with_windows:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    inside = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], n)
                    columns += [pa.array(anchors.view(np.int64)), part.column(4).take(where), pa.ListArray.from_arrays(pa.array(offsets), pa.array(full[inside].view(np.int64)))]
                    yield pa.RecordBatch.from_arrays(columns, ["r1", "r2", "anchor", "copies", "windows"])
                else:
                    first = np.concatenate([[0], np.cumsum(lengths)])
                    columns += [part.column(0).take(where), part.column(1).take(where), pa.array(start - first[text]), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["r1", "r2", "t1", "t2", "start", "n"])

    return df.select("t1", "t2", "text", "runs", "copies").mapInArrow(run, schema)


def _candidates(texts: DataFrame, window: int, level: int) -> DataFrame:
    """t1, t2, runs of the texts with an anchor that is found twice."""
    spark = texts.sparkSession
    weight = F.lit(1) if "copies" not in texts.columns else None
    counted = _anchors(texts, window, level, True).groupBy("h").agg(F.count("*").alias("n"))
    if weight is None:  # copies of a text were joined to one row
        counted = counted.union(_anchors(texts.where("copies > 1"), window, level, True).groupBy("h").agg(F.count("*").alias("n"))).groupBy("h").agg(F.sum("n").alias("n"))
    repeated, path = scratch.write(counted.where("n > 1").select("h"), "substring-anchors")
    runs = _anchors(texts, window, level, False).distinct().join(repeated, "h").groupBy("t1", "t2").agg(F.collect_set("run").alias("runs"))
    found = scratch.table(runs, "substring-runs")
    scratch.drop(spark, path)
    return found


def _join_copies(df: DataFrame) -> DataFrame:
    """One row for adjacent rows of one text, with the number of rows as copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            one, two, n = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(4).to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (np.diff(one) != 0) | (np.diff(two) != 0)]))
            copies = np.add.reduceat(n, new)
            rows = batch.take(pa.array(new))
            if held is not None:
                if held.column(0)[0] == rows.column(0)[0] and held.column(1)[0] == rows.column(1)[0]:
                    copies[0] += held.column(4)[0].as_py()
                else:
                    yield held
            rows = rows.set_column(4, "copies", pa.array(copies))
            if len(rows) > 1:
                yield rows.slice(0, len(rows) - 1)
            held = rows.slice(len(rows) - 1)
        if held is not None:
            yield held

    return df.mapInArrow(run, df.schema)


def _finish(df: DataFrame, window: int, digest: bool) -> DataFrame:
    """t1, t2, n_words, n_removed, kept of texts with marks; df: t1, t2, text, marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                found = W.cut(part.column(2))
                first = np.concatenate([[0], np.cumsum(found.lengths)])
                edge = np.zeros(first[-1] + 1, np.int64)
                for at, marks in zip(first.tolist(), part.column(3)):
                    for mark in marks.as_py():
                        begins = at + mark["start"] + (np.array(mark["inside"], np.int64) if mark["inside"] is not None else np.arange(mark["n"]))
                        np.add.at(edge, begins, 1)
                        np.add.at(edge, begins + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                kept = pa.array([_kept(x, digest) for x in found.joined(~gone)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found.lengths), pa.array(removed), kept], ["t1", "t2", "n_words", "n_removed", "kept"])

    return df.mapInArrow(run, "t1 long, t2 long, n_words long, n_removed long, kept string").dropDuplicates(["t1", "t2"])


def _kept(joined: memoryview, digest: bool) -> str:
    return hashlib.sha256(joined).hexdigest() if digest else str(joined, "utf-8")


def _whole(df: DataFrame, keys: tuple[str, ...], digest: bool) -> DataFrame:
    """``keys``, t1, t2, words, whole (all words kept); df: ``keys``, t1, t2, text."""
    schema = df.select(*keys, "t1", "t2").schema.add("words", "long").add("whole", "string")
    last = len(keys) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(last)):
                part = batch.slice(a, b - a)
                found = W.cut(part.column(last))
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(found.lengths), pa.array([_kept(x, digest) for x in found.joined()], pa.string())], [f.name for f in schema])

    return df.mapInArrow(run, schema)


def dedup(df: DataFrame, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",), window: int = 35, digest: bool = False) -> DataFrame:
    """``keys``, n_words, n_removed and kept (the kept words, or with ``digest`` their SHA-256) for every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = df.select(*(F.col(k) for k in keys), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit("other"), body).alias("t2"), body.alias("text"))
    texts = named.select("t1", "t2", "text")
    steps = levels(window)
    if len(steps) == 1:
        steps = [max(1, window // 2), window]
    found = None
    for level in steps[:-1]:
        runs = _candidates(texts if found is None else found, window, level)
        joined = texts.withColumn("copies", F.lit(1).cast("long")) if found is None else found.drop("runs")
        joined = joined.join(runs, ["t1", "t2"]).select("t1", "t2", "text", "runs", "copies").sortWithinPartitions("t1", "t2")
        found = scratch.table(_join_copies(joined), "substring-texts")
    level = steps[-2]
    runs = scratch.table(
        _full(found, window, level, True).groupBy("r1", "r2").agg(F.sum("copies").alias("copies"), F.first("anchor").alias("anchor"), F.first("windows").alias("windows")), "substring-windows"
    )
    repeated = runs.select("anchor", "copies", F.explode("windows").alias("w")).groupBy("anchor", "w").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor", "w")
    single = runs.where("copies = 1").select("r1", "r2", "anchor", F.posexplode("windows").alias("i", "w")).join(repeated, ["anchor", "w"]).groupBy("r1", "r2").agg(F.collect_list("i").alias("inside"))
    inside = runs.where("copies > 1").select("r1", "r2", F.lit(None).cast("array<int>").alias("inside")).unionByName(single)
    marks = _full(found, window, level, False).join(inside, ["r1", "r2"]).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "n", "inside")).alias("marks"))
    cut = scratch.table(_finish(found.join(marks, ["t1", "t2"]).select("t1", "t2", "text", "marks"), window, digest), "substring-cut")
    rows = _whole(named, keys, digest).join(cut, ["t1", "t2"], "left")
    return rows.select(*keys, F.col("words").alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept"))
