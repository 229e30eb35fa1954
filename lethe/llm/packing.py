"""Packing of token sequences by minimum bin slack.

A document's ids, closed by ``end``, are cut into full windows; what remains is shorter than a
window and waits in a pool.  A window takes the longest waiting remainder and the multiset of
others that comes closest to its capacity: a bitset subset-sum over the lengths with their counts,
kept after each length so that the counts can be read off backwards.  Where slack is left, a piece
cut from the next remainder fills it.  What a task has left at its end, less than a window, is cut
into sequences whose lengths are powers of two, which need no padding.

Each task packs its own rows, so nothing is shuffled, and holds at most ``pool`` remainders.
sequence_id is the task's partition number times 2**33 plus a counter.

Null and empty texts are one sequence piece holding ``end`` alone; equal rows are packed each for
themselves; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm import bpe
from lethe.llm.words import slices

POOL = 2048


def fill(counts: dict[int, int], first: int, capacity: int) -> tuple[list[int], int]:
    """Lengths that come closest to ``capacity`` together with ``first``, and the slack that stays."""
    room = capacity - first
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        n, part = min(counts[length], room // length), 1
        while n > 0:
            take = min(part, n)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            n, part = n - take, part * 2
        if reach >> room & 1:
            break
    total = at = reach.bit_length() - 1
    chosen: list[int] = []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen += [length] * take
            at -= length * take
    return chosen, room - total


class Packer:
    """Sequences from ids; a piece is (row, start, ids as bytes, ids of its document, sequence, offset)."""

    def __init__(self, capacity: int, base: int, pool: int = POOL) -> None:
        self.capacity, self.base, self.most = capacity, base, pool
        self.sequence, self.n = 0, 0
        self.waiting: dict[int, list] = {}
        self.counts: dict[int, int] = {}
        self.done: list[tuple] = []

    def _put(self, pieces: list) -> None:
        offset = 0
        for row, start, ids, total in pieces:
            self.done.append((row, start, ids, total, self.base + self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def _wait(self, piece) -> None:
        length = len(piece[2]) // 4
        self.waiting.setdefault(length, []).append(piece)
        self.counts[length] = self.counts.get(length, 0) + 1
        self.n += 1

    def _take(self, length: int):
        self.counts[length] -= 1
        self.n -= 1
        piece = self.waiting[length].pop()
        if not self.counts[length]:
            del self.counts[length], self.waiting[length]
        return piece

    def _cut(self, piece, length: int):
        row, start, ids, total = piece
        self._wait((row, start + length, ids[4 * length :], total))
        return row, start, ids[: 4 * length], total

    def add(self, row, ids: bytes) -> None:
        total, size = len(ids) // 4, 4 * self.capacity
        for at in range(0, len(ids) - size + 1, size):
            self._put([(row, at // 4, ids[at : at + size], total)])
        if rest := ids[len(ids) // size * size :]:
            self._wait((row, total - len(rest) // 4, rest, total))
        while self.n >= self.most:
            self._window(self.capacity)

    def _window(self, capacity: int) -> None:
        """One sequence of exactly ``capacity``; as much must wait."""
        longest = max((x for x in self.counts if x <= capacity), default=0)
        if not longest:
            self._put([self._cut(self._take(max(self.counts)), capacity)])
            return
        pieces = [self._take(longest)]
        lengths, slack = fill(self.counts, longest, capacity)
        pieces += [self._take(x) for x in lengths]
        while slack:
            length = min((x for x in self.counts if x > slack), default=0) or max(self.counts)
            piece = self._take(length)
            pieces.append(self._cut(piece, slack) if length > slack else piece)
            slack -= min(slack, length)
        self._put(pieces)

    def finish(self) -> None:
        left = sum(k * n for k, n in self.counts.items())
        while left >= self.capacity:
            self._window(self.capacity)
            left -= self.capacity
        while left:
            size = 1 << (left.bit_length() - 1)
            self._window(size)
            left -= size


def pack(df: DataFrame, vocabulary: str, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",), capacity: int = 1024, end: int = 0) -> DataFrame:
    """``keys``, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    source = df.select(*(F.col(k) for k in keys), F.col(text).alias("__text"))
    schema = df.select(*keys).schema
    for name, kind in (("start", "long"), ("length", "long"), ("ids", "binary"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")):
        schema = schema.add(name, kind)
    stop = end.to_bytes(4, "little")

    def rows(packer: Packer, kinds: list[pa.DataType]) -> pa.RecordBatch:
        done, packer.done = packer.done, []
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array([x[0][k] for x in done], kind) for k, kind in enumerate(kinds)),
                pa.array([x[1] for x in done], pa.int64()),
                pa.array([len(x[2]) // 4 for x in done], pa.int64()),
                pa.array([x[2] for x in done], pa.binary()),
                pa.array([x[3] for x in done], pa.int64()),
                pa.array([x[4] for x in done], pa.int64()),
                pa.array([x[5] for x in done], pa.int64()),
            ],
            [f.name for f in schema],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(vocabulary)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.column(k).type for k in range(len(keys))]
            texts, names = batch.column(len(keys)), [batch.column(k).to_pylist() for k in range(len(keys))]
            for a, b in slices(texts):
                ids, edges = model.encode_array(texts[a:b])
                for i, (first, last) in enumerate(zip(edges.tolist(), edges[1:].tolist()), a):
                    packer.add(tuple(x[i] for x in names), ids[first:last].astype("<u4").tobytes() + stop)
                if packer.done:
                    yield rows(packer, kinds)
        packer.finish()
        if packer.done:
            yield rows(packer, kinds)

    return source.mapInArrow(run, schema)
