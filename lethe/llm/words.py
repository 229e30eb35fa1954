"""Words of texts and hashes of their windows, many texts at a time.

Texts are worked on as one array of bytes: white space is looked up in a table, and words are hashed
eight bytes at a time, all words at once, so nothing is kept by word in Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: By number of bytes, those of a long that count.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words over so many bytes are hashed one by one.
LONG_WORD = 256


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    x = (left ^ (left >> np.uint64(31))) * _A + (right ^ (right >> np.uint64(29))) * _B
    x ^= x >> np.uint64(32)
    x *= _A
    return x ^ (x >> np.uint64(29))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of some texts, null ones empty, and where each text begins, with the end of the last."""
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = raw.buffers()
    edges = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1] if offsets else np.zeros(1, np.int64)
    first = int(edges[0]) if len(edges) else 0
    data = np.frombuffer(data, np.uint8)[first : int(edges[-1])] if data else np.zeros(0, np.uint8)
    return data, edges - first


def hash_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the pieces of ``data``, the same in every process; pieces up to eight bytes of one length never collide."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    longs = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64), longs[starts] & _MASK[np.minimum(size, 8)])
    todo = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    at = 8
    while len(todo):
        out[todo] = mix(out[todo], longs[starts[todo] + at] & _MASK[np.minimum(size[todo] - at, 8)])
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(padded[starts[i] : ends[i]].data)
    return out


@dataclass
class Cut:
    """The words of some texts: bytes, where each word begins and ends, and each text's number of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lengths: np.ndarray

    def hashes(self) -> np.ndarray:
        return hash_pieces(self.data, self.starts, self.ends)

    def joined(self, kept: np.ndarray | None = None) -> list[memoryview]:
        """Each text's words, or those that are ``kept``, joined by one space."""
        text = np.repeat(np.arange(len(self.lengths)), self.lengths)
        starts, ends = self.starts, self.ends
        if kept is not None:
            text, starts, ends = text[kept], starts[kept], ends[kept]
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[starts] += 1
        np.subtract.at(edge, ends, 1)
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        data = np.where(inside, self.data, np.uint8(32))
        inside[ends[:-1][text[:-1] == text[1:]]] = True
        sizes = np.bincount(text, weights=ends - starts, minlength=len(self.lengths)).astype(np.int64)
        sizes += np.maximum(np.bincount(text, minlength=len(self.lengths)) - 1, 0)
        out, edges = memoryview(data[inside]), [0, *np.cumsum(sizes).tolist()]
        return [out[a:b] for a, b in zip(edges, edges[1:])]


def cut(texts: pa.Array, *, lower: bool = False) -> Cut:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts; with ``lower`` A-Z in lower case."""
    data, edges = bytes_of(texts)
    data = _LOWER[data] if lower else data
    blank = _BLANK[data]
    begins, stops = ~blank, ~blank
    begins[1:] &= blank[:-1]
    stops[:-1] &= blank[1:]
    inner = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(data))]
    begins[inner] = ~blank[inner]
    stops[inner - 1] = ~blank[inner - 1]
    starts = np.flatnonzero(begins)
    return Cut(data, starts, np.flatnonzero(stops) + 1, np.diff(np.searchsorted(starts, edges)))


class Windows:
    """Hashes of the windows that begin at each word of some concatenated texts.

    A window of n words is its first 2**k words followed by the rest, so hashes double in length.
    Entries whose window runs past the end of everything are left out; windows over the border of
    two texts are there and are for the caller to skip.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.known = {1: words}

    def __call__(self, n: int) -> np.ndarray:
        if n not in self.known:
            first = 1 << (n - 1).bit_length() - 1
            left, right = self(first), self(n - first)
            size = max(0, len(self.known[1]) - n + 1)
            self.known[n] = mix(left[:size], right[first : first + size])
        return self.known[n]


def slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text, one row at least."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + (n or 0) > most:
            yield start, i
            start, size = i, 0
        size += n or 0
    if start < len(texts):
        yield start, len(texts)
