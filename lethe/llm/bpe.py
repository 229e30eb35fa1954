"""Byte-level BPE encoding and decoding.

Each pre-token is merged over a contiguous rank array: the parts and the ranks of adjacent parts
lie side by side, the smallest rank is found by a scan, its boundary is deleted and the two
neighbouring ranks are looked up again.  A block of words not met before is merged at once, a row
of a matrix each.  The scan is quadratic in the length of a word, so words over ``SHORT`` bytes
keep their parts in a linked list under a heap instead.

Texts are cut as one array of bytes: where classes of characters change, with the pattern's rules for
blanks and contractions.  Texts with other characters than ASCII and the letters of Latin-1, and those
with special tokens, are cut by the pattern itself.  Words met before are known by a 64-bit hash, and
their ids lie in one array; a worker remembers ``CACHE_WORDS`` of them and then starts anew.

Results per row: null and empty texts have no ids; texts of any length are encoded whole; equal
texts have equal ids.  Extra columns of the input are not read.
"""

from __future__ import annotations

import functools
import heapq
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm.words import bytes_of, hash_pieces, slices

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 64
NONE = (1 << 31) - 1
CACHE_WORDS = 600_000
BLOCK = 4096
#: Classes of bytes in texts of ASCII and Latin-1 letters, whose second bytes count as letters.
BLANK, LETTER, DIGIT, OTHER = range(4)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = BLANK
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = LETTER
_KIND[48:58] = DIGIT
#: Bytes of such texts; 0xC3 must be followed by a second byte other than those of two signs.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(9, 14), *range(32, 127), 0xC3]] = True
_SECOND = np.zeros(256, bool)
_SECOND[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file to byte: printable Latin-1 stands for itself, the rest for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary, merges and added tokens of a tokenizers JSON file with a byte-level BPE."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        known = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")}
        if model["type"] != "BPE" or spec.get("normalizer") or any(known.values()) or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: only a plain byte-level BPE is supported")
        alphabet = byte_alphabet()
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.pieces: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.pieces[i] = bytes(alphabet[c] for c in text) if all(c in alphabet for c in text) else text.encode()
        for text, i in self.added.items():
            self.pieces[i] = text.encode()
        self.single = [vocab.get(c, -1) for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << 32 | vocab[right]] = (rank, vocab[left + right])
        self.ranks = Table()
        self.ranks.add(np.fromiter(self.merges, np.uint64, len(self.merges)), np.arange(len(self.merges), dtype=np.int32))
        self.made = np.array([made for _, made in self.merges.values()], dtype=np.int32)
        self.single_array = np.array(self.single, dtype=np.int32)
        self.split = regex.compile(SPLIT)
        self.added_first = {t.encode()[:1] for t in self.added}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.forget()
        self.piece_array = np.array(self.pieces, dtype=object)
        self.decimal_array = np.array([str(i) for i in range(size)], dtype=object)

    def _rank(self, left: int, right: int) -> tuple[int, int]:
        return self.merges.get(left << 32 | right, (NONE, -1))

    def forget(self) -> None:
        """Drop the words met so far: ``place`` in the lists by hash, and ids one after another."""
        self.place, self.n_words, self.n_ids = Table(), 0, 0
        self.begins, self.sizes, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.ranks.get(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))
        return np.where(found < 0, NONE, found)

    def merge_block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of 1 to ``SHORT`` bytes each, one after another, and their numbers."""
        n, width = len(words), max(map(len, words))
        length = np.fromiter(map(len, words), dtype=np.int64, count=n)
        raw = np.zeros((n, width), dtype=np.uint8)
        raw[np.arange(width) < length[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
        parts = np.concatenate([self.single_array[raw], np.zeros((n, 1), np.int32)], axis=1)
        ranks = np.full((n, width + 1), NONE, dtype=np.int32)
        inside = np.arange(width - 1) < length[:, None] - 1
        ranks[:, : width - 1][inside] = self._pair_ranks(parts[:, : width - 1][inside], parts[:, 1:width][inside])
        out, row, columns = np.zeros((n, width), np.int32), np.arange(n), np.arange(width + 1, dtype=np.int16)
        left = length.copy()
        while len(row):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), at]
            if (over := least == NONE).any():
                out[row[over]], left[row[over]] = parts[over, :width], length[over]
                going = ~over
                row, parts, ranks, length, at, least = row[going], parts[going], ranks[going], length[going], at[going], least[going]
                if not len(row):
                    break
            i, after, length = np.arange(len(row)), columns[:-1] - at[:, None].astype(np.int16), length - 1
            parts[:, :-1] = np.where(after > 0, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(after >= 0, ranks[:, 1:], ranks[:, :-1])
            parts[i, at] = self.made[least]
            right, before = at + 1 < length, at > 0
            i, at = np.concatenate([i[right], i[before]]), np.concatenate([at[right], at[before] - 1])
            ranks[i, at] = self._pair_ranks(parts[i, at], parts[i, at + 1])
        return out[np.arange(width) < left[:, None]], left

    def _learn(self, words: list[bytes], keys: np.ndarray) -> None:
        """Merge words that aren't remembered, those of like length in one block."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(length, kind="stable")
        short = order[: np.searchsorted(length[order], SHORT, side="right")]
        for a in range(0, len(short), BLOCK):
            at = short[a : a + BLOCK]
            self._remember(keys[at], *self.merge_block([words[i] for i in at.tolist()]))
        for i in order[len(short) :].tolist():
            ids = np.array(self._merge_long([self.single[b] for b in words[i]]), np.int32)
            self._remember(keys[i : i + 1], ids, np.array([len(ids)]))

    def _remember(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last, end = self.n_words, self.n_words + len(keys), self.n_ids + len(ids)
        if last > len(self.sizes):
            self.begins, self.sizes = (np.concatenate([x, np.zeros(max(last, 2 * len(x)) - len(x), np.int64)]) for x in (self.begins, self.sizes))
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end, 2 * len(self.ids)) - len(self.ids), np.int32)])
        self.begins[first:last] = self.n_ids + np.cumsum(sizes) - sizes
        self.sizes[first:last] = sizes
        self.ids[self.n_ids : end] = ids
        self.place.add(keys, np.arange(first, last, dtype=np.int32))
        self.n_words, self.n_ids = last, end

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self._rank(parts[i], parts[i + 1])[0], i, parts[i], parts[i + 1]) for i in range(n - 1)]
        heap = [x for x in heap if x[0] != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue  # a neighbour was merged meanwhile
            parts[i], parts[j] = self._rank(left, right)[1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (rank := self._rank(parts[a], parts[b])[0]) != NONE:
                    heapq.heappush(heap, (rank, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text, special tokens whole."""
        if self.special is None:
            return self.split.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.split.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.split.findall(text[at:])

    def _cut(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin in the bytes of some texts."""
        begins, bad = plain_begins(data, edges)
        odd = set((np.searchsorted(edges, np.flatnonzero(bad), side="right") - 1).tolist())
        for token in self.added:
            if (mark := token.encode()) in (raw := data.tobytes()):
                at = raw.find(mark)
                while at >= 0:
                    odd.add(int(np.searchsorted(edges, at, side="right")) - 1)
                    at = raw.find(mark, at + 1)
        for i in odd:
            a, b = int(edges[i]), int(edges[i + 1])
            sizes = [len(t.encode()) for t in self.tokens(data[a:b].tobytes().decode())]
            begins[a:b] = False
            begins[a + np.cumsum([0, *sizes[:-1]])] = True
        return np.flatnonzero(begins)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin, with the end of the last."""
        data, edges = bytes_of(texts)
        starts = self._cut(data, edges)
        ends = np.append(starts[1:], len(data))
        keys = hash_pieces(data, starts, ends)
        if self.n_words > CACHE_WORDS:
            self.forget()
        place = self.place.get(keys)
        if len(missing := np.flatnonzero(place < 0)):
            new, at = np.unique(keys[missing], return_index=True)
            words = [data[a:b].tobytes() for a, b in zip(starts[missing[at]].tolist(), ends[missing[at]].tolist())]
            special = np.fromiter((w.decode() in self.added if w[:1] in self.added_first else False for w in words), bool, len(words))
            for i in np.flatnonzero(special).tolist():
                self._remember(new[i : i + 1], np.array([self.added[words[i].decode()]], np.int32), np.array([1]))
            self._learn([w for w, s in zip(words, special.tolist()) if not s], new[~special])
            place[missing] = self.place.get(keys[missing])
        sizes = self.sizes[place]
        last = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.begins[place] - last[:-1], sizes) + np.arange(last[-1])]
        return ids, last[np.searchsorted(starts, edges)]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, edges = self.encode_array(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, special tokens kept; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(self.piece_array[np.asarray(ids, dtype=np.int64)].tolist()).decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray) -> str:
        return ",".join(self.decimal_array[ids].tolist())


def plain_begins(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens begin in texts of ASCII and Latin-1 letters, and the bytes of other characters."""
    n = len(data)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    first = np.zeros(n + 2, bool)
    first[edges[:-1][edges[:-1] < edges[1:]]] = True
    kind = _KIND[data]
    bad = ~_PLAIN[data]
    second = _SECOND[data]
    bad[1:] &= ~(second[1:] & (data[:-1] == 0xC3))
    bad[:-1] |= (data[:-1] == 0xC3) & ~second[1:]
    begins = first[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # the last character of white space before something else: a blank goes with it, others stand alone
    at = np.flatnonzero(begins[1:] & (kind[:-1] == BLANK) & ~first[1:n]) + 1
    begins[at - 1] = True
    begins[at[data[at - 1] == 32]] = False
    # contractions of one and of two letters, where the quote begins a pre-token
    more = np.concatenate([data, np.zeros(3, np.uint8)])
    quote = np.flatnonzero((data == ord("'")) & begins)
    quote = quote[~first[quote + 1]]
    one, two = more[quote + 1], more[quote + 2]
    short = quote[np.isin(one, np.frombuffer(b"stmd", np.uint8))]
    long = quote[(np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~first[quote + 2]]
    for found, size in ((short, 2), (long, 3)):
        begins[found + 1] = False
        after = found + size
        begins[after[after < n]] = True
    return begins, bad


class Table:
    """Numbers from 0 on by 64-bit key, for arrays of keys: a hash table with open addressing."""

    def __init__(self) -> None:
        self.n = 0
        self._empty(12)

    def _empty(self, bits: int) -> None:
        self.bits, self.keys, self.found = bits, np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put keys that aren't there yet, each with a number of its own."""
        self.n += len(keys)
        if 3 * self.n > 1 << self.bits:
            used = self.found >= 0
            old = self.keys[used], self.found[used]
            self._empty((3 * self.n).bit_length() + 1)
            self._put(*old)
        self._put(keys, values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = self._slots(keys)
        while len(keys):
            free = self.found[slot] < 0
            self.found[slot[free]] = values[free]
            put = free & (self.found[slot] == values)
            self.keys[slot[put]] = keys[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys, -1 where there is none."""
        slot = self._slots(keys)
        out, other = self.found[slot], self.keys[slot] != keys
        todo = np.flatnonzero(other & (out >= 0))
        out[other] = -1
        while len(todo):
            at = slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found, same = self.found[at], self.keys[at] == keys[todo]
            out[todo[same]] = found[same]
            todo = todo[~same & (found >= 0)]
        return out


@functools.cache
def load(path: str) -> Bpe:
    """One model for each worker process."""
    return Bpe(path)


def encode(df: DataFrame, vocabulary: str, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``ids``, an array of int, for every row; null and empty texts have an empty array."""
    source = df.select(*(F.col(k) for k in keys), F.col(text).alias("__text"))
    schema = df.select(*keys).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(vocabulary)
        for batch in batches:
            texts = batch.column(len(keys))
            for a, b in slices(texts):
                ids, edges = model.encode_array(texts[a:b])
                column = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(len(keys))), column], [*keys, "ids"])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, *, ids: str = "ids", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``text`` for every row; a null array gives a null text, an empty one an empty text."""
    source = df.select(*(F.col(k) for k in keys), F.col(ids).alias("__ids"))
    schema = df.select(*keys).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                found = row.column(len(keys))[0]
                out = None if not found.is_valid else model.decode(found.values.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(row.column(k) for k in range(len(keys))), pa.array([out], pa.string())], [*keys, "text"])

    return source.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode in one pass: ``keys``, n_tokens, ids_sha256, decoded_sha256."""
    import hashlib

    source = df.select(*(F.col(k) for k in keys), F.col(text).alias("__text"))
    schema = df.select(*keys).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(vocabulary)
        for batch in batches:
            texts = batch.column(len(keys))
            for a, b in slices(texts):
                n, of_ids, of_text = [], [], []
                flat, edges = model.encode_array(texts[a:b])
                for first, last in zip(edges.tolist(), edges[1:].tolist()):
                    ids = flat[first:last]
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(model.decimals(ids).encode()).hexdigest())
                    of_text.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(len(keys))), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [*keys, "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, schema)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
