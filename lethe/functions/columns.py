"""Column functions of the engine; all run in the JVM but random keys, secrets, and the packing of pieces."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SIZE = 4096
TAG_BYTES = 16  # authentication tag counted with every stored chunk
#: Spark's AES-GCM output is nonce, ciphertext and tag; the nonce isn't counted.
NONCE_BYTES = 12

CLASSES = ("unique", "identical", "mixed")
WRAP_MODES = ("or-wrap", "and-wrap", "no-cross-user")
MIXED_POLICIES = ("never-share", "or-wrap", "copy-out-mixed", "drop-for-both", "keep-for-bob")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    """``value`` if it is allowed, else ValueError."""
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def pieces(data: Column | str, size: int = CHUNK_SIZE) -> Column:
    """Array of the consecutive pieces of a binary column; empty data is one empty piece."""
    data = F.col(data) if isinstance(data, str) else data
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(data) / size).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def fingerprint(piece: Column | str) -> Column:
    """Hex SHA-256 of a piece."""
    return F.sha2(piece, 256)


def piece_structs(data: Column | str, size: int = CHUNK_SIZE) -> Column:
    """Array of (fp, n) by piece: all that space accounting needs of a payload."""
    return F.transform(pieces(data, size), lambda p: F.struct(fingerprint(p).alias("fp"), F.octet_length(p).cast("long").alias("n")))


def ascii_lower(text: Column | str) -> Column:
    """Lower case of A to Z alone."""
    return F.translate(text, _UPPER, _LOWER)


def strip_lines(data: Column | str, subject: Column | str) -> Column:
    """Binary ``data`` without the lines that contain ``subject`` in any ASCII case."""
    text = F.decode(data, "ISO-8859-1")  # every byte is a character, so any bytes survive
    subject = F.col(subject) if isinstance(subject, str) else subject
    token = ascii_lower(F.decode(F.encode(subject, "UTF-8"), "ISO-8859-1"))
    kept = F.filter(F.split(text, "\n", -1), lambda line: ~F.contains(ascii_lower(line), token))
    return F.encode(F.array_join(kept, "\n"), "ISO-8859-1")


def shares(file_class: Column | str, wrap_mode: str, mixed_policy: str) -> Column:
    """Whether a file's chunks may be shared with equal ones of its class."""
    cross = wrap_mode != "no-cross-user"
    file_class = F.col(file_class) if isinstance(file_class, str) else file_class
    return (
        F.when(file_class == "unique", F.lit(True)).when(file_class == "identical", F.lit(cross)).when(file_class == "mixed", F.lit(cross and mixed_policy == "or-wrap"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown file class: "), file_class)).cast("boolean"))
    )


def held(recipe: str = "r", hold: str = "h") -> Column:
    """Whether a hold covers a recipe: each dimension that is given matches, and one is given."""
    same, given = F.lit(True), F.lit(False)
    for name in ("subject", "snapshot_id", "path"):
        wanted = F.nullif(F.col(f"{hold}.{name}"), F.lit(""))
        same &= F.coalesce(wanted == F.col(f"{recipe}.{name}"), F.lit(True))
        given |= wanted.isNotNull()
    return same & given


def _random_keys(rows: pd.Series) -> pd.Series:
    import secrets

    return pd.Series([secrets.token_bytes(32) for _ in range(len(rows))])


def random_key() -> Column:
    """A 256-bit key from the system's secure source; write it before it is used twice."""
    return F.pandas_udf(_random_keys, T.BinaryType()).asNondeterministic()(F.lit(1))


def place_secrets() -> Callable[[Column], Column]:
    """A function of a binary column: 64 bytes that belong to it, an HMAC-SHA-512 with a key of this call.

    The key lives in this process and its tasks alone: it stands in no plan and in no file.
    """
    import secrets

    key = secrets.token_bytes(32)

    def digest(places: pd.Series) -> pd.Series:
        import hashlib
        import hmac

        return places.map(lambda place: hmac.digest(key, bytes(place), hashlib.sha512))

    return F.pandas_udf(digest, T.BinaryType())


def _packed(data: bytes | None) -> bytes | None:
    import zlib

    if data is None:
        return None
    body = zlib.compress(data, 1)
    return len(body).to_bytes(4, "big") + body


def _unpacked(packed: bytes | None) -> bytes | None:
    import zlib

    if packed is None:
        return None
    view, at, found = memoryview(packed), 0, []
    while at < len(view):
        end = at + 4 + int.from_bytes(view[at : at + 4], "big")
        found.append(zlib.decompress(view[at + 4 : end]))
        at = end
    return b"".join(found)


def pack(piece: Column | str) -> Column:
    """A piece compressed, behind its packed length; packed pieces may be joined end to end."""

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(_packed)

    return F.pandas_udf(run, T.BinaryType())(piece)


def unpack(packed: Column | str) -> Column:
    """The bytes of a piece, or of all that are joined; null stays null."""

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(_unpacked)

    return F.pandas_udf(run, T.BinaryType())(packed)


#: Bits of a mask for each of its ids, of which each sets ``MASK_PLACES``: one other value in 270 seems to be of the mask.
MASK_BITS, MASK_PLACES = 32, 2
#: 64-bit words of a mask at least and at most; the largest takes 16 MB, and with over four million ids more others seem to be of it.
MASK_LEAST, MASK_MOST = 1 << 8, 1 << 21


def _place(value: Column, k: int, words: Column | int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(k)), F.lit(words) * 64)


def mask_words(n: int) -> int:
    """Words of the mask of ``n`` ids: a power of two."""
    return min(MASK_MOST, max(MASK_LEAST, 1 << (max(1, n) * MASK_BITS // 64).bit_length()))


def mask(ids: DataFrame, column: str) -> DataFrame:
    """One row, ``mask``: bits for the hashes of the column's values, so ``in_mask`` misses none of them; ``ids`` is counted first, so it is best a table."""
    words = mask_words(ids.count())
    spots = ids.select(F.explode(F.array(*[_place(F.col(column), k, words) for k in range(MASK_PLACES)])).alias("at"))
    set_ = spots.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    every = ids.sparkSession.range(words, numPartitions=1).select(F.col("id").cast("int").alias("word"))
    rows = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.join(set_, "word", "left").agg(F.transform(rows, lambda x: x["bits"]).alias("mask"))


def in_mask(column: str) -> Column:
    """Whether a value may be one of those of the mask; a few others seem to be."""
    found = F.lit(True)
    for k in range(MASK_PLACES):
        at = _place(F.col(column), k, F.size("mask"))
        word = F.get("mask", F.floor(at / 64).cast("int"))
        found &= F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return found
