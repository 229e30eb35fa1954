"""Personal data: plain identifiers, and disguised ones by offset-preserving deobfuscation.

Plain emails, IPv4 addresses, card and phone numbers are found in the text itself.  Disguised ones
are found in a normalised text.  A chain of transducers makes it, each keeping for every character
the source range it stands for: homoglyphs and full-width forms become ASCII and zero-width
characters go; runs of spelled digits become digits; "at" and "dot" in words or brackets become
signs.  Names of digits and signs are English, German, French and Spanish.  Identifiers found there
are mapped back to source ranges; those inside a plain one are not added.

Bare words become signs only in a chain of four digit words or numerals at least, or where an "at" is
followed by a host with a spelled dot, so that prose stays prose.  Blanks around words and brackets are
unlimited; between two numerals, three at most count as one number's.  An email disguised by bare words
alone is refused unless its host ends in a top-level domain of the IANA list (``tlds.py``), and a
disguised card or phone number unless it has two different digits.

Null counts as empty; rows without findings have empty lists; every row is judged alone, so repeated
rows get equal results.  All patterns run in linear time on texts of any length.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.tlds import TLDS
from lethe.llm.words import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE_RUN = re.compile(r"\+[0-9][ ().0-9-]++")

ZERO_WIDTH = "​‌‍⁠﻿­"
LOOKALIKE = dict(zip("аеорсухіјѕһԁԛԝьгАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνι", "aeopcyxijshdqwbrABEKMHOPCTXIJSABEZHIKMNOPTYXaopvi")) | {"․": ".", "。": ".", "﹒": ".", "‐": "-", "‑": "-"}
FULL = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
MATH = {chr(c): n for c in [*range(0x1D400, 0x1D800), *range(0x2460, 0x2469), *range(0x2080, 0x208A)] if (n := unicodedata.normalize("NFKC", chr(c))).isascii() and len(n) == 1}
GLYPHS = LOOKALIKE | FULL | MATH | dict.fromkeys(ZERO_WIDTH, "")
#: Ranges that hold all of them: a short class is searched fast.
GLYPH = re.compile("[\u00ad\u0370-\u052f\u200b-\u2011\u2024\u2060\u2080-\u2089\u2460-\u2468\u3002\ufe52\ufeff-\uff5e\U0001d400-\U0001d7ff]")

# The digits from 0 to 9 by their names, and the names of the signs, in the corpus's languages.
DIGIT_NAMES = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGITS = {w: str(i) for names in DIGIT_NAMES for i, w in enumerate(names.split())} | {"oh": "0", "zwo": "2", "fuenf": "5"}
SIGNS = {"plus": "+", "más": "+", "dot": ".", "punkt": ".", "point": ".", "punto": "."}
#: Letters that patterns take for others in any case.
_CASE = str.maketrans("ıİſK", "iisk")
_DOT, _AT = "(?:dot|punkt|point|punto)", "(?:at|arroba|arobase)"
_NUM = rf"(?:{'|'.join(sorted(DIGITS, key=len, reverse=True))}|[0-9])(?![^\W\d_])"
#: Blanks are unlimited next to a word; between two numerals they are few, so that columns of numbers stay apart.
_GAP = rf"(?:(?:[ \t,-]{{1,3}}|(?<=[^\W\d_])[ \t]++|[ \t]++(?=[^\W\d_]))(?:{_DOT}[ \t]++)?|[ \t]?\.[ \t]?)"
SPELLED = re.compile(rf"(?<![^\W_])(?:(?:plus|más)[ \t-]++|\+[ \t]?)?{_NUM}(?:{_GAP}?{_NUM}){{3,}}", re.I)
SPELLED_PART = re.compile(r"\+|\.|[^\W\d_]+|[0-9]")
#: A sign in brackets and the blanks around it; a match begins where the blanks do, so time stays linear.
BRACKET = re.compile(rf"(?<![ \t])[ \t]*+[\[({{<][ \t]*+({_AT}|{_DOT}|@|\.)[ \t]*+[\])}}>][ \t]*+", re.I)
#: Cheap signs that the transducers have anything to do; on lower-cased text.
BRACKET_SIGN = re.compile(rf"[\[({{<][ \t]*+(?:{_AT}|{_DOT}|@|\.)[ \t]*+[\])}}>]")
#: Hosts whose signs are all bare words must end in a top-level domain, or one reserved for examples.
ENDS = TLDS | {"example", "test"}
#: "At" before a host with a spelled dot; "point" and "punto" are too common after an English "at".
BARE_AT = re.compile(
    rf"(?<=[A-Za-z0-9])[ \t]++(?:at[ \t]++(?=[A-Za-z0-9-]{{1,63}}(?:[ \t]++(?:dot|punkt)[ \t]++|[ \t]*+[\[({{<][ \t]*+{_DOT})[A-Za-z\])}}> \t])|(?:arroba|arobase)[ \t]++(?=[A-Za-z0-9-]{{1,63}}(?:[ \t]++{_DOT}[ \t]|[ \t]*+[\[({{<][ \t]*+{_DOT}|\.[A-Za-z])))",
    re.I,
)
BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])[ \t]++dot[ \t]++(?=[A-Za-z0-9])", re.I)
#: A host with dots in other languages; they are words of prose too, so only those after a spelled "at" count.
BARE_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:[ \t]++(?:punkt|point|punto)[ \t]++[A-Za-z0-9-]+)+", re.I)
BARE_HOST_PART = re.compile(r"[ \t]+(?:punkt|point|punto)[ \t]+|[^ \t]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _phones(text: str) -> Iterator[Span]:
    at = text.find("+")
    while at >= 0:
        after = at + 1
        if m := PHONE_RUN.match(text, at):
            run = m[0].rstrip(" ().-")
            if len(run) > 3:
                after = at + len(run)
                if 8 <= len(DIGIT.findall(run)) <= 15:
                    yield "phone", at, after
        at = text.find("+", after)


def plain(text: str) -> list[Span]:
    """Plain identifiers by kind, then start; ends exclusive, in code points."""
    found = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += _phones(text)
    return found


class Tape:
    """A text and, for each of its characters, the source range it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends, self.changed = text, array("q", range(len(text))), array("q", range(1, len(text) + 1)), bytearray(len(text))

    def rewrite(self, pattern: re.Pattern, to) -> None:
        """Replace each match by ``to(match)``: (character, first, last) with offsets in the match."""
        out, starts, ends, changed, at = [], array("q"), array("q"), bytearray(), 0
        for m in pattern.finditer(self.text):
            out.append(self.text[at : m.start()])
            starts += self.starts[at : m.start()]
            ends += self.ends[at : m.start()]
            changed += self.changed[at : m.start()]
            for c, first, last in to(m):
                out.append(c)
                starts.append(self.starts[m.start() + first])
                ends.append(self.ends[m.start() + last - 1])
                changed.append(c != m[0])
            at = m.end()
        if at:
            self.text = "".join([*out, self.text[at:]])
            self.starts, self.ends, self.changed = starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:]


def _spelled(m: re.Match):
    for p in SPELLED_PART.finditer(m[0]):
        word = p[0].translate(_CASE).lower()
        sign = DIGITS.get(word) or SIGNS.get(word)
        if sign or len(word) == 1:
            yield sign or word, p.start(), p.end()


def _sign(m: re.Match):
    yield "@" if m[1].lower() in ("at", "arroba", "arobase", "@") else ".", 0, len(m[0])


def _host(tape: Tape):
    def to(m: re.Match):
        spelled = tape.changed[m.start()]
        for p in BARE_HOST_PART.finditer(m[0]) if spelled else re.finditer("(?s).", m[0]):
            yield "." if spelled and len(p[0]) > 1 else p[0], p.start(), p.end()

    return to


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only show after normalising and aren't inside one of ``base``."""
    low = text.lower()
    glyphs = not text.isascii() and GLYPH.search(text)
    signs = BRACKET_SIGN.search(low) or any(w in low for w in ("dot", "pun", "po", "arr", "aro")) and (BARE_DOT.search(text) or BARE_AT.search(text))
    words = any(not m[0].isdigit() for m in SPELLED.finditer(text))
    return chain(text, base, bool(glyphs)) if glyphs or signs or words else []


def chain(text: str, base: list[Span], glyphs: bool = True) -> list[Span]:
    """The transducers, and identifiers found behind them."""
    tape = Tape(text)
    if glyphs:
        tape.rewrite(GLYPH, lambda m: [(c, 0, 1) for c in GLYPHS.get(m[0], m[0])])
    tape.rewrite(SPELLED, _spelled)
    tape.rewrite(BARE_AT, lambda m: [("@", 0, len(m[0]))])
    tape.rewrite(BRACKET, _sign)
    tape.rewrite(BARE_DOT, lambda m: [(".", 0, len(m[0]))])
    tape.rewrite(BARE_HOST, _host(tape))
    found = []
    for kind, start, end in plain(tape.text):
        if kind == "email":
            end_label = tape.text[start:end].rpartition(".")[2]
            seen = text[tape.starts[start] : tape.ends[end - 1]]
            if not (end_label.isalpha() and 2 <= len(end_label) <= 24) or not (BRACKET_SIGN.search(seen.lower()) or GLYPH.search(seen) or end_label.lower() in ENDS):
                continue
        elif kind != "ip" and len(set(DIGIT.findall(tape.text[start:end]))) == 1:
            continue  # a word such as "null" over and over
        source = (kind, tape.starts[start], tape.ends[end - 1])
        gaps = any(tape.starts[i] != tape.ends[i - 1] for i in range(start + 1, end))
        if (gaps or any(tape.changed[start:end])) and not any(s <= source[1] and source[2] <= e for _, s, e in base):
            found.append(source)
    return found


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans."""
    base = plain(text or "")
    return ordered(base), ordered([*base, *disguised(text or "", base)])


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones joined, replaced by its first one's kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Rows of about a megabyte of text at a time, so no batch's texts are all Python objects at once."""
    for batch in batches:
        for a, b in slices(batch.column(text), 1 << 20):
            yield batch.slice(a, b - a)


def find(df: DataFrame, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, base and spans (arrays of kind, start, end) for every row."""
    source = df.select(*(F.col(k) for k in keys), F.col(text).alias("__text"))
    schema = df.select(*keys).schema.add("base", _spans_type()).add("spans", _spans_type())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches, len(keys)):
            both = [spans_of(t.as_py()) for t in rows.column(len(keys))]
            columns = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x[i]] for x in both], _ARROW_SPANS) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(len(keys))), *columns], [*keys, "base", "spans"])

    return source.mapInArrow(run, schema)


def _spans_type():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(_SPANS)


def redacted(df: DataFrame, *, text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows and columns with ``text`` redacted; a column ``length`` of integers follows it."""
    names = df.columns
    at, count = names.index(text), names.index(length) if length in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches, at):
            texts = rows.column(at).to_pylist()
            spans = [spans_of(t)[1] for t in texts]
            columns = list(rows.columns)
            if any(spans):
                out = [redact(t, s) if s else t for t, s in zip(texts, spans)]
                columns[at] = pa.array(out, columns[at].type)
                if count >= 0 and pa.types.is_integer(columns[count].type):
                    columns[count] = pa.array([n if v == t else len(t) for n, v, t in zip(columns[count].to_pylist(), texts, out)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return df.mapInArrow(run, df.schema)


def summary(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, counts of the plain kinds, base_sha256 and spans; from ``find``."""
    found = find(df, text=text, keys=(key,))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long) as n_{k}") for k in KINDS]
    return found.select(key, *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
