"""Language identification: script ranges, per-word scores and a Viterbi path over the words.

Fitting counts the letter trigrams of a bounded sample of labelled rows (about ``sample`` rows a
language, chosen by a hash) on the executors and brings the ``features`` most frequent ones to the
driver.  A word's score for a language is the log-likelihood of its trigrams, relative to the best
language and clipped.  Scripts narrow the candidates: a language in which a script has under 1 % of
the sampled letters can't claim words of that script unless no language can.  The path of highest
score, less ``penalty`` for each switch, labels every word; runs of one label are the spans.  Most
texts need no path: if no stretch of words gains the penalty by leaving the text's best language,
that language is the path.

Null texts and those without a letter are ``und`` with score 0.  A text of scripts never sampled
gets the most frequent language at score 0.  Without any labelled row all texts are ``und``.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm.words import slices

WORD = re.compile(r"[^\W\d_]+")
#: The same for lower-cased text of these characters alone, with a class that is searched faster.
PLAIN = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")
PLAIN_WORD = re.compile(r"[a-zß-öø-ÿ]+")
#: First code point of each range of scripts.
SCRIPTS = np.array([0, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1780, 0x1800, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3130, 0x3190, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000])
SAMPLE, FEATURES, PENALTY, CLIP = 1500, 60_000, 14.0, 8.0
CACHE_WORDS = 400_000


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    keys: np.ndarray  # trigrams as sorted integers
    scores: np.ndarray  # a row for each key and one for all others, a column for each language
    scripts: np.ndarray  # candidates by script and language


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all words, each between two blanks, and where each word's begin."""
    joined = " " + "  ".join(words) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    starts = np.concatenate([[0], np.cumsum([len(w) + 2 for w in words])[:-1]]).astype(np.int64)
    keys = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    inside = np.ones(len(keys), bool)
    inside[starts[1:] - 1] = inside[starts[1:] - 2] = False
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return keys[inside], np.concatenate([[0], np.cumsum(lengths)[:-1]])


def fit(df: DataFrame, *, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Learn from rows with a text and a label; at most about ``sample`` rows of each label are read whole."""
    known = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)).alias("at"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    prior = np.array([totals[x] for x in languages], dtype=float)
    empty = Model(languages, prior, np.zeros(0, np.int64), np.zeros((1, len(languages))), np.ones((len(SCRIPTS), len(languages)), bool))
    if not languages:
        return empty
    share = F.create_map(*(F.lit(x) for name in languages for x in (name, min(1 << 20, int((1 << 20) * sample / totals[name]) + 1))))
    chosen = known.where(F.col("at") < share[F.col("label")]).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(name, []).extend(WORD.findall(lowered(value)))
            for name, words in by.items():
                if words:
                    keys, n = np.unique(_codes(words)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], ["label", "gram", "n"])

    grams = chosen.mapInArrow(count, "label string, gram long, n long").groupBy("gram").pivot("label", languages).agg(F.sum("n")).na.fill(0)
    rows = grams.orderBy(F.desc(sum((F.col(f"`{x}`") for x in languages), F.lit(0))), "gram").limit(features).toPandas()
    keys = rows["gram"].to_numpy(np.int64)
    order = np.argsort(keys)
    counts = rows[languages].to_numpy(float)[order]
    keys = keys[order]
    total = counts.sum(axis=0)
    smooth = 0.5
    scores = np.log((np.vstack([counts, np.zeros(len(languages))]) + smooth) / (total + smooth * (len(keys) + 1)))
    letters = np.zeros((len(SCRIPTS), len(languages)))
    np.add.at(letters, np.searchsorted(SCRIPTS, keys >> 21 & 0x1FFFFF, side="right") - 1, counts)
    scripts = letters >= 0.01 * np.maximum(letters.sum(axis=0), 1)
    scripts[~scripts.any(axis=1)] = True
    return Model(languages, prior, keys, scores, scripts)


class Scorer:
    """Scores of words, remembered by word; those of unknown words are computed together."""

    def __init__(self, model: Model) -> None:
        self.model, self.place = model, {}
        self.table = np.zeros((1 << 12, len(model.languages)), np.float32)

    def learn(self, words: set[str]) -> None:
        if len(self.place) > CACHE_WORDS:
            self.place.clear()
        new = [w for w in words if w not in self.place]
        if not new:
            return
        keys, starts = _codes(new)
        model = self.model
        at = np.minimum(np.searchsorted(model.keys, keys), max(len(model.keys) - 1, 0))
        at = np.where(model.keys[at] == keys, at, len(model.keys)) if len(model.keys) else np.zeros(len(keys), np.int64)
        found = np.add.reduceat(model.scores[at], starts, axis=0)
        unknown = np.add.reduceat((at == len(model.keys)).astype(np.int64), starts) == np.diff([*starts, len(keys)])
        script = np.searchsorted(SCRIPTS, np.fromiter((ord(w[0]) for w in new), np.int64, len(new)), side="right") - 1
        found[unknown] = 0
        found = np.where(model.scripts[script], found, found.min(axis=1, keepdims=True) - 2 * CLIP)
        found = np.maximum(found - found.max(axis=1, keepdims=True), -CLIP)
        first, last = len(self.place), len(self.place) + len(new)
        if last > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(last, 2 * len(self.table)) - len(self.table), self.table.shape[1]), np.float32)])
        self.table[first:last] = found
        self.place.update(zip(new, range(first, last)))

    def scores(self, words: list[list[str]]) -> list[np.ndarray]:
        """Scores of each text's words."""
        self.learn(set().union(*words))
        lengths = [len(w) for w in words]
        flat = np.fromiter(map(self.place.__getitem__, itertools.chain.from_iterable(words)), np.int64, sum(lengths))
        return np.split(self.table[flat], np.cumsum(lengths)[:-1])


def path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Label of each word on the path of highest score less ``penalty`` for each switch."""
    n, k = scores.shape
    best = int(scores.sum(axis=0, dtype=np.float64).argmax())
    if k == 1:
        return np.zeros(n, np.int64)
    gain = np.delete(scores, best, axis=1).max(axis=1).astype(np.float64) - scores[:, best]
    run = np.cumsum(gain)
    if (run - np.minimum.accumulate(np.concatenate([[0.0], run[:-1]]))).max() < penalty:
        return np.full(n, best)
    rows, value, back = scores.tolist(), scores[0].tolist(), []
    for row in rows[1:]:
        most = max(value)
        top, over = value.index(most), most - penalty
        back.append([j if v >= over else top for j, v in enumerate(value)])
        value = [(v if v >= over else over) + x for v, x in zip(value, row)]
    out = np.zeros(n, np.int64)
    at = out[-1] = value.index(max(value))
    for t in range(n - 1, 0, -1):
        at = out[t - 1] = back[t - 1][at]
    return out


def _has_letter(words: list[str]) -> bool:
    return any(any(map(str.isalpha, w)) for w in words)


def lowered(text: str) -> str:
    """Lower case of the same length: the capital dotted I becomes a plain i, not two characters."""
    return text.replace("\u0130", "i").lower()


def words_of(low: str) -> list[str]:
    return (WORD if PLAIN.search(low) else PLAIN_WORD).findall(low)


def label_many(texts: list[str | None], scorer: Scorer, penalty: float) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and labelled spans of each text."""
    lows = [lowered(t or "") for t in texts]
    words = [words_of(low) for low in lows]
    if not scorer.model.languages:
        return [("und", 0.0, [])] * len(texts)
    return [_label(*x, scorer.model, penalty) for x in zip(lows, words, scorer.scores(words))]


def _label(low: str, words: list[str], scores: np.ndarray, model: Model, penalty: float) -> tuple[str, float, list[tuple[int, int, str]]]:
    names = model.languages
    if not _has_letter(words):
        return "und", 0.0, []
    labels = path(scores, penalty)
    if not scores.any():
        return names[int(model.prior.argmax())], 0.0, []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    weight = np.bincount(labels, weights=lengths, minlength=len(names))
    best = int(weight.argmax())
    totals = np.sort(scores[labels == best].sum(axis=0, dtype=np.float64))
    sure = 1 / (1 + np.exp(-min(60.0, totals[-1] - totals[-2]))) if len(names) > 1 else 1.0
    changes = np.flatnonzero(np.diff(labels)) + 1
    edges = [0, *changes.tolist(), len(words)]
    if len(edges) > 2:
        where = [m.span() for m in WORD.finditer(low)]
        spans = [(where[a][0], where[b - 1][1], names[int(labels[a])]) for a, b in zip(edges, edges[1:])]
    else:
        spans = [(low.index(words[0]), low.rindex(words[-1]) + len(words[-1]), names[int(labels[0])])]
    return names[best], float(weight[best] / weight.sum() * sure), spans


def predict(df: DataFrame, model: Model, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",), penalty: float = PENALTY) -> DataFrame:
    """``keys``, lang_pred, score, spans (start, end in code points, lang) for every row."""
    source = df.select(*(F.col(k) for k in keys), F.col(text).alias("__text"))
    span = T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("lang", "string"))
    schema = df.select(*keys).schema.add("lang_pred", "string").add("score", "double").add("spans", span)
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(len(keys))
            found = [x for a, b in slices(texts, 1 << 20) for x in label_many(texts[a:b].to_pylist(), scorer, penalty)]
            spans = [[{"start": a, "end": b, "lang": x} for a, b, x in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(keys))), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, arrow)],
                [*keys, "lang_pred", "score", "spans"],
            )

    return source.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from fitting: the CRC-32 of its id as text leaves 1 modulo 3; a null id is."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def accept(df: DataFrame, model: Model, *, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """All columns of the rows that have a language, that is: all but ``und``."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(at)
            keep = [x[0] != "und" for a, b in slices(texts, 1 << 20) for x in label_many(texts[a:b].to_pylist(), scorer, penalty)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
