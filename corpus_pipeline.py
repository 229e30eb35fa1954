"""A training corpus in five stages, each written as Parquet and read again by the next.

Language ID drops documents without a language; exact and MinHash near-duplicate removal keep one row
of each group; PII is replaced by its kind in brackets; packing returns the token sequences' pieces.
Rows with null ids stay through the first four stages.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm import exact, langid, minhash, packing, pii
from lethe.llm.queries import vocabulary
from lethe.plans import scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; learnt from the labelled ones that aren't held out."""
    return langid.accept(docs, langid.fit(docs.where(~langid.held_out())))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    return exact.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by similar sets of five-word shingles (0.8 and more)."""
    return minhash.keep_first(docs, n=5, percent=80)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    pieces = packing.pack(docs, vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("pack", pack),
]

#: Viterbi paths, MinHash candidates, transducers and the tokenizer aren't SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = ""
    for name, stage in STAGES:
        with scratch.scope() as keep:  # what a stage's operator wrote goes once its rows are written
            docs, new = scratch.write(stage(spark, docs, sf_dir), f"corpus-{name}")
            keep.append(new)
        if path:
            scratch.drop(spark, path)
        path = new
    return docs
