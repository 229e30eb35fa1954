"""The driver's tables as an ingest log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.functions import columns as C
from lethe.plans import scratch

#: The person whose erasure the space queries account for, and the word that names them in mixed files.
ERASED, TOKEN = "src0", "user"
MIXED_FROM = 1_000_000_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, tenant, subject, snapshot_id, path, data, n_bytes, pieces, file_class of each document.

    A text found under several sources is identical, else unique.  Sources are compared by the hash
    of the text, aggregated before the shuffle, so texts stay where they are read.  The hashes of several
    sources are written before they are joined: a join of two scans is broadcast if they turn out few,
    and the rows of a frequent text are split over tasks if not.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").alias("seq"), F.col("lang").alias("tenant"), F.col("source").alias("subject"), F.concat(F.lit("t"), F.expr("doc_id div 12")).alias("snapshot_id"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"),
        F.octet_length(data).cast("long").alias("n_bytes"), C.piece_structs(data).alias("pieces"), F.sha2(data, 256).alias("whole"),
    )
    owners = rows.groupBy("whole").agg((F.min("subject") != F.max("subject")).alias("several"))
    several = scratch.table(owners.where("several"), "several-sources")
    return rows.join(several, "whole", "left").withColumn("file_class", F.when(F.col("several"), "identical").otherwise("unique")).drop("whole", "several")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, data: one file for each conversation, a ``role: text`` line for each turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").cast("binary").alias("data"), F.sort_array(F.collect_set("role")).alias("roles"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcripts as mixed files: one row for each conversation and participating role.

    The user is the person ``ERASED``; other roles own their copies by their names.
    """
    files = transcripts(spark, sf_dir).select("conv_id", "data", F.posexplode("roles").alias("k", "role"))
    redacted = C.strip_lines("data", F.lit(TOKEN))
    return files.select(
        (F.lit(MIXED_FROM) + F.col("conv_id") * 10 + F.col("k")).cast("long").alias("seq"), F.lit("chat").alias("tenant"), F.when(F.col("role") == TOKEN, ERASED).otherwise(F.col("role")).alias("subject"), F.lit("chat").alias("snapshot_id"),
        F.concat(F.lit("chat/"), F.col("conv_id")).alias("path"), F.octet_length("data").cast("long").alias("n_bytes"), C.piece_structs("data").alias("pieces"), F.lit("mixed").alias("file_class"), F.octet_length(redacted).cast("long").alias("n_redacted"), C.piece_structs(redacted).alias("redacted"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and conversations in one log, without payloads."""
    names = ["seq", "tenant", "subject", "snapshot_id", "path", "file_class", "n_bytes", "pieces"]
    return documents(spark, sf_dir).select(names).unionByName(conversations(spark, sf_dir).select(names))


def exploded(rows: DataFrame, pieces: str = "pieces") -> DataFrame:
    """One row for each chunk: seq, tenant, subject, snapshot_id, path, file_class, pos, fp, n."""
    return rows.select("seq", "tenant", "subject", "snapshot_id", "path", "file_class", F.posexplode(pieces).alias("pos", "p")).select("seq", "tenant", "subject", "snapshot_id", "path", "file_class", F.col("pos").cast("long").alias("pos"), "p.fp", "p.n")
