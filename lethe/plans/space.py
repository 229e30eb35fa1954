"""What the sharing policies cost before and after one person's erasure, by DataFrame functions.

Chunks are aggregated once, by class and fingerprint; a row then stands for all chunks alike, so the
policies are applied to a few dozen rows and not to chunks.  Chunks without an owner are nobody's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lethe.functions import columns as C
from lethe.plans import scratch
from lethe.sources import mapping

#: Sharing policies that the space queries compare: mode, wrap mode, mixed policy.
MODES = (
    ("or-wrap", "or-wrap", "or-wrap"),
    ("and-wrap", "and-wrap", "or-wrap"),
    ("no-cross-user", "no-cross-user", "never-share"),
    ("copy-out-mixed", "or-wrap", "copy-out-mixed"),
    ("drop-for-both", "or-wrap", "drop-for-both"),
)
#: Bytes that encryption adds to a chunk.
TAG = 16
#: The mode that others are compared with.
APART = "no-cross-user"


def _mine() -> Column:
    return F.coalesce(F.col("subject") == mapping.ERASED, F.lit(False))


def _theirs() -> Column:
    return F.coalesce(F.col("subject") != mapping.ERASED, F.lit(False))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.exploded(mapping.log(spark, sf_dir))


def kinds(chunk: DataFrame) -> DataFrame:
    """file_class, shared, erased, others, cost, n: what is kept if equal chunks are shared, and if not.

    ``erased`` and ``others`` say whether the erased person or anyone else owns it.  At most 24 rows.
    """
    by_fp = chunk.groupBy("file_class", "fp").agg((F.max("n") + TAG).alias("each"), F.count_if(_mine()).alias("mine"), F.count_if(_theirs()).alias("theirs"), F.count("*").alias("copies"))
    of = lambda shared, erased, others, n: F.struct(F.lit(shared).alias("shared"), erased.alias("erased"), others.alias("others"), n.cast("long").alias("n"))
    yes, no = F.lit(True), F.lit(False)
    kept = F.array(
        of(True, F.col("mine") > 0, F.col("theirs") > 0, F.lit(1)), of(False, yes, no, F.col("mine")), of(False, no, yes, F.col("theirs")), of(False, no, no, F.col("copies") - F.col("mine") - F.col("theirs"))
    )
    rows = by_fp.select("file_class", "each", F.inline(kept)).where("n > 0")
    return rows.groupBy("file_class", "shared", "erased", "others").agg(F.sum(F.col("each") * F.col("n")).alias("cost"), F.sum("n").alias("n"))


def _live(wrap: str, policy: str, erased: Column, others: Column) -> Column:
    """Whether keys open a chunk after the erasure."""
    if wrap == "and-wrap":
        return ~erased
    return others & (F.col("file_class") != "mixed") if policy in ("copy-out-mixed", "drop-for-both") else others


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kinds`` by mode, with ``live`` after the erasure; ``copied`` rows are what copying out adds."""
    modes = [F.struct(F.lit(m).alias("mode"), C.shares("file_class", w, p).alias("share"), _live(w, p, F.col("erased"), F.col("others")).alias("live")) for m, w, p in MODES]
    kept = kinds(chunks(spark, sf_dir)).select("file_class", "shared", "cost", "n", F.inline(F.array(*modes))).where("share = shared")
    redacted = mapping.exploded(mapping.conversations(spark, sf_dir), "redacted").where(_theirs())
    copied = redacted.groupBy("file_class").agg(F.sum(F.col("n") + TAG).alias("cost"), F.count("*").alias("copies"))
    return kept.select("mode", "file_class", "live", F.lit(False).alias("copied"), "cost", "n").union(
        copied.select(F.lit("copy-out-mixed"), "file_class", F.lit(True), F.lit(True), "cost", "copies")
    )


def _total(column: str, where: str | Column | None = None) -> Column:
    return F.sum(column) if where is None else F.coalesce(F.sum(F.when(F.expr(where) if isinstance(where, str) else where, F.col(column))), F.lit(0))


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space before the erasure, when all chunks are live."""
    found = states(spark, sf_dir).where("not copied").groupBy("mode").agg(_total("cost").alias("physical_bytes"), _total("n").alias("n_chunks"))
    return found.withColumns({"live_bytes": F.col("physical_bytes"), "n_live_chunks": F.col("n_chunks")})


def erase_live(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    """Space by class after the erasure."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = states(spark, sf_dir).where((F.col("mode") == mode) & ~F.col("copied")).groupBy("file_class")
        return found.agg(_total("cost").alias("physical_bytes"), _total("cost", "live").alias("live_bytes"), _total("n").alias("n_chunks"), _total("n", "live").alias("n_live_chunks"))

    return query


def erase_live_copy_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What copying out leaves of the old chunks, and what it adds."""
    kept = F.sum(F.when(F.expr("live and not copied"), F.col("cost")))
    return states(spark, sf_dir).where("mode = 'copy-out-mixed'").agg(kept.alias("kept_bytes"), _total("cost", "copied").alias("copied_bytes"), _total("n", "copied").alias("copied_chunks"))


def mode_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space of every mode before and after the erasure."""
    return states(spark, sf_dir).groupBy("mode").agg(
        _total("cost", "not copied").alias("live_bytes_before"), _total("cost", "live").alias("live_bytes_after"), _total("cost").alias("physical_bytes_after"),
        _total("n", "live").alias("n_live_chunks_after"), _total("n").alias("n_chunks"),
    )


def space_vs_never_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live bytes of every mode as shares of those without sharing; the window spans one row a mode."""
    ratio = lambda c: F.round(F.col(c).cast("double") / F.nullif(F.max(F.when(F.col("mode") == APART, F.col(c))).over(Window.partitionBy(F.lit(1))), F.lit(0)), 4)
    return mode_table(spark, sf_dir).select("mode", ratio("live_bytes_before").alias("ratio_before"), ratio("live_bytes_after").alias("ratio_after"))


def leftover_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that keys still open after the erasure."""
    return states(spark, sf_dir).where("live and not copied").groupBy("mode", "file_class").agg(F.sum("n").alias("chunks"), F.sum("cost").alias("bytes"))


def restore_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by mode and by why they can't be restored, or not as they were ('' if they can).

    The fingerprints that the erased person owns, or nobody else, are written before they are joined, so
    that the rows of a frequent one are split over tasks.
    """
    rows = chunks(spark, sf_dir).select("seq", "subject", "file_class", "fp")
    owners = rows.groupBy("file_class", "fp").agg(F.bool_or(_mine()).alias("erased"), F.bool_or(_theirs()).alias("others"))
    touched = scratch.table(owners.where("erased or not others"), "touched-chunks")
    found = rows.join(touched, ["file_class", "fp"], "left").withColumns({"erased": F.coalesce("erased", F.lit(False)), "others": F.coalesce("others", F.lit(True))})
    files = found.groupBy("seq", "subject", "file_class").agg(F.bool_or("erased").alias("erased"), F.bool_and("others").alias("others"))
    alike = files.groupBy("file_class", _mine().alias("mine"), _theirs().alias("theirs"), "erased", "others").agg(F.count("*").alias("n"))
    modes = []
    for mode, wrap, policy in MODES:
        share, lost = C.shares("file_class", wrap, policy), {"copy-out-mixed": "copy-out", "drop-for-both": "immutable-mixed"}.get(policy)
        whole = _live(wrap, policy, F.when(share, F.col("erased")).otherwise(F.col("mine")), F.when(share, F.col("others")).otherwise(F.col("theirs")))
        reason = F.when(F.col("mine"), "recipe-erased")
        if lost:
            reason = reason.when(F.col("file_class") == "mixed", lost)
        modes.append(F.struct(F.lit(mode).alias("mode"), reason.when(whole, "").otherwise("missing-key").alias("reason")))
    return alike.select("n", F.inline(F.array(*modes))).groupBy("mode", "reason").agg(F.sum("n").alias("files"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "store_stats": store_stats,
    "erase_live_or_wrap": erase_live("or-wrap"),
    "erase_live_and_wrap": erase_live("and-wrap"),
    "erase_live_no_cross_user": erase_live("no-cross-user"),
    "erase_live_drop": erase_live("drop-for-both"),
    "erase_live_copy_out": erase_live_copy_out,
    "mode_table": mode_table,
    "space_vs_never_share": space_vs_never_share,
    "leftover_chunks": leftover_chunks,
    "restore_status": restore_status,
}
