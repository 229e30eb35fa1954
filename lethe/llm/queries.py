"""The queries of this package over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm import bpe, exact, html_text, langid, license, media, minhash, packing, pii, substring


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), vocabulary())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.dedup(_documents(spark, sf_dir), window=35, digest=True)
    return cut.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs, model, keys=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(_documents(spark, sf_dir).select("doc_id", "text"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(_documents(spark, sf_dir))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source and tens of hundreds are directories, each hundredth document a licence file."""
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    above = F.expr("concat_ws('/', source, concat('k', doc_id div 1000), concat('h', doc_id div 100))")
    root = F.expr("concat_ws('/', source, concat('k', doc_id div 1000))")
    path = F.concat_ws("/", F.when(F.col("doc_id") % 200 == 0, root).otherwise(above), name)
    return license.scan(_documents(spark, sf_dir).withColumn("path", path), keys=("doc_id",))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup(_documents(spark, sf_dir).select("doc_id", "text"), n=3, percent=85)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_media": op5_media,
    "op6_html_text": op6_html_text,
    "op7_license_scan": op7_license_scan,
    "op8_packing": op8_packing,
    "op9_minhash": op9_minhash,
    "op10_pii": op10_pii,
}

_BLANK = r"[\x20\x09-\x0D]"
ORACLES: dict[str, str] = {
    "op4_exact_dedup": rf"""
        with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g') as norm from documents),
             g as (select doc_id, norm, first_value(doc_id) over (partition by norm order by length(t) desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from d)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g""",
    "op7_license_scan": license.oracle("""
        select doc_id, text, concat_ws('/', source, 'k' || (doc_id // 1000), case when doc_id % 200 = 0 then null else 'h' || (doc_id // 100) end,
               case when doc_id % 100 = 0 then 'LICENSE' else doc_id || '.txt' end) as path from documents"""),
}
