"""Small tables of documents for the tests of this folder."""

import functools

import pyarrow.parquet as pq

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those that the operators make.
CLASH = ("id", "row", "part", "seq", "head", "hash", "kept", "words", "t1", "t2", "runs", "start", "length", "spans", "__text", "size", "label", "node")


def documents(spark, texts, first=0):
    """Ids from ``first`` on; a text may be null."""
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts, first)], SCHEMA)


def clashing(frame):
    for name in CLASH:
        frame = frame.withColumn(name, frame["doc_id"] * 0 - 1)
    return frame


@functools.cache
def small():
    """doc_id and text of the smallest table."""
    table = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
