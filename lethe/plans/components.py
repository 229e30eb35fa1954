"""Connected components by alternating large and small stars, without lists of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.plans import scratch


def _large(edges: DataFrame) -> DataFrame:
    """Each node points its larger neighbours to the least node it sees."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node points itself and its smaller neighbours to the least of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def labels(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of all nodes in ``links`` (a, b) that aren't the least.

    The work of a round is a few joins and aggregations on the links; rounds grow with the logarithm
    of the number of nodes.  Each round's links are a table in the shared folder.
    """
    spark = links.sparkSession
    greater, lesser = F.greatest("a", "b"), F.least("a", "b")
    now, path = scratch.write(links.where("a <> b").select(greater.alias("a"), lesser.alias("b")).distinct(), "links")
    mark = None
    while True:
        new, new_path = scratch.write(_small(_large(now)), "links")
        scratch.drop(spark, path)
        now, path = new, new_path
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        mark = seen
