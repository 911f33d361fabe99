"""Connected components and shared buckets, as Spark joins.

Neither needs a group in one task: hot nodes only meet their own minimum (one row), and the skewed
side of such a join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a > b)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b), in any order, with loops or repeats;
    component is the smallest node reachable. Each step is stored, so lineage stays short."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(),
                   "component-edges")
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == seen or not now.n:
            break
        seen, edges = now, stored(_star(edges), "component-edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def shared_buckets(rows: DataFrame) -> DataFrame:
    """The rows (bucket, id, ...) of buckets with more than one id, stored. ``rows`` should be cheap to
    make again: it is read twice rather than written."""
    many = stored(rows.groupBy("bucket").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y")
                  .select(F.col("bucket").alias("many")), "shared-bucket-keys")
    return stored(rows.join(small_side(many), F.col("bucket") == F.col("many")).drop("many"), "shared-buckets")
