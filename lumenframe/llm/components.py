"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import shared_dir


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Link the neighbours of every node to the least of them and itself: only greater (large) or lesser (small) neighbours move."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # written before the join: a hub of many neighbours is one key of it, and Spark splits a key only between plain exchanges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).checkpoint()
    joined = near.join(least, "u")
    out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if not small else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def roots(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has links; root: the least node that it hangs together with.

    edges: columns a, b (long), in any direction.  Rounds are logarithmic in the number
    of nodes; each ends in a checkpoint on the shared folder.
    """
    shared_dir(spark)
    stand = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = stand(edges)
    while before[0]:
        edges = _stars(_stars(edges, small=False), small=True).checkpoint()
        now = stand(edges)
        if tuple(now) == tuple(before):
            break
        before = now
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own)
