"""Training rows for the positive-unlabelled classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import held_out


def class_prior(labels: DataFrame, column: str) -> float:
    """Share of positives among the labelled rows outside the held-out fold, over all of them."""
    row = _trusted(labels, column).agg(F.avg("is_positive")).first()
    return 0.5 if row[0] is None else float(row[0])


def _trusted(labels: DataFrame, column: str) -> DataFrame:
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max((F.col(column) == 1).cast("int")).alias("is_positive"))


def sample(docs: DataFrame, labels: DataFrame, column: str, n_positive: int, n_unlabelled: int) -> DataFrame:
    """(doc_id, text, positive, unlabelled) of at most n_positive trusted positives and n_unlabelled other rows.

    Rows are those whose hashed ids are lowest, so the choice is the same for any
    partitioning.  The unlabelled rows are drawn from all documents outside the
    held-out fold, labelled or not; their labels aren't looked at.  The sampled ids
    are broadcast: n_positive + n_unlabelled of them at most.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(column))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    positives = _trusted(labels, column).where("is_positive = 1").select("doc_id").orderBy(order, "doc_id").limit(n_positive)
    unlabelled = ids.where(~held_out(F.col("doc_id"))).orderBy(order, "doc_id").limit(n_unlabelled)
    chosen = (
        positives.select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u"))
        .unionByName(unlabelled.select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u")))
        .groupBy("doc_id")
        .agg(F.max("p").alias("positive"), F.max("u").alias("unlabelled"))
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
