"""A corpus pipeline of five stages: what each keeps is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import jaccard_forest, line_dedup, packing, pu_quality, pu_toxicity
from lumenframe.llm.common import table, written
from lumenframe.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu_quality.keep(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu_toxicity.keep(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_forest.keep_one(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, TOKENIZER)


STAGES = [("quality", quality), ("toxicity", toxicity), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicates), ("packing", pack)]

#: SQL can't express the classifiers, the join's signatures or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir; every stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
