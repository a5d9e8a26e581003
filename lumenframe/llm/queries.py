"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bpe_segtree, fill_middle, html_gbt, jaccard_forest, license_scan, line_dedup, packing, pu_quality, pu_toxicity, simhash_grid, source_audit, syncmers, topk_vafile
from lumenframe.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_topk_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_vafile.search(spark, table(spark, sf_dir, "embeddings"))


def op2_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.join(spark, table(spark, sf_dir, "documents"))


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.with_neighbours(spark, table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, table(spark, sf_dir, "documents"))


def op9_html_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_gbt.extract(table(spark, sf_dir, "pages"))


def op10_bpe_segtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_segtree.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op12_simhash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_grid.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_topk_vafile, op2_jaccard_forest, op3_quality_pu, op4_packing, op5_syncmers, op6_line_dedup, op7_toxicity_pu,
        op8_license_scan, op9_html_gbt, op10_bpe_segtree, op11_fill_middle, op12_simhash_grid, op13_source_audit,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_vafile": topk_vafile.SQL, "op6_line_dedup": line_dedup.SQL, "op8_license_scan": license_scan.sql(), "op11_fill_middle": fill_middle.SQL, "op13_source_audit": source_audit.SQL}
