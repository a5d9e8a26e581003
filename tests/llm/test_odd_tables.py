"""Ids, extra columns and empty tables: what every operator and stage must leave as it is."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import bpe_segtree, html_gbt, jaccard_forest, license_scan, line_dedup, packing, pu_quality, pu_toxicity, syncmers
from tests.llm.test_llm import DOCS, TOKENIZER, labels, odd_rows, prose

BIG = 2**60 + 1
#: Names that the operators use within.
INNER = ("__dropped", "__id", "__hash", "__kept", "dropped", "id", "hash", "row", "kept", "node", "root", "links", "h1", "h2", "positive", "unlabelled", "score", "predicted", "grp", "part", "tail", "first_id", "path", "depth")


def big_rows():
    texts = [None, "A line of some length here\nx", "A line of some length here\ny " + prose(1, 30), prose(2, 60), prose(2, 60), ""]
    return [(BIG + k if t is not None else None, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(None, prose(2, 60), None, None, None)]


@pytest.fixture(scope="module")
def big(spark):
    return spark.createDataFrame(big_rows(), DOCS).coalesce(1)


def known(spark):
    return labels(spark, [(BIG + k, k % 2, k % 2) for k in range(6)])


IDS = {
    "op2": lambda spark, d: jaccard_forest.join(spark, d),
    "op3": lambda spark, d: pu_quality.classify(d, known(spark)),
    "op4": lambda spark, d: packing.packed(d, TOKENIZER),
    "op5": lambda spark, d: syncmers.with_neighbours(spark, d),
    "op6": lambda spark, d: line_dedup.dedup(d),
    "op7": lambda spark, d: pu_toxicity.classify(d, known(spark)),
    "op10": lambda spark, d: bpe_segtree.round_trip(d, TOKENIZER),
    "encoded": lambda spark, d: bpe_segtree.encoded(d, TOKENIZER),
}


@pytest.mark.parametrize("name", IDS)
def test_large_ids_beside_nulls_stay(spark, big, name):
    got = sorted((r[0] for r in IDS[name](spark, big).select("doc_id").collect()), key=lambda i: i or 0)
    want = sorted((r[0] for r in big_rows() if name != "op2" or r[0] is not None), key=lambda i: i or 0)
    assert got == want


def test_large_page_ids_beside_nulls_stay(spark):
    rows = [(BIG, "u", "<p>One text, of some words.</p>"), (None, None, None), (BIG + 1, "u", "")]
    got = html_gbt.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert [(r.page_id, r.url) for r in got] == [(i, u) for i, u, _ in rows]


def test_large_ids_of_license_scans_stay(spark):
    rows = [(BIG, "Released under the MIT License."), (None, "Released under the MIT License.")]
    assert {r.doc_id for r in license_scan.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {BIG, None}


def stages(spark):
    return {
        "quality": lambda d: pu_quality.keep(d, known(spark)),
        "toxicity": lambda d: pu_toxicity.keep(d, known(spark)),
        "accept all": lambda d: pu_quality.filtered(d, lambda ts: [0.0] * len(ts), lambda s: [True] * len(s)),
        "line dedup": line_dedup.clean,
        "near duplicates": lambda d: jaccard_forest.keep_one(spark, d),
    }


@pytest.mark.parametrize("stage", ["quality", "toxicity", "accept all", "line dedup", "near duplicates"])
def test_stages_leave_other_columns_as_they_are(spark, big, stage):
    wide = big
    for c in INNER:
        wide = wide.withColumn(c, F.lit("clash"))
    wide = wide.withColumn("big", F.when(F.col("doc_id").isNotNull(), F.lit(BIG))).withColumn("money", F.lit(Decimal("12345678901234567.89"))).withColumn("at", F.lit(datetime.datetime(2024, 1, 2, 3, 4, 5, 678901))).withColumn("many", F.array(F.lit(BIG), F.lit(None).cast("long")))
    out = stages(spark)[stage](wide)
    assert out.columns == wide.columns and [f.dataType for f in out.schema] == [f.dataType for f in wide.schema]
    before = {(r.doc_id, r.text if stage != "line dedup" else None): r for r in wide.collect()}
    got = out.collect()
    for r in got:
        was = before[r.doc_id, r.text if stage != "line dedup" else None] if stage != "line dedup" or r.doc_id is not None else None
        if was:
            assert all(r[c] == was[c] for c in wide.columns if c not in ("text", "n_chars"))
    if stage in ("line dedup", "accept all"):
        assert len(got) == len(big_rows())
    if stage == "near duplicates":
        assert {r.doc_id for r in got} == {None, BIG + 1, BIG + 2, BIG + 3, BIG + 5}


@pytest.mark.parametrize("stage", ["quality", "toxicity", "accept all", "line dedup", "near duplicates"])
def test_stages_of_odd_and_empty_tables(spark, stage):
    odd = spark.createDataFrame(odd_rows(), DOCS)
    assert 0 <= stages(spark)[stage](odd).count() <= len(odd_rows())
    none = stages(spark)[stage](spark.createDataFrame([], DOCS))
    assert none.columns == odd.columns and none.count() == 0


def test_packing_splits_rows_that_repeat_each_other(spark):
    rows = spark.createDataFrame([(None, "", "en", "s", 0)] * 600, DOCS)
    got = packing.packed(rows, TOKENIZER, group=100).toPandas()
    assert len(got) == 600 and (got.sequence_id // 2**32).nunique() >= 5


def test_a_cluster_needs_a_named_folder():
    from types import SimpleNamespace

    from lumenframe.llm import common

    none = SimpleNamespace(get=lambda *_: None)
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: none, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False, isEmpty=lambda: True))))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(sparkContext=sc, conf=none))
