"""Every query that has SQL gives what DuckDB gives, on the smallest tables; the others run."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

from lumenframe.operators import learning, tests_of_groups
from lumenframe.plans import queries as plans
from lumenframe.plans import kernel_queries, view_queries  # noqa: F401  add their queries
from lumenframe.plans.queries import QUERIES, SQL, learnt

SF = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"classify_svc", "classify_xgboost", "smooth_ceemdan", "baseline_goldindec", "fit_statistics", "fit_params", "shap_xgboost", "adaptive_search", "search_logistic_regression", "search_svc", "search_decision_tree", "search_random_forest", "search_xgboost"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: The kernels of the baselines are tested by themselves; one stands for their queries. So are the fit methods.
OTHERS = {n for n in QUERIES if n not in SQL and n not in SLOW and (not n.startswith("baseline_") or n == "baseline_arpls") and (not n.startswith("fit_method_") or n == "fit_method_tnc")}


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_query_runs(spark, name):
    got = QUERIES[name](spark, SF).limit(1000).toPandas()
    assert len(got)
    for c in got.columns:  # no column is empty, and numbers are finite where they are given
        values = got[c].dropna()
        assert len(values) or c in ("feature", "statistic", "peaks"), c  # those of whole tests are null, and spectra without spikes have no peaks
        if values.dtype.kind == "f":
            assert np.isfinite(values).all(), c


def test_models_learn_from_every_row(spark, con):
    rows, classes, new = con.sql("SELECT count(*), count(DISTINCT label), count(*) FILTER (vec_id % 5 = 0) FROM embeddings").fetchall()[0]
    data = learnt(spark, SF)
    assert (data.count(), data.select("label").distinct().count()) == (rows, classes)
    assert QUERIES["classify_lda"](spark, SF).count() == rows and QUERIES["production_predict"](spark, SF).count() == new
    assert {r.label for r in QUERIES["classify_lda_of_classes"](spark, SF).select("label").distinct().collect()} == {0, 1, 2}


def test_queries_leave_the_operators_their_own_settings(spark, monkeypatch):
    monkeypatch.setattr(learning, "predict_all", lambda df, names, seed=0: tuple(names))
    monkeypatch.setattr(learning, "permutation_importance", lambda df, model, features, seed=0: list(features))
    monkeypatch.setattr(tests_of_groups, "permutation", lambda arrays, first, second, rounds=10_000, seed=0: rounds)
    assert QUERIES["predict_all"](spark, SF) == learning.CLASSIFIERS
    assert QUERIES["permutation_importance"](spark, SF) == list(range(64))
    assert QUERIES["permutation_test"](spark, SF) == 10_000
    steps, apply = [], plans.apply
    monkeypatch.setattr(plans, "apply", lambda df, own: steps.extend(own) or apply(df, own))
    for name in ("smooth_eemd", "smooth_ceemdan"):
        QUERIES[name](spark, SF)
    assert [s.params.get("trials", 20) for s in steps] == [20, 20]
