"""Saved projects replayed on streams, runs that are cancelled, and workbooks read back."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.kernels import peaks
from lumenframe.operators import boosting, guessing, learning, svc
from lumenframe.operators.progress import Cancelled, Run
from lumenframe.plans.pipeline import Step, apply
from lumenframe.schema import SPECTRA
from lumenframe.sources import project, workbook
from lumenframe.streaming import scoring

X = np.linspace(0, 200, 101)


def spectra(spark, first: int, n: int):
    rng = np.random.default_rng(first)
    rows = []
    for i in range(first, first + n):
        c = i % 3
        y = sum(peaks.gaussian(X, a, x0, 10) for a, x0 in ((3 + 2 * c, 60), (6 - 2 * c, 140))) + rng.normal(0, 0.05, len(X)) + 1
        rows.append((i, c, X.tolist(), y.tolist()))
    return spark.createDataFrame(rows, SPECTRA)


@pytest.mark.parametrize("decomposed", [False, True])
def test_a_stream_of_spectra_equals_the_batch(spark, tmp_path, decomposed):
    known = spectra(spark, 0, 60)
    axis = np.linspace(10, 190, 61).tolist()
    reference = np.mean([np.interp(axis, X, r.y) for r in known.collect()], axis=0).tolist()
    steps = [Step("interpolate", params={"axis": axis}), Step("normalize", "EMSC", {"reference": reference, "n_pca": 2})]
    lines = guessing.template(apply(known, steps), "Average", fwhm=20) if decomposed else None
    half = project.Production(steps, {}, lines, fwhm=20)
    train = half.features(known).withColumn("weight", F.lit(1.0)).persist()
    models = {"LDA": learning.discriminant(train), "XGBoost": boosting.SoftmaxBoosting(boosting.Settings(rounds=2, max_depth=2)).fit(train), "SVC": svc.PairwiseSvc().fit(train), "Decision Tree": learning.estimator("Decision Tree").fit(train)}
    project.save_production(spark, f"{tmp_path}/project", project.Production(steps, models, lines, fwhm=20))
    again = project.load_production(spark, f"{tmp_path}/project")
    assert again.steps == steps and set(again.models) == set(models) and (again.lines is None) == (not decomposed)
    new = spectra(spark, 100, 30)
    new.where("key < 115").write.parquet(f"{tmp_path}/in")
    told = lambda: scoring.replay_stream(spark, f"{tmp_path}/project", f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert told()
    new.where("key >= 115").write.mode("append").parquet(f"{tmp_path}/in")
    assert told() and told()
    rows = lambda df: sorted((r.key, r.model, r.prediction, tuple(round(p, 9) for p in r.probability)) for r in df.collect())
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert got == rows(again.predict(new)) == rows(project.Production(steps, models, lines, fwhm=20).predict(new)) and len(got) == 30 * 4
    right = sum(p == k % 3 for k, _, p, _ in got) / len(got)
    assert right > 0.4


def test_a_run_is_watched_and_cancelled_and_the_next_query_runs(spark):
    slow = lambda: spark.range(0, 400, 1, 40).select(F.udf(lambda i: time.sleep(0.2) or i, "long")("id").alias("i")).agg(F.sum("i")).first()[0]
    run = Run(spark, slow, "slow")
    until = time.monotonic() + 60
    while run.progress().active == 0 and time.monotonic() < until:
        time.sleep(0.1)
    seen = run.progress()
    assert seen.jobs >= 1 and seen.tasks >= 40 and seen.active > 0 and 0 <= seen.share < 1 and not run.ended
    with pytest.raises(TimeoutError):
        run.result(0.01)
    other = Run(spark, lambda: spark.range(100).agg(F.sum("id")).first()[0], "other")
    began = time.monotonic()
    assert run.cancel() and time.monotonic() - began < 15
    with pytest.raises(Cancelled):
        run.result()
    assert other.result(60) == 4950 and spark.range(10).count() == 10


def test_a_fit_of_many_jobs_is_cancelled_between_them(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, [0.0] * 4, rng.normal(i % 3, 1, 4).tolist()) for i in range(90)]
    df = learning.dataset(spark.createDataFrame(rows, SPECTRA))
    run = Run(spark, lambda: boosting.SoftmaxBoosting(boosting.Settings(rounds=500, max_depth=3)).fit(df), "fit")
    until = time.monotonic() + 120
    while run.progress().jobs < 4 and time.monotonic() < until:
        time.sleep(0.2)
    assert not run.ended and run.cancel()
    with pytest.raises(Cancelled):
        run.result()
    assert df.count() == 90


def test_errors_of_a_run_are_its_own(spark):
    def fails():
        raise KeyError("x")

    with pytest.raises(KeyError):
        Run(spark, fails).result(30)


def test_a_workbook_is_read_back_sheet_by_sheet(spark, tmp_path):
    odd = spark.createDataFrame([(1, "a<b>&\"c\" é🙂", [1.5, 2.0], True, 0.1), (2, None, None, None, float("nan")), (-(2**40), " spaces \x01\n", [], False, float("inf"))], "i long, `t:e` string, y array<double>, b boolean, d double")
    many = spark.range(0, 25, 1, 4).select("id", (F.col("id") * 2).alias("double"))
    tables = {"odd/name*of more than thirty-one characters": odd.coalesce(1), "none": odd.where("false"), "many": many}
    sheets = workbook.write(f"{tmp_path}/book.xlsx", tables, rows_of_sheet=11)
    assert sheets == ["odd_name_of more than thirty-on", "many", "many (2)", "many (3)"] and all(len(n) <= 31 for n in sheets)
    got = dict(workbook.read(f"{tmp_path}/book.xlsx"))
    assert list(got) == sheets
    assert got[sheets[0]] == [["i", "t:e", "y", "b", "d"], [1.0, "a<b>&\"c\" é🙂", "[1.5,2.0]", True, 0.1], [2.0, None, None, None, None], [-float(2**40), " spaces \n", "[]", False, None]]
    rows = [r for n in sheets[1:] for r in got[n][1:]]
    assert rows == [[float(i), float(2 * i)] for i in range(25)] and all(got[n][0] == ["id", "double"] and len(got[n]) <= 11 for n in sheets[1:])
    assert workbook.write(f"{tmp_path}/none.xlsx", {"none": odd.where("false")}) == [] and list(workbook.read(f"{tmp_path}/none.xlsx")) == [("empty", [])]
