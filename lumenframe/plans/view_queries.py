"""Queries of views: axes, peaks, shapes by kernels, reports of classes, and what models say of themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A
from lumenframe.functions import labels as L
from lumenframe.functions import views as V
from lumenframe.kernels import peaks, signal
from lumenframe.operators import explain, guessing, learning, relational, search, statistics, tests_of_groups
from lumenframe.plans.pipeline import Step, apply, spread, with_baselines
from lumenframe.plans.queries import W, features, learnt, points, query, r6
from lumenframe.schema import spectra, table, to_points
from lumenframe.scratch import scratch_path
from lumenframe.sources import project

_TOP = "(SELECT *, arg_max(i, (y, -i)) OVER (PARTITION BY key) AS t, max(y) OVER (PARTITION BY key) AS h, count(*) OVER (PARTITION BY key) AS n FROM pts)"


def top_of(y: Column) -> Column:
    return (F.array_position(y, F.array_max(y)) - 1).cast("int")


def by_kernel(df: DataFrame, f: Callable, out: str, kind: str) -> DataFrame:
    """key and f(x, y) of each spectrum that has points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [f(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(b["x"], b["y"], strict=True)]
            yield pd.DataFrame({"key": b["key"], out: pd.Series(got, dtype=object if kind.startswith("array") else None)})

    whole = df.select("key", "x", "y").where("x is not null and y is not null and size(y) > 0")
    return spread(whole).mapInPandas(run, f"key long, {out} {kind}")


query("log_axes", "SELECT key, i, round(log10(x), 6) AS log_x, round(log10(y), 6) + 0.0 AS log_y FROM pts WHERE y > 0")(
    lambda s, d: to_points(spectra(s, d).withColumn("lx", V.log_axis(F.col("x"))).withColumn("ly", V.log_axis(F.col("y"))), "lx", "ly").where("ly is not null").select("key", "i", F.round("lx", 6).alias("log_x"), r6(F.col("ly"), "log_y"))
)
query("phase_map", f"SELECT key, i, round(y, 6) + 0.0 AS value, round((n - y) / (nx - x), 6) + 0.0 AS slope FROM (SELECT *, lead(y) OVER ({W}) AS n, lead(x) OVER ({W}) AS nx FROM pts) WHERE n IS NOT NULL")(
    lambda s, d: spectra(s, d).select("key", F.posexplode(V.phase_map(F.col("x"), F.col("y"))).alias("i", "p")).select("key", "i", r6(F.col("p.value"), "value"), r6(F.col("p.slope"), "slope"))
)
query("nearest_left", "SELECT key, max(i) FILTER (x <= 512) AS i FROM pts GROUP BY key")(lambda s, d: spectra(s, d).select("key", V.nearest_left(F.col("x"), 512.0).alias("i")))
query("peak_extent", f"""
SELECT key, "left", "right" + CAST("left" = "right" AS INTEGER) AS "right", left_quarter, right_quarter FROM (
  SELECT key, coalesce(max(i) FILTER (i <= t AND y <= h * 0.5::DOUBLE), 0) AS "left", CAST(coalesce(min(i) FILTER (i >= t AND y <= h * 0.5::DOUBLE), max(n) - 1) AS INTEGER) AS "right",
         coalesce(max(i) FILTER (i <= t AND y <= h * 0.75::DOUBLE), 0) AS left_quarter, CAST(coalesce(min(i) FILTER (i >= t AND y <= h * 0.75::DOUBLE), max(n) - 1) AS INTEGER) AS right_quarter
  FROM {_TOP} GROUP BY key)""")(
    lambda s, d: spectra(s, d).withColumn("t", top_of(F.col("y"))).select("key", V.peak_extent(F.col("y"), F.col("t")).alias("e")).select("key", "e.*")
)
query("position_density", "SELECT g.at, round(avg(exp(-power((o_totalprice / 1000 - g.at) / 0.5::DOUBLE, 2) / 2)) / (0.5 * sqrt(2 * pi())), 9) + 0.0 AS density FROM orders, (SELECT 10.0::DOUBLE * unnest(range(1, 31)) AS at) g GROUP BY g.at")(
    lambda s, d: V.density(table(s, d, "orders").withColumn("v", F.col("o_totalprice") / 1000), "v", [10.0 * k for k in range(1, 31)]).select("at", (F.round("density", 9) + 0.0).alias("density"))
)
query("score_histogram", "SELECT l_returnflag, CAST(floor(l_extendedprice / 5000) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY ALL")(lambda s, d: V.histogram(table(s, d, "lineitem"), "l_extendedprice", 5000.0, "l_returnflag"))
query("feature_value", "SELECT DISTINCT 300.0::DOUBLE + 20 * i AS v FROM pts")(
    lambda s, d: points(s, d).select("x").distinct().select(L.feature_value(F.concat(F.lit("k"), F.col("x").cast("string"), F.when(F.pmod("x", F.lit(40)) == 0, "_a").otherwise("_x0"))).alias("v"))
)
query("peak_list", f"SELECT key, string_agg(CAST(CAST(x AS INTEGER) AS VARCHAR), ', ' ORDER BY i) AS peaks FROM (SELECT key, i, x, y > lag(y) OVER ({W}) AND y > lead(y) OVER ({W}) AS top FROM pts) WHERE top GROUP BY key")(
    lambda s, d: spectra(s, d).select("key", F.array_join(F.transform(A.minima(F.transform("y", lambda v: -v)), lambda i: F.get("x", i).cast("int").cast("string")), ", ").alias("peaks")).where("peaks <> ''")
)
query("fft_amplitude", "WITH k AS (SELECT unnest(range(33)) AS k) SELECT key, CAST(k AS INTEGER) AS k, round(k / 1280.0::DOUBLE, 9) AS frequency, round(sqrt(power(sum(y * cos(2 * pi() * k * i / 64)), 2) + power(sum(y * sin(2 * pi() * k * i / 64)), 2)) / 64, 6) + 0.0 AS amplitude FROM pts, k GROUP BY key, k")(
    lambda s, d: by_kernel(spectra(s, d), lambda x, y: np.stack(signal.amplitudes(x, y), axis=1).tolist(), "f", "array<array<double>>").select("key", F.posexplode("f").alias("k", "f")).select("key", "k", F.round(F.get("f", F.lit(0)), 9).alias("frequency"), r6(F.get("f", F.lit(1)), "amplitude"))
)
query("find_peaks", f"SELECT key, i FROM (SELECT key, i, y, y > lag(y) OVER ({W}) AND y > lead(y) OVER ({W}) AS top FROM pts) WHERE top AND y >= 0.1")(
    lambda s, d: by_kernel(spectra(s, d), lambda x, y: signal.find_peaks(y, height=(0.1, np.inf)).tolist(), "at", "array<int>").select("key", F.explode("at").alias("i"))
)
query("wide_peaks")(lambda s, d: by_kernel(spectra(s, d), lambda x, y: signal.find_peaks(y, distance=4, width=(1.0, 12.0)).tolist(), "at", "array<int>").select("key", F.explode("at").alias("i")))
query("laser_fwhm")(lambda s, d: by_kernel(spectra(s, d), lambda x, y: peaks.laser_fwhm(x, y, int(np.argmax(y)), 200.0), "fwhm", "double"))
query("convert_snr")(lambda s, d: apply(spectra(s, d), [Step("convert", params={"laser": 310.0})]).select("key", F.get("x", F.lit(0)).alias("first_cm"), F.round(A.snr(F.col("y")), 2).alias("snr")))

#: The shapes that need special functions, at one set of parameters each.
_KERNEL_SHAPES = {"Skewed Gaussian": (0.8,), "Voigt": (15.0,), "Split Voigt": (60.0, 15.0), "Skewed Voigt": (15.0, 0.5), "Pearson4": (1.5, 0.4), "Split Pearson4": (60.0, 1.5, 0.4)}
for _name, _extra in _KERNEL_SHAPES.items():
    query(f"shape_{_name.lower().replace(' ', '_')}")(
        lambda s, d, n=_name, e=_extra: by_kernel(spectra(s, d), lambda x, y, n=n, e=e: peaks.SHAPES[n].f(x, 2.0, 900.0, 40.0, *e).tolist(), "v", "array<double>").select("key", F.posexplode("v").alias("i", "v"))
    )

_SAID = "(SELECT quality AS label, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS said, doc_id FROM labels)"


def said(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("predicted"))


query("misclassified", f"SELECT doc_id, label, said AS predicted FROM {_SAID} WHERE label <> said")(lambda s, d: statistics.misclassified(said(s, d)))
query("class_report", f"""
SELECT c.label, round(coalesce(tp / nullif(said, 0), 0), 6) AS "precision", round(tp / n, 6) AS recall, round(coalesce(2 * tp / nullif(said + n, 0), 0), 6) AS f1, n AS support
FROM (SELECT label, count(*) AS n, CAST(count(*) FILTER (label = said) AS DOUBLE) AS tp FROM {_SAID} GROUP BY label) c
LEFT JOIN (SELECT said AS label, count(*) AS said FROM {_SAID} GROUP BY said) p USING (label)""")(
    lambda s, d: statistics.class_report(said(s, d)).select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")
)


@query("grid_search")
def grid_search(spark, sf_dir):
    return learning.search_table(spark, learnt(spark, sf_dir), "Decision Tree", {"maxDepth": (2, 5)})


@query("feature_importances")
def feature_importances(spark, sf_dir):
    data = learnt(spark, sf_dir)
    return explain.importances(spark, learning.estimator("Random Forest").fit(data))


@query("coefficient_effects")
def coefficient_effects(spark, sf_dir):
    data = learnt(spark, sf_dir)
    return explain.mean_effects(data, learning.discriminant(data))


@query("tree_text")
def tree_text(spark, sf_dir):
    return explain.tree_lines(spark, learning.estimator("Decision Tree").fit(learnt(spark, sf_dir)))


@query("production_predict")
def production_predict(spark, sf_dir):
    """New spectra go through the frozen steps and axis of training, then to its model."""
    steps = [Step("cut", params={"start": 340.0, "end": 1500.0}), Step("smooth", "Savitzky-Golay filter", {"window": 5, "order": 2}), Step("normalize", "SNV")]
    ready = apply(spectra(spark, sf_dir), steps)
    model = learning.discriminant(learning.dataset(ready.where("key % 5 <> 0")))
    return learning.apply_discriminant(learning.dataset(ready.where("key % 5 = 0")), model).select("key", "label", "prediction")


query("next_free_index", "WITH t AS (SELECT p_partkey + p_size AS i FROM part), n AS (SELECT count(*) AS n FROM t) SELECT min(c) AS i FROM (SELECT n AS c FROM n UNION ALL SELECT i + 1 FROM t, n WHERE i >= n), n WHERE c NOT IN (SELECT i FROM t)")(
    lambda s, d: relational.next_free_index(table(s, d, "part").select((F.col("p_partkey") + F.col("p_size")).alias("i")), "i")
)
query("label_encode", "SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS code FROM customer")(
    lambda s, d: relational.encoded(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code")
)
query("title_text", "SELECT r_regionkey, r_name || ' (key: ' || r_regionkey || ', rows: ' || length(r_name) || ')' AS title FROM region")(
    lambda s, d: table(s, d, "region").select("r_regionkey", L.title_text(F.col("r_name"), F.create_map(F.lit("rows"), F.length("r_name").cast("string"), F.lit("key"), F.col("r_regionkey").cast("string"))).alias("title"))
)
query("adaptive_search")(lambda s, d: search.adaptive(s, learnt(s, d), "LDA"))
for _name in ("Logistic regression", "SVC", "Decision Tree", "Random Forest", "XGBoost"):
    query(f"search_{_name.lower().replace(' ', '_')}")(lambda s, d, n=_name: search.adaptive(s, learnt(s, d), n))
query("compare_groups")(lambda s, d: tests_of_groups.compare(spectra(s, d), features(s, d), 1, 2))

#: Lines that are there already, and an interval without lines, for the guesses of the test spectra.
KNOWN, FORBIDDEN = (guessing.Known(0.2, 500.0, 40.0), guessing.Known(0.2, 1000.0, 40.0)), ((640.0, 760.0),)
query("guess_dead_zones")(lambda s, d: guessing.guess(spectra(s, d), [800.0, 1200.0], fwhm=80.0, known=KNOWN, forbidden=FORBIDDEN))
query("clustered_lines")(lambda s, d: guessing.clustered(guessing.guess(spectra(s, d), [800.0, 1200.0], fwhm=80.0), 80.0))
for _name in guessing.SCOPES:
    #: The mean of all test spectra is nearly flat: its lines are lower than the usual noise.
    query(f"guess_scope_{_name.lower().replace(' ', '_')}")(lambda s, d, n=_name: guessing.template(spectra(s, d), n, fwhm=80.0, borders=[800.0, 1200.0], noise=0.002 if n == "Average" else None))
query("fit_scope_template")(lambda s, d: guessing.fit_template(spectra(s, d), guessing.template(spectra(s, d), "Average groups", fwhm=80.0, borders=[800.0, 1200.0]), fwhm=80.0))

#: Three classes of order lines, a made-up score for each, and made-up predictions.
_CELLS = "SELECT c AS curve, l_returnflag = c AS hit, CASE c WHEN 'A' THEN l_quantity * 2 WHEN 'N' THEN l_discount * 1000 ELSE 100 - l_quantity + l_tax * 100 END AS score FROM lineitem, (VALUES ('A'), ('N'), ('R')) k(c)"


def roc_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("curve", F.explode(F.array(*map(F.lit, "ANR"))))
    score = F.when(F.col("curve") == "A", F.col("l_quantity") * 2).when(F.col("curve") == "N", F.col("l_discount") * 1000).otherwise(100 - F.col("l_quantity") + F.col("l_tax") * 100)
    return rows.select("curve", (F.col("l_returnflag") == F.col("curve")).alias("hit"), score.alias("score"))


@query("roc_averages", f"""
WITH cells AS ({_CELLS}), named AS (SELECT * FROM cells UNION ALL SELECT 'micro', hit, score FROM cells),
c AS (SELECT curve, score, CAST(count(*) FILTER (hit) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT hit) AS DOUBLE) AS n FROM named GROUP BY curve, score),
t AS (SELECT curve, sum(n) OVER w / sum(n) OVER (PARTITION BY curve) AS fpr, sum(p) OVER w / sum(p) OVER (PARTITION BY curve) AS tpr FROM c WINDOW w AS (PARTITION BY curve ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
dots AS (SELECT fpr, max(tpr) AS high, min(tpr) AS low, curve FROM (SELECT curve, fpr, tpr FROM t UNION ALL SELECT DISTINCT curve, 0.0, 0.0 FROM c) GROUP BY curve, fpr),
g AS (SELECT curve, place, place / 999.0::DOUBLE AS x FROM (SELECT DISTINCT curve FROM c), (SELECT unnest(range(1000)) AS place)),
l AS (SELECT g.curve, place, x, max(fpr) AS lf FROM g JOIN dots ON dots.curve = g.curve AND dots.fpr <= g.x GROUP BY g.curve, place, x),
r AS (SELECT g.curve, place, min(fpr) AS rf FROM g JOIN dots ON dots.curve = g.curve AND dots.fpr > g.x GROUP BY g.curve, place),
e AS (SELECT l.curve, l.place, x, a.high + coalesce((b.low - a.high) * (x - lf) / (rf - lf), 0) AS tpr FROM l JOIN dots a ON a.curve = l.curve AND a.fpr = lf LEFT JOIN r ON r.curve = l.curve AND r.place = l.place LEFT JOIN dots b ON b.curve = l.curve AND b.fpr = rf),
f AS (SELECT curve, place, x, tpr FROM e UNION ALL SELECT 'macro', place, x, avg(tpr) FROM e WHERE curve <> 'micro' GROUP BY place, x)
SELECT curve, CAST(place AS INTEGER) AS place, round(x, 6) AS fpr, round(tpr, 6) AS tpr FROM f""")
def roc_averages(spark, sf_dir):
    got = statistics.roc_averages(roc_cells(spark, sf_dir), F.col("hit"), "score", "curve")
    return got.select("curve", "place", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


query("micro_f1", "SELECT l_linenumber, round(avg(CASE WHEN l_returnflag = CASE WHEN l_quantity < 20 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END THEN 1.0 ELSE 0.0 END), 6) AS f1 FROM lineitem GROUP BY l_linenumber")(
    lambda s, d: statistics.micro_f1(
        table(s, d, "lineitem").select("l_linenumber", F.col("l_returnflag").alias("label"), F.when(F.col("l_quantity") < 20, "A").when(F.col("l_quantity") < 35, "N").otherwise("R").alias("prediction")), "l_linenumber"
    ).select("l_linenumber", F.round("f1", 6).alias("f1"))
)


@query("production_replay")
def production_replay(spark, sf_dir):
    """A project with two models is saved from the spectra whose key is no multiple of 5, loaded again, and predicts the others."""
    steps = [Step("interpolate", params={"axis": [340.0 + 10 * k for k in range(100)]}), Step("smooth", "Whittaker", {"lam": 2.0}), Step("normalize", "SNV")]
    known = spectra(spark, sf_dir).where("key % 5 <> 0")
    ready = learning.dataset(apply(known, steps)).persist()
    models = {"LDA": learning.discriminant(ready), "Random Forest": learning.estimator("Random Forest").fit(ready)}
    ready.unpersist()
    path = scratch_path(spark, "production")
    project.save_production(spark, path, project.Production(steps, models))
    return project.load_production(spark, path).predict(spectra(spark, sf_dir).where("key % 5 = 0"))


query("value_at_keys", "SELECT o_orderkey AS l_orderkey, 7 AS l_linenumber, coalesce(l_quantity, -1.0) AS l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 7")(
    lambda s, d: relational.at_keys(table(s, d, "lineitem"), table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(7).alias("l_linenumber")), ["l_orderkey", "l_linenumber"], "l_quantity", -1.0)
)
query("renumbered_lines", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) - 1 AS INTEGER) AS new_l_linenumber FROM lineitem")(
    lambda s, d: relational.renumbered(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", "l_linenumber", ["l_orderkey"]).drop("l_extendedprice")
)
_ASSEMBLED = "SELECT vec_id AS key, label, r_name AS target, i - {less} AS feature, round(CAST(v AS DOUBLE), 6) AS value FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) LEFT JOIN region ON r_regionkey = label"


def assembled(spark, sf_dir, source: str):
    """The embeddings as smoothed spectra and as decomposed ones, named by region."""
    one = spectra(spark, sf_dir)
    sources = {"Smoothed": one, "Decomposed": one.select("key", "grp", F.col("y").alias("features"))}
    groups = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("grp"), F.col("r_name").alias("name"))
    out = learning.assembled(sources, source, groups, ignored=[0, 1])
    return out.select("key", "label", "target", F.posexplode("features").alias("feature", "v")).select("key", "label", "target", "feature", F.round("v", 6).alias("value"))


query("assembled_smoothed", _ASSEMBLED.format(less="0"))(lambda s, d: assembled(s, d, "Smoothed"))
query("assembled_decomposed", _ASSEMBLED.format(less="2") + " WHERE i > 1")(lambda s, d: assembled(s, d, "Decomposed"))


def long_baselines(spark, sf_dir, name):
    """Baselines of the spectra drawn on 1000 places, a length for which times of baselines can be compared."""
    drawn = with_baselines(spectra(spark, sf_dir).where("size(y) > 1"), name, np.linspace(300.0, 1560.0, 1000))
    return drawn.select("key", "grp", "baseline")


for _name, _short in (("ExModPoly", "exmodpoly"), ("Quantile regression", "quantile_regression"), ("iModPoly", "imodpoly")):
    query(f"long_{_short}")(lambda s, d, n=_name: long_baselines(s, d, n))
