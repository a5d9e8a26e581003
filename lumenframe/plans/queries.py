"""Queries over the test tables, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A
from lumenframe.functions import labels as L
from lumenframe.functions import shapes as S
from lumenframe.kernels import baseline as _baseline
from lumenframe.kernels import optimizers as _optimizers
from lumenframe.kernels import smooth as _smooth
from lumenframe.operators import aggregates, decompose, explain, learning, relational, statistics, tests_of_groups
from lumenframe.plans.pipeline import Step, apply, with_baselines
from lumenframe.schema import spectra, table, to_points
from lumenframe.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The spectra in DuckDB: arrays, and points.
ARR = "(SELECT vec_id AS key, label AS grp, [CAST(v AS DOUBLE) FOR v IN embedding] AS y, [300.0::DOUBLE + 20.0::DOUBLE * i FOR i IN range(len(embedding))] AS x FROM embeddings)"
PTS = "(SELECT vec_id AS key, label AS grp, CAST(unnest(range(len(embedding))) AS INTEGER) AS i, 300.0::DOUBLE + 20.0::DOUBLE * unnest(range(len(embedding))) AS x, CAST(unnest(embedding) AS DOUBLE) AS y FROM embeddings)"
W = "PARTITION BY key ORDER BY i"
FEATURES = "(SELECT i AS feature, grp, y AS value, key FROM pts)"


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.replace("arr", ARR).replace("pts", PTS) if "embeddings" not in sql else sql
        return f

    return keep


def r6(c, name: str):
    """Sums differ in the last bits between engines; six decimals don't."""
    return (F.round(c, 6) + 0.0).alias(name)


def row_local(name: str, build: Callable, sql: str) -> None:
    """A query that maps y to an array of the same length, as points."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = spectra(spark, sf_dir).withColumn("v", build(F.col("x"), F.col("y")))
        return out.select("key", F.posexplode("v").alias("i", "v")).select("key", "i", r6(F.col("v"), "v"))

    query(name, f"SELECT key, i, round({sql}, 6) + 0.0 AS v FROM pts")(run)


row_local("norm_snv", lambda x, y: A.snv(y), "(y - avg(y) OVER (PARTITION BY key)) / stddev_pop(y) OVER (PARTITION BY key)")
row_local("norm_l2", lambda x, y: A.l2_norm(y), "y / sqrt(sum(y * y) OVER (PARTITION BY key))")
row_local("norm_max", lambda x, y: A.max_norm(y), "y / max(y) OVER (PARTITION BY key)")
row_local("norm_minmax", lambda x, y: A.min_max(y), "(y - min(y) OVER (PARTITION BY key)) / (max(y) OVER (PARTITION BY key) - min(y) OVER (PARTITION BY key))")
row_local("diff", lambda x, y: A.diff(y), f"coalesce(y - lag(y) OVER ({W}), 0)")
row_local("gradient", lambda x, y: A.gradient(y), f"CASE WHEN lag(y) OVER ({W}) IS NULL THEN lead(y) OVER ({W}) - y WHEN lead(y) OVER ({W}) IS NULL THEN y - lag(y) OVER ({W}) ELSE (lead(y) OVER ({W}) - lag(y) OVER ({W})) / 2 END")
row_local("derivative", lambda x, y: A.derivative(x, y), f"coalesce((lead(y) OVER ({W}) - y) / (lead(x) OVER ({W}) - x), (y - lag(y) OVER ({W})) / (x - lag(x) OVER ({W})))")
row_local("moving_average", lambda x, y: A.moving_average(y, 3), f"avg(y) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
row_local("window_flat", lambda x, y: A.flat_window(y, 5), f"sum(y) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5")
row_local("erosion", lambda x, y: A.erode(y, 4), f"min(y) OVER ({W} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)")
row_local("median_filter", lambda x, y: A.median_filter(y, 3), f"list_sort([coalesce(lag(y) OVER ({W}), 0), y, coalesce(lead(y) OVER ({W}), 0)])[2]")
row_local("detrend", lambda x, y: A.detrend(y), "y - (regr_slope(y, i) OVER (PARTITION BY key) * i + regr_intercept(y, i) OVER (PARTITION BY key))")
row_local("shape_residual", lambda x, y: F.zip_with(y, F.transform(x, lambda v: S.gaussian(v, 0.2, 700.0, 90.0) + S.lorentzian(v, 0.1, 1200.0, 60.0)), lambda a, b: a - b), "y - (0.2 * exp(-ln(2) * ((x - 700) / 90) * ((x - 700) / 90)) + 0.1 / (1 + ((x - 1200) / 60) * ((x - 1200) / 60)))")
row_local("nm_to_cm", lambda x, y: A.to_wavenumber(x, 784.79, F.lit(785.5)), "1e7 / 784.79 - 1e7 / (x + 784.79 - 785.5)")

_MEANS = f"coalesce(sum(y) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) / 5"
query("norm_trapz", "SELECT key, i, round(y / (sum(y) OVER (PARTITION BY key) - (first(y) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + last(y) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 2), 3) + 0.0 AS v FROM pts")(
    lambda s, d: spectra(s, d).select("key", F.posexplode(A.trapezoid_norm(F.col("y"))).alias("i", "v")).select("key", "i", (F.round("v", 3) + 0.0).alias("v"))
)
query("wiener", f"""
WITH s AS (SELECT key, i, y, {_MEANS} AS m, sum(y * y) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS q FROM pts),
v AS (SELECT *, q - m * m AS v, avg(q - m * m) OVER (PARTITION BY key) AS noise FROM s)
SELECT key, i, round(CASE WHEN v < noise THEN m ELSE m + (y - m) * (1 - noise / v) END, 6) + 0.0 AS v FROM v""")(
    lambda s, d: spectra(s, d).select("key", F.posexplode(A.wiener(F.col("y"), 5)).alias("i", "v")).select("key", "i", r6(F.col("v"), "v"))
)


def _neighbours(weights) -> str:
    h = len(weights) // 2
    part = lambda k, w: f"{w!r} * coalesce({'y' if k == 0 else f'lag(y, {-k}) OVER ({W})' if k < 0 else f'lead(y, {k}) OVER ({W})'}, 0)"
    return " + ".join(part(k - h, float(w)) for k, w in enumerate(weights))


for _kind in A.WINDOWS:
    _w = A.WINDOWS[_kind](7, 8.0) if _kind == "kaiser" else A.WINDOWS[_kind](7)
    row_local(f"window_{_kind}", lambda x, y, k=_kind: A.window_smooth(y, k, 7), _neighbours(_w / _w.sum()))

_SG = A.savgol_rows(5, 2)


def _savgol_sql() -> str:
    n = 64
    edge = lambda rows, first: "CASE i " + " ".join(f"WHEN {first + k} THEN " + " + ".join(f"{float(w)!r} * y{first_y + j}" for j, w in enumerate(_SG[r])) for k, (r, first_y) in enumerate(rows)) + " END"
    cols = ", ".join(f"max(CASE WHEN i = {j} THEN y END) OVER (PARTITION BY key) AS y{j}" for j in (*range(5), *range(n - 5, n)))
    return f"SELECT key, i, round(CASE WHEN i < 2 THEN {edge([(0, 0), (1, 0)], 0)} WHEN i >= {n - 2} THEN {edge([(3, n - 5), (4, n - 5)], n - 2)} ELSE m END, 6) + 0.0 AS v FROM (SELECT key, i, {cols}, {_neighbours(_SG[2])} AS m FROM pts)"


query("savgol_5_2", _savgol_sql())(lambda s, d: spectra(s, d).select("key", F.posexplode(A.savgol(F.col("y"), 5, 2)).alias("i", "v")).select("key", "i", r6(F.col("v"), "v")))

query("trapz_area", f"SELECT key, round(sum(coalesce((y + py) / 2 * (x - px), 0)), 6) + 0.0 AS area FROM (SELECT key, x, y, lag(y) OVER ({W}) AS py, lag(x) OVER ({W}) AS px FROM pts) GROUP BY key")(
    lambda s, d: spectra(s, d).select("key", r6(A.trapezoid(F.col("x"), F.col("y")), "area"))
)
query("nearest_index", "SELECT key, arg_min(i, (abs(x - 777.0), i)) AS i FROM pts GROUP BY key")(lambda s, d: spectra(s, d).select("key", A.nearest(F.col("x"), 777.0).alias("i")))
query("nearest_peak_value", "SELECT key, arg_min(i, (abs(y - 0.1), i)) AS i FROM pts GROUP BY key")(lambda s, d: spectra(s, d).select("key", A.nearest(F.col("y"), 0.1).alias("i")))


@query("cut_range", "SELECT key, i - s AS i, x, y FROM (SELECT *, arg_min(i, (abs(x - 512.0), i)) OVER (PARTITION BY key) AS s, arg_min(i, (abs(x - 988.0), i)) OVER (PARTITION BY key) AS e FROM pts) WHERE i BETWEEN s AND e")
def cut_range(spark, sf_dir):
    s, e = A.nearest(F.col("x"), 512.0), A.nearest(F.col("x"), 988.0)
    got = spectra(spark, sf_dir).select("key", "grp", A.cut(F.col("x"), s, e).alias("x"), A.cut(F.col("y"), s, e).alias("y"))
    return to_points(got).select("key", "i", "x", "y")


@query("local_minima", f"SELECT key, i FROM (SELECT key, i, y < lag(y) OVER ({W}) AND y < lead(y) OVER ({W}) AS low FROM pts) WHERE low")
def local_minima(spark, sf_dir):
    return spectra(spark, sf_dir).select("key", F.explode(A.minima(F.col("y"))).alias("i"))


@query("local_minima_order6", f"SELECT key, i FROM (SELECT key, i, y, min(y) OVER ({W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS a, min(y) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS b, max(i) OVER (PARTITION BY key) AS n FROM pts) WHERE y < a AND y < b AND i > 0 AND i < n AND i + 6 <= n + 5")
def local_minima_order6(spark, sf_dir):
    return spectra(spark, sf_dir).select("key", F.explode(A.minima(F.col("y"), 6)).alias("i"))


@query("trim_minima", f"SELECT key, min(i) AS first_min, max(i) AS last_min FROM (SELECT key, i, y < lag(y) OVER ({W}) AND y < lead(y) OVER ({W}) AS low FROM pts) WHERE low GROUP BY key")
def trim_minima(spark, sf_dir):
    m = A.minima(F.col("y"))
    return spectra(spark, sf_dir).select("key", F.array_min(m).alias("first_min"), F.array_max(m).alias("last_min")).where("first_min is not null")


@query("mask_dilation", f"SELECT key, i, max(CASE WHEN y > 0.2 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS m FROM pts")
def mask_dilation(spark, sf_dir):
    return spectra(spark, sf_dir).select("key", F.posexplode(A.dilate(F.transform("y", lambda v: v > 0.2), 3)).alias("i", "m"))


@query("mask_dilation_left", f"SELECT key, i, max(CASE WHEN y > 0.2 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 1 AS m FROM pts")
def mask_dilation_left(spark, sf_dir):
    return spectra(spark, sf_dir).select("key", F.posexplode(A.dilate_left(F.transform("y", lambda v: v > 0.2), 3)).alias("i", "m"))


@query("opening_tophat", f"SELECT key, i, round(y - max(e) OVER ({W} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) + 0.0 AS v FROM (SELECT key, i, y, min(y) OVER ({W} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS e FROM pts)")
def opening_tophat(spark, sf_dir):
    got = spectra(spark, sf_dir).withColumn("b", A.opening(F.col("y"), 4))
    return to_points(got, "y", "b").select("key", "i", r6(F.col("y") - F.col("b"), "v"))


@query("baseline_poly1", "SELECT key, i, round(regr_slope(y, i) OVER (PARTITION BY key) * i + regr_intercept(y, i) OVER (PARTITION BY key), 6) + 0.0 AS b FROM pts")
def baseline_poly1(spark, sf_dir):
    fit = spectra(spark, sf_dir).withColumn("f", A.line_fit(F.col("y")))
    return fit.select("key", F.explode(A.places(F.col("y"))).alias("i"), "f").select("key", "i", r6(F.col("f.slope") * F.col("i") + F.col("f.intercept"), "b"))


@query("plateau", f"WITH t AS (SELECT key, i, y = max(y) OVER (PARTITION BY key) AS top FROM pts), r AS (SELECT key, i, i - row_number() OVER ({W}) AS run FROM t WHERE top) SELECT key, CAST(floor((min(i) + max(i)) / 2.0) AS INTEGER) AS place FROM r WHERE (key, run) IN (SELECT key, min(run) FROM r GROUP BY key) GROUP BY key")
def plateau(spark, sf_dir):
    return spectra(spark, sf_dir).select("key", A.plateau(F.col("y")).alias("place"))


@query("interp_linear", """
WITH axis AS (SELECT CAST(unnest([250.0, 333.0, 415.5, 700.0, 1111.0, 1800.0]) AS DOUBLE) AS v),
b AS (SELECT key, v, max(CASE WHEN x <= v THEN x END) AS x0, min(CASE WHEN x > v THEN x END) AS x1, arg_max(y, x) FILTER (x <= v) AS y0, arg_min(y, x) FILTER (x > v) AS y1 FROM pts, axis GROUP BY key, v)
SELECT key, v AS x, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (v - x0) * (y1 - y0) / (x1 - x0) END, 6) + 0.0 AS y FROM b""")
def interp_linear(spark, sf_dir):
    axis = [250.0, 333.0, 415.5, 700.0, 1111.0, 1800.0]
    got = spectra(spark, sf_dir).select("key", F.posexplode(A.interpolate(F.col("x"), F.col("y"), axis)).alias("k", "y"))
    return got.select("key", F.get(F.array(*map(F.lit, axis)), F.col("k")).alias("x"), r6(F.col("y"), "y"))


for _how, _sql in (("subsample", "SELECT key, CAST(i // 5 AS INTEGER) AS i, round(y, 6) + 0.0 AS v FROM pts WHERE i % 5 = 0 AND i // 5 < 12"), ("mean", "SELECT key, CAST(i // 5 AS INTEGER) AS i, round(avg(y), 6) + 0.0 AS v FROM pts WHERE i // 5 < 12 GROUP BY ALL"), ("peak", "SELECT key, CAST(2 * (i // 5) AS INTEGER) AS i, round(max(y), 6) + 0.0 AS v FROM pts WHERE i // 5 < 12 GROUP BY key, i // 5 UNION ALL SELECT key, CAST(2 * (i // 5) + 1 AS INTEGER), round(min(y), 6) + 0.0 FROM pts WHERE i // 5 < 12 GROUP BY key, i // 5")):
    query(f"downsample_{_how}", _sql)(lambda s, d, how=_how: spectra(s, d).select("key", F.posexplode(A.down_sample(F.col("y"), 5, how)).alias("i", "v")).select("key", "i", r6(F.col("v"), "v")))

for _name, _build, _expr in (
    ("gaussian", lambda v: S.gaussian(v, 2.0, 900.0, 40.0), "2 * exp(-ln(2) * ((x - 900) / 40) * ((x - 900) / 40))"),
    ("split_gaussian", lambda v: S.split_gaussian(v, 2.0, 900.0, 40.0, 70.0), "2 * exp(-ln(2) * pow((x - 900) / (CASE WHEN x < 900 THEN 70 ELSE 40 END), 2))"),
    ("lorentzian", lambda v: S.lorentzian(v, 2.0, 900.0, 40.0), "2 / (1 + pow((x - 900) / 40, 2))"),
    ("split_lorentzian", lambda v: S.split_lorentzian(v, 2.0, 900.0, 40.0, 70.0), "2 / (1 + pow((x - 900) / (CASE WHEN x < 900 THEN 70 ELSE 40 END), 2))"),
    ("pseudo_voigt", lambda v: S.pseudo_voigt(v, 2.0, 900.0, 40.0, 0.3), "0.3 * 2 / (1 + pow((x - 900) / 40, 2)) + 0.7 * 2 * exp(-ln(2) * pow((x - 900) / 40, 2))"),
    ("split_pseudo_voigt", lambda v: S.split_pseudo_voigt(v, 2.0, 900.0, 40.0, 70.0, 0.3), "0.3 * 2 / (1 + pow((x - 900) / (CASE WHEN x < 900 THEN 70 ELSE 40 END), 2)) + 0.7 * 2 * exp(-ln(2) * pow((x - 900) / (CASE WHEN x < 900 THEN 70 ELSE 40 END), 2))"),
    ("pearson7", lambda v: S.pearson7(v, 2.0, 900.0, 40.0, 1.7), "2 * pow(1 + pow((x - 900) / 40, 2) * (pow(2, 1 / 1.7::DOUBLE) - 1), -1.7::DOUBLE)"),
    ("split_pearson7", lambda v: S.split_pearson7(v, 2.0, 900.0, 40.0, 70.0, 1.7), "2 * pow(1 + pow((x - 900) / (CASE WHEN x < 900 THEN 70 ELSE 40 END), 2) * (pow(2, 1 / 1.7::DOUBLE) - 1), -1.7::DOUBLE)"),
):
    row_local(f"shape_{_name}", lambda x, y, b=_build: F.transform(x, b), _expr)


# -- across spectra


def points(spark, sf_dir):
    return to_points(spectra(spark, sf_dir))


def features(spark, sf_dir):
    return points(spark, sf_dir).select(F.col("i").alias("feature"), "grp", F.col("y").alias("value"), "key")


query("avg_group_mean", "SELECT grp, i, min(x) AS x, round(avg(y), 6) + 0.0 AS y FROM pts GROUP BY grp, i")(lambda s, d: aggregates.group_average(points(s, d)).withColumn("y", r6(F.col("y"), "y")))
query("avg_group_median", "SELECT grp, i, min(x) AS x, round(median(y), 6) + 0.0 AS y FROM pts GROUP BY grp, i")(lambda s, d: aggregates.group_average(points(s, d), "Median").withColumn("y", r6(F.col("y"), "y")))
query("avg_overall", "SELECT i, min(x) AS x, round(avg(y), 6) + 0.0 AS y FROM pts GROUP BY i")(lambda s, d: aggregates.group_average(points(s, d), by=()).withColumn("y", r6(F.col("y"), "y")))
for _kind, _lo, _hi in (("se", "avg(y) - 2 * stddev_samp(y) / sqrt(count(y))", "avg(y) + 2 * stddev_samp(y) / sqrt(count(y))"), ("sd", "avg(y) - 2 * stddev_samp(y)", "avg(y) + 2 * stddev_samp(y)"), ("pi", "quantile_cont(y, 0.49)", "quantile_cont(y, 0.51)")):
    query(f"error_band_{_kind}", f"SELECT grp, i, round(avg(y), 6) + 0.0 AS mean, round({_lo}, 6) + 0.0 AS low, round({_hi}, 6) + 0.0 AS high FROM pts GROUP BY grp, i")(lambda s, d, k=_kind: aggregates.error_band(points(s, d), k, 2).select("grp", "i", r6(F.col("mean"), "mean"), r6(F.col("low"), "low"), r6(F.col("high"), "high")))
query("error_band_ci")(lambda s, d: aggregates.bootstrap_band(points(s, d), n_boot=50))
query("range_counts", "SELECT x[1] AS first_x, x[-1] AS last_x, count(*) AS n FROM arr GROUP BY ALL")(lambda s, d: aggregates.axis_ranges(spectra(s, d)))
query("common_range", "SELECT max(x[1]) AS first_x, min(x[-1]) AS last_x FROM arr")(lambda s, d: aggregates.common_range(spectra(s, d)))
_Q = "count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std, round(min(value), 6) + 0.0 AS min, round(quantile_cont(value, 0.25), 6) + 0.0 AS q25, round(quantile_cont(value, 0.5), 6) + 0.0 AS q50, round(quantile_cont(value, 0.75), 6) + 0.0 AS q75, round(max(value), 6) + 0.0 AS max"


def _rounded(df, *keys):
    return df.select(*keys, "n", *(r6(F.col(c), c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")))


query("describe_all", f"SELECT feature, {_Q} FROM {FEATURES} GROUP BY feature")(lambda s, d: _rounded(aggregates.describe(features(s, d), "feature"), "feature"))
query("describe_by_class", f"SELECT feature, grp, {_Q} FROM {FEATURES} GROUP BY feature, grp")(lambda s, d: _rounded(aggregates.describe(features(s, d), "feature", "grp"), "feature", "grp"))
query("describe_prices", f"SELECT l_returnflag, {_Q.replace('value', 'l_extendedprice')} FROM lineitem GROUP BY l_returnflag")(lambda s, d: _rounded(aggregates.describe(table(s, d, "lineitem").withColumnRenamed("l_extendedprice", "value"), "l_returnflag"), "l_returnflag"))

_ANOVA = "WITH f AS (SELECT * FROM {src}), b AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM f GROUP BY ALL), t AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS gm, sum(n * v) AS w, sum(n * m * m) AS nmm FROM b GROUP BY feature) SELECT feature, CAST(k - 1 AS BIGINT) AS df1, CAST(n - k AS BIGINT) AS df2, round(((nmm - n * gm * gm) / (k - 1)) / (w / (n - k)), 6) + 0.0 AS f FROM t"
query("anova_f", _ANOVA.format(src=FEATURES))(lambda s, d: statistics.anova_f(features(s, d)).withColumn("f", r6(F.col("f"), "f")))
_MWU = f"WITH f AS (SELECT * FROM {FEATURES} WHERE grp IN (1, 2)), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rank FROM f), t AS (SELECT feature, sum(t * t * t - t) AS ties FROM (SELECT feature, value, count(*) AS t FROM f GROUP BY ALL) GROUP BY feature) SELECT feature, count(*) FILTER (grp = 1) AS n1, count(*) FILTER (grp = 2) AS n2, CAST(any_value(ties) AS BIGINT) AS ties, CAST(sum(rank) FILTER (grp = 1) - count(*) FILTER (grp = 1) * (count(*) FILTER (grp = 1) + 1) / 2.0 AS DOUBLE) AS u FROM r JOIN t USING (feature) GROUP BY feature"
query("mann_whitney_u", _MWU)(lambda s, d: statistics.mann_whitney_u(features(s, d), 1, 2))


@query("permutation_stat", "WITH m AS (SELECT i, avg(y) FILTER (grp = 1) AS a, avg(y) FILTER (grp = 2) AS b FROM pts GROUP BY i) SELECT round(sqrt(sum((a - b) * (a - b))), 6) AS stat FROM m")
def permutation_stat(spark, sf_dir):
    m = points(spark, sf_dir).groupBy("i").agg(F.avg(F.when(F.col("grp") == 1, F.col("y"))).alias("a"), F.avg(F.when(F.col("grp") == 2, F.col("y"))).alias("b"))
    return m.agg(F.round(F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))), 6).alias("stat"))


@query("pivot_dataset", "SELECT key, grp, " + ", ".join(f"max(CASE WHEN i = {k} THEN y END) AS k{k}" for k in range(0, 64, 8)) + " FROM pts GROUP BY key, grp")
def pivot_dataset(spark, sf_dir):
    got = relational.pivot_features(points(spark, sf_dir), range(0, 64, 8))
    return got.select("key", "grp", *(F.col(str(k)).alias(f"k{k}") for k in range(0, 64, 8)))


@query("melt_features", "SELECT l_orderkey, l_linenumber, feature, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR feature IN (l_quantity, l_discount, l_tax))")
def melt_features(spark, sf_dir):
    return relational.melt(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("top5_effects", f"SELECT grp, feature, CAST(rank AS INTEGER) AS rank FROM (SELECT grp, feature, row_number() OVER (PARTITION BY grp ORDER BY e DESC, feature) AS rank FROM (SELECT grp, feature, round(abs(avg(value)), 9) AS e FROM {FEATURES} GROUP BY ALL)) WHERE rank <= 5")
def top5_effects(spark, sf_dir):
    e = features(spark, sf_dir).groupBy("grp", "feature").agg(F.round(F.abs(F.avg("value")), 9).alias("e"))
    return relational.top(e, 5, F.desc("e"), "feature", ["grp"]).select("grp", "feature", "rank")


@query("dbscan_1d", "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice AS v, CASE WHEN o_totalprice - lag(o_totalprice) OVER w <= 5000 THEN 0 ELSE 1 END AS fresh FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY v, o_orderkey ROWS UNBOUNDED PRECEDING) - 1 AS run FROM o) SELECT o_orderkey, CAST(CASE WHEN count(*) OVER (PARTITION BY o_custkey, run) > 1 THEN run ELSE -1 END AS BIGINT) AS run FROM r")
def dbscan_1d(spark, sf_dir):
    got = statistics.clusters_on_a_line(table(spark, sf_dir, "orders"), "o_totalprice", 5000.0, "o_custkey")
    return got.select("o_orderkey", F.col("run").cast("long").alias("run"))


@query("range_join_interval", "SELECT o_orderkey, CAST(CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 120000 THEN 1 ELSE 2 END AS INTEGER) AS interval FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 400000")
def range_join_interval(spark, sf_dir):
    return relational.range_lookup(table(spark, sf_dir, "orders"), "o_totalprice", [1000, 50_000, 120_000, 400_000]).select("o_orderkey", "interval")


@query("lookup_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup_join(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return relational.lookup(table(spark, sf_dir, "customer"), relational.dimension(nation), "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("lookup_default", "SELECT c_custkey, coalesce(n_name, 'none') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey")
def lookup_default(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_regionkey = 1").withColumnRenamed("n_nationkey", "c_nationkey")
    return relational.lookup(table(spark, sf_dir, "customer"), relational.dimension(nation), "c_nationkey", "n_name", "none").select("c_custkey", "n_name")


@query("group_names", "SELECT vec_id AS key, CASE WHEN label > 4 THEN 0 ELSE label END AS grp, r_name AS name FROM embeddings LEFT JOIN region ON r_regionkey = CASE WHEN label > 4 THEN 0 ELSE label END")
def group_names(spark, sf_dir):
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("grp"), F.col("r_name").alias("name"))
    return relational.group_names(spectra(spark, sf_dir).select("key", "grp"), names, 4).select("key", "grp", "name")


@query("anti_join_delete", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_delete(spark, sf_dir):
    return relational.delete_keys(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("semi_join_keys", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join_keys(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.keep_keys(table(spark, sf_dir, "customer"), big, "c_custkey").select("c_custkey")


@query("update_cells", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN round(s_acctbal / 3, 5) ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_cells(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return relational.update(supplier, supplier.where("s_suppkey % 7 = 0").withColumn("s_acctbal", F.col("s_acctbal") / 3), ["s_suppkey"], "s_acctbal")


@query("template_cross_join", "SELECT s_suppkey, r_regionkey, r_name FROM supplier, region")
def template_cross_join(spark, sf_dir):
    return relational.from_template(table(spark, sf_dir, "supplier").select("s_suppkey"), table(spark, sf_dir, "region")).select("s_suppkey", "r_regionkey", "r_name")


@query("reindex_sorted", "SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS n FROM customer")
def reindex_sorted(spark, sf_dir):
    return relational.numbered(table(spark, sf_dir, "customer"), F.desc("c_acctbal"), "c_custkey", within=["c_nationkey"]).select("c_nationkey", "c_custkey", "n")


@query("append_sorted", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region ORDER BY id, name")
def append_sorted(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return relational.append_sorted(a, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), "id", "name")


@query("symmetric_difference", "(SELECT n_nationkey AS id FROM nation EXCEPT ALL SELECT r_regionkey FROM region) UNION ALL (SELECT r_regionkey FROM region EXCEPT ALL SELECT n_nationkey FROM nation)")
def symmetric_difference(spark, sf_dir):
    return relational.symmetric_difference(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id")))


@query("side_by_side", "SELECT key, first, last FROM (SELECT key, y[1] AS first FROM arr) JOIN (SELECT key, y[-1] AS last FROM arr) USING (key)")
def side_by_side(spark, sf_dir):
    one = spectra(spark, sf_dir)
    return relational.side_by_side(one.select("key", F.element_at("y", 1).alias("first")), one.select("key", F.element_at("y", -1).alias("last")), "key")


@query("filter_query", "SELECT p_partkey, p_brand FROM part WHERE p_size > 20 AND p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 50)")
def filter_query(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    common = part.groupBy("p_brand").count().where("count > 50").select("p_brand")
    return relational.keep_keys(part.where("p_size > 20"), common, "p_brand").select("p_partkey", "p_brand")


@query("distinct_classes", "SELECT DISTINCT label AS grp FROM embeddings WHERE label IN (SELECT r_regionkey FROM region)")
def distinct_classes(spark, sf_dir):
    return relational.keep_keys(spectra(spark, sf_dir).select("grp").distinct(), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("grp")), "grp")


@query("label_format", "SELECT DISTINCT p_size, 'k' || CAST(round(p_retailprice, 2) AS VARCHAR) AS feature, 'k' || replace(CAST(round(p_retailprice, 2) AS VARCHAR), '.', 'dot') || '_' AS legend FROM part")
def label_format(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_size", L.feature_name(F.col("p_retailprice")).alias("feature"), L.legend(F.col("p_retailprice")).alias("legend")).distinct()


@query("label_parse", "SELECT p_partkey, round(p_retailprice, 2) AS v FROM part")
def label_parse(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.legend_value(L.legend(F.col("p_retailprice"))).alias("v"))


@query("group_from_name", "SELECT s_suppkey, CAST(s_suppkey % 13 AS INTEGER) AS a, CAST(s_suppkey % 10 AS INTEGER) AS b, CAST(substr(CAST(s_suppkey AS VARCHAR), 1, 1) AS INTEGER) AS c, 0 AS d FROM supplier")
def group_from_name(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", L.group_of(F.concat((k % 13).cast("string"), F.lit("_s.txt"))).alias("a"), L.group_of(F.concat(F.lit("["), (k % 10).cast("string"), F.lit("] s.txt"))).alias("b"),
        L.group_of(F.concat(F.lit("("), k.cast("string"), F.lit(")x.asc"))).alias("c"), L.group_of(F.col("s_name")).alias("d"),
    )


@query("parameter_parts", "SELECT p_partkey, CAST(p_partkey AS INTEGER) AS line, 'x0' AS param FROM part")
def parameter_parts(spark, sf_dir):
    got = table(spark, sf_dir, "part").select("p_partkey", L.parameter_parts(F.concat(F.lit("Curve_"), F.col("p_partkey"), F.lit("_x0"))).alias("p"))
    return got.select("p_partkey", "p.line", "p.param")


@query("prediction_text", "SELECT doc_id, CAST(quality AS VARCHAR) || ' [' || CAST(100 * quality AS VARCHAR) || ' ' || CAST(100 * toxic AS VARCHAR) || ']' AS t FROM labels")
def prediction_text(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", L.prediction_text(F.col("quality").cast("string"), F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"))).alias("t"))


@query("export_text", "SELECT key, i, format('{:10.5f} {:10.5f}', x, y) AS t FROM pts")
def export_text(spark, sf_dir):
    return points(spark, sf_dir).select("key", "i", L.point_text(F.col("x"), F.col("y")).alias("t"))


@query("snr_interior", f"SELECT key, round(max(y) / stddev_pop(y - s), 2) AS snr FROM (SELECT key, y, i, {_neighbours(A.savgol_rows(9, 3)[4])} AS s FROM pts) WHERE i BETWEEN 4 AND 59 GROUP BY key")
def snr_interior(spark, sf_dir):
    inner = F.slice("y", 5, 56)
    rest = F.slice(F.zip_with("y", A.savgol(F.col("y"), 9, 3), lambda a, b: a - b), 5, 56)
    return spectra(spark, sf_dir).select("key", F.round(F.array_max(inner) / A.moments(rest)["std"], 2).alias("snr"))


query("class_weights", "SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")(lambda s, d: statistics.class_weights(table(s, d, "embeddings"), "label").select("label", "n", F.round("weight", 6).alias("weight")))
query("stratified_counts", "SELECT label, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM embeddings GROUP BY label")(lambda s, d: statistics.stratified_split(table(s, d, "embeddings"), "label", "vec_id", 20).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("long")).alias("n_test")))
query("confusion_matrix", "SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL")(lambda s, d: statistics.confusion(table(s, d, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("predicted"))))
query("roc_auc_ranksum", "WITH r AS (SELECT l_returnflag = 'R' AS p, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rank FROM lineitem) SELECT round((sum(rank) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 6) AS auc FROM r")(
    lambda s, d: statistics.roc_auc(table(s, d, "lineitem"), F.col("l_returnflag") == "R", "l_quantity").select(F.round("auc", 6).alias("auc"))
)
query("roc_points", "WITH c AS (SELECT l_quantity AS score, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1) SELECT score, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)")(
    lambda s, d: statistics.roc_points(table(s, d, "lineitem"), F.col("l_returnflag") == "R", "l_quantity").select("score", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))
)
query("precision_recall", "WITH c AS (SELECT l_quantity AS score, count(*) FILTER (l_returnflag = 'R') AS p, count(*) AS n FROM lineitem GROUP BY 1) SELECT score, round(sum(p) OVER w / sum(n) OVER w, 6) AS precision, round(sum(p) OVER w / sum(p) OVER (), 6) AS recall FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)")(
    lambda s, d: statistics.precision_recall_points(table(s, d, "lineitem"), F.col("l_returnflag") == "R", "l_quantity").select("score", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
)
query("calibration", "SELECT CAST(least(floor(l_discount * 100 / 1.1), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(l_discount * 10 / 1.1), 6) AS mean_score, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1")(
    lambda s, d: statistics.calibration(table(s, d, "lineitem").withColumn("s", F.col("l_discount") * 100 / F.lit(1.1) / 10), F.col("l_returnflag") == "R", "s").select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("share", 6).alias("share"))
)
query("binary_scores", "SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(count(*) FILTER (quality = 0 AND toxic = 0) / count(*) FILTER (toxic = 0), 6) AS precision, round(count(*) FILTER (quality = 0 AND toxic = 0) / count(*) FILTER (quality = 0), 6) AS recall, round(2 * count(*) FILTER (quality = 0 AND toxic = 0) / (count(*) FILTER (toxic = 0) + count(*) FILTER (quality = 0)), 6) AS f1 FROM labels")(
    lambda s, d: statistics.binary_scores(table(s, d, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("predicted")), 0).select(*(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detrend, smooth, normalize, trim and average by group: row-local until the one shuffle of the average."""
    got = spectra(spark, sf_dir).withColumn("y", A.detrend(F.col("y"))).withColumn("y", A.savgol(F.col("y"), 5, 2)).withColumn("y", A.snv(F.col("y")))
    s, e = A.nearest(F.col("x"), 400.0), A.nearest(F.col("x"), 1400.0)
    got = got.select("key", "grp", A.cut(F.col("x"), s, e).alias("x"), A.cut(F.col("y"), s, e).alias("y"))
    return aggregates.group_average(to_points(got)).select("grp", "i", "x", r6(F.col("y"), "y"))


_FLAG = f"WITH t AS (SELECT key, grp, i, x, y - (regr_slope(y, i) OVER (PARTITION BY key) * i + regr_intercept(y, i) OVER (PARTITION BY key)) AS y FROM pts), s AS (SELECT key, i, v AS y FROM ({_savgol_sql().replace('FROM pts', 'FROM t').replace('round(', '(').replace(', 6) + 0.0', ')')})), z AS (SELECT t.key, grp, t.i, x, (s.y - avg(s.y) OVER p) / stddev_pop(s.y) OVER p AS y FROM t JOIN s USING (key, i) WINDOW p AS (PARTITION BY t.key)) SELECT grp, CAST(i - 5 AS INTEGER) AS i, min(x) AS x, round(avg(y), 6) + 0.0 AS y FROM z WHERE x BETWEEN 400 AND 1400 GROUP BY grp, i"
query("flagship", _FLAG)(flagship)


# -- ranges, lines and parameters


@query("fluorescence_start", f"""
WITH g AS (SELECT key, i, x, CASE WHEN lag(y) OVER ({W}) IS NULL THEN lead(y) OVER ({W}) - y WHEN lead(y) OVER ({W}) IS NULL THEN y - lag(y) OVER ({W}) ELSE (lead(y) OVER ({W}) - lag(y) OVER ({W})) / 2 END AS g FROM pts),
s AS (SELECT key, min(i) AS steep FROM (SELECT *, stddev_pop(g) OVER (PARTITION BY key) AS d, arg_min(i, (abs(x - 400.0), i)) OVER (PARTITION BY key) AS st FROM g) WHERE i >= st AND g > d GROUP BY key),
f AS (SELECT g.key, g.i, g.g < 0 AND lag(g.g) OVER (PARTITION BY g.key ORDER BY g.i) < 0 AS run, steep FROM g JOIN s USING (key))
SELECT key, min(i) AS place FROM f WHERE run AND i - 1 > steep GROUP BY key""")
def fluorescence_start(spark, sf_dir):
    return spectra(spark, sf_dir).select("key", A.fluorescence_start(F.col("x"), F.col("y"), 2, 400.0).alias("place")).where("place is not null")


@query("auto_trim_range", f"WITH m AS (SELECT key, min(i) AS a, max(i) AS b FROM (SELECT key, i, y < lag(y) OVER ({W}) AND y < lead(y) OVER ({W}) AS low FROM pts) WHERE low GROUP BY key) SELECT max(a) AS left_i, round(quantile_cont(b, 0.0095), 4) AS right_i FROM m")
def auto_trim_range(spark, sf_dir):
    m = A.minima(F.col("y"))
    ends = spectra(spark, sf_dir).select(F.array_min(m).alias("a"), F.array_max(m).alias("b"))
    return ends.agg(F.max("a").alias("left_i"), F.round(F.percentile("b", 0.0095), 4).alias("right_i"))


@query("line_counts_mode", f"WITH c AS (SELECT grp, key, count(*) AS n FROM (SELECT key, grp, y > lag(y) OVER ({W}) AND y > lead(y) OVER ({W}) AS top FROM pts) WHERE top GROUP BY ALL), t AS (SELECT grp, n, count(*) AS times FROM c GROUP BY ALL) SELECT grp, arg_min(n, (-times, n)) AS n_lines FROM t GROUP BY grp")
def line_counts_mode(spark, sf_dir):
    tops = A.minima(F.transform("y", lambda v: -v))
    return aggregates.common_line_count(spectra(spark, sf_dir).select("grp", F.size(tops).cast("long").alias("n_lines")), "grp")


@query("cluster_centres", "SELECT o_custkey, round(median(o_totalprice), 6) AS centre, round(stddev_pop(o_totalprice), 4) AS spread, count(*) AS n FROM orders GROUP BY o_custkey")
def cluster_centres(spark, sf_dir):
    got = aggregates.cluster_centres(table(spark, sf_dir, "orders").withColumnRenamed("o_totalprice", "value"), "o_custkey")
    return got.select("o_custkey", F.round("centre", 6).alias("centre"), F.round("spread", 4).alias("spread"), "n")


@query("curve_sum", "SELECT key, i, round(sum(y * f), 6) + 0.0 AS y FROM pts, (VALUES (1.0::DOUBLE), (0.5::DOUBLE)) c(f) GROUP BY key, i")
def curve_sum(spark, sf_dir):
    curves = points(spark, sf_dir).select("key", "i", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(v).alias("visible")) for f, v in ((1.0, True), (0.5, True), (9.0, False))])).alias("c"), "y")
    return aggregates.curve_sum(curves.select("key", "i", "c.visible", (F.col("y") * F.col("c.f")).alias("y"))).select("key", "i", r6(F.col("y"), "y"))


@query("fit_averages", "WITH f AS (SELECT l_orderkey AS key, l_quantity AS chisqr, l_discount AS bic FROM lineitem WHERE l_quantity > 1e-250) SELECT coalesce(key, -1) AS key, round(avg(chisqr), 6) AS chisqr, round(avg(bic), 9) AS bic FROM f GROUP BY ROLLUP (key)")
def fit_averages(spark, sf_dir):
    fits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("chisqr"), F.col("l_discount").alias("bic"), *(F.lit(0.0).alias(c) for c in ("redchi", "aic", "r2")))
    return aggregates.fit_averages(fits).select(F.coalesce("key", F.lit(-1)).alias("key"), F.round("chisqr", 6).alias("chisqr"), F.round("bic", 9).alias("bic"))


@query("amplitude_bounds", "SELECT key, line, round(max(y), 6) + 0.0 AS a FROM pts, (VALUES (0, 460.0, 540.0), (1, 820.0, 980.0)) l(line, lo, hi) WHERE x BETWEEN lo AND hi GROUP BY key, line")
def amplitude_bounds(spark, sf_dir):
    lines = F.array(*[F.struct(F.lit(k).alias("line"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for k, a, b in ((0, 460.0, 540.0), (1, 820.0, 980.0))])
    rows = spectra(spark, sf_dir).select("key", "x", "y", F.explode(lines).alias("l"))
    return rows.select("key", "l.line", r6(A.moved_amplitude(F.col("x"), F.col("y"), F.col("l.lo"), F.col("l.hi")), "a"))


@query("parameter_bounds", "WITH l AS (SELECT l_orderkey AS key, l_linenumber AS line, l_quantity AS a, l_extendedprice AS x0, greatest(l_tax, 1e-6) AS dx FROM lineitem) SELECT key, line, 'a' AS param, a AS value, 0.0 AS min_value, 2 * a AS max_value FROM l UNION ALL SELECT key, line, 'x0', x0, x0 - dx, x0 + dx FROM l UNION ALL SELECT key, line, 'dx', dx, dx / 2, 2 * dx FROM l")
def parameter_bounds(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("x0"), F.col("l_tax").alias("dx"))
    return relational.parameter_bounds(lines)


@query("interval_join", "SELECT o_orderkey, min(k) AS interval FROM orders, (VALUES (0.0, 90000.0, 0), (80000.0, 150000.0, 1), (150000.0, 300000.0, 2)) t(a, b, k) WHERE o_totalprice >= a AND o_totalprice < b GROUP BY o_orderkey")
def interval_join(spark, sf_dir):
    intervals = spark.createDataFrame([(0.0, 90_000.0, 0), (80_000.0, 150_000.0, 1), (150_000.0, 300_000.0, 2)], "start double, stop double, interval int")
    return relational.interval_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", intervals).select("o_orderkey", "interval")


@query("changed_parameters", "SELECT 'l_ratio' AS param, 'added' AS change UNION ALL SELECT 'gamma', 'removed'")
def changed_parameters(spark, sf_dir):
    of = lambda *n: spark.createDataFrame([(v,) for v in n], "param string")
    return relational.changed_parameters(of("a", "x0", "dx", "gamma"), of("a", "x0", "dx", "l_ratio"))


@query("active_features", "SELECT n_name AS feature, n_regionkey <> 1 AS active FROM nation")
def active_features(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("feature"), "n_regionkey")
    return relational.active_features(nation.select("feature"), nation.where("n_regionkey = 1"))


@query("regroup_cascade", "SELECT vec_id AS key, CASE WHEN vec_id % 3 = 0 THEN 9 ELSE label END AS grp FROM embeddings")
def regroup_cascade(spark, sf_dir):
    one = spectra(spark, sf_dir).select("key", "grp")
    return relational.regroup(one, one.where("key % 3 = 0").select("key", F.lit(9).alias("grp")))


@query("scalar_extremes", "SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi, round(avg(s_acctbal), 6) AS mean FROM supplier")
def scalar_extremes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"), F.round(F.avg("s_acctbal"), 6).alias("mean"))


@query("despike_scope", "SELECT vec_id AS key FROM embeddings WHERE label = 3")
def despike_scope(spark, sf_dir):
    return decompose.despiked(spectra(spark, sf_dir).where("grp = 3"), 300.0, 60.0).select("key")


@query("log_loss", "SELECT l_linestatus, round(-avg(ln(greatest(least(l_discount * 5 + 0.3, 1 - 1e-15), 1e-15))), 6) AS log_loss FROM lineitem GROUP BY l_linestatus")
def log_loss(spark, sf_dir):
    return statistics.log_loss(table(spark, sf_dir, "lineitem"), F.col("l_discount") * 5 + 0.3, "l_linestatus").select("l_linestatus", F.round("log_loss", 6).alias("log_loss"))


# -- kernels and models: no SQL, tested by their properties

#: Windows that suit the 64 points of the test spectra.
_SMALL = {"half_window": 5, "max_half_window": 12, "min_half_window": 2}


def _baseline_query(name: str) -> Query:
    known = inspect.signature(_baseline.METHODS[name]).parameters
    params = {k: v for k, v in _SMALL.items() if k in known}
    return lambda s, d: to_points(with_baselines(spectra(s, d), name, **params), "baseline", "corrected").select("key", "i", "baseline", "corrected")


def _slug(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


for _name in _baseline.METHODS:
    query(f"baseline_{_slug(_name)}")(_baseline_query(_name))
for _name in _smooth.SMOOTHERS:
    query(f"smooth_{_slug(_name)}")(lambda s, d, n=_name: to_points(apply(spectra(s, d), [Step("smooth", n)])).select("key", "i", "y"))


@query("norm_emsc")
def norm_emsc(spark, sf_dir):
    one = spectra(spark, sf_dir)
    mean = aggregates.group_average(to_points(one), by=()).orderBy("i").select("y").collect()  # one value for each place of the axis
    return to_points(apply(one, [Step("normalize", "EMSC", {"reference": [r["y"] for r in mean]})])).select("key", "i", "y")


query("despike")(lambda s, d: decompose.despiked(spectra(s, d), 300.0, 60.0).select("key", "y", "peaks"))
query("guess_lines")(lambda s, d: decompose.guess_lines(spectra(s, d), [800.0, 1200.0], fwhm=80.0))
query("line_template")(lambda s, d: decompose.template(decompose.guess_lines(spectra(s, d), [800.0, 1200.0], fwhm=80.0), 40.0))
query("fit_params")(lambda s, d: decompose.fit_batch(spectra(s, d), [500.0, 700.0, 900.0, 1300.0], "Gaussian", 80.0, [800.0]))
query("fit_statistics")(lambda s, d: aggregates.fit_averages(decompose.fits(spectra(s, d), [500.0, 900.0, 1300.0], "Pseudo Voigt", 80.0)))
query("fit_band")(lambda s, d: to_points(decompose.fits(spectra(s, d), [500.0, 900.0], "Gaussian", 80.0), "curve", "top", "bottom"))
query("decomposed_dataset")(lambda s, d: decompose.dataset(decompose.fit_batch(spectra(s, d), [500.0, 900.0, 1300.0], "Lorentzian", 80.0)))
query("normality_test")(lambda s, d: tests_of_groups.normality(features(s, d)))
query("mann_whitney_p")(lambda s, d: tests_of_groups.mann_whitney(features(s, d), 1, 2))
query("anova_p")(lambda s, d: tests_of_groups.anova(features(s, d)))
query("top_features")(lambda s, d: tests_of_groups.top_features(features(s, d)))
query("hotelling_test")(lambda s, d: tests_of_groups.hotelling(s, spectra(s, d), 1, 2))
query("permutation_test")(lambda s, d: tests_of_groups.permutation(spectra(s, d), 1, 2))


def learnt(spark, sf_dir, classes: Sequence[int] = ()):
    return learning.dataset(spectra(spark, sf_dir), classes)


for _name in learning.CLASSIFIERS:
    query(f"classify_{_slug(_name)}")(lambda s, d, n=_name: learning.train_and_predict(learnt(s, d), n))
query("classify_lda_of_classes")(lambda s, d: learning.train_and_predict(learnt(s, d, (0, 1, 2)), "LDA"))
query("classifier_metrics")(lambda s, d: learning.metrics(learning.train_and_predict(learnt(s, d), "LDA")))
query("principal_components")(lambda s, d: learning.principal_components(learnt(s, d))[0])
query("linear_contributions")(lambda s, d: learning.linear_contributions(learnt(s, d), learning.discriminant(learnt(s, d))))
query("windowed_events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(lambda s, d: scoring.windowed(table(s, d, "events")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total")))
query("pipeline_chain")(lambda s, d: to_points(apply(spectra(s, d), [Step("cut", params={"start": 340.0, "end": 1500.0}), Step("baseline", "ExModPoly", {"poly_order": 4}), Step("smooth", "Whittaker", {"lam": 2.0}), Step("normalize", "SNV")])).select("key", "i", "x", "y"))
query("det_points", "WITH c AS (SELECT l_quantity AS score, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1) SELECT score, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr, round(1 - sum(p) OVER w / sum(p) OVER (), 6) + 0.0 AS fnr FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)")(
    lambda s, d: statistics.det_points(table(s, d, "lineitem"), F.col("l_returnflag") == "R", "l_quantity").select("score", F.round("fpr", 6).alias("fpr"), r6(F.col("fnr"), "fnr"))
)
query("predict_all")(lambda s, d: learning.predict_all(learnt(s, d), learning.CLASSIFIERS))
query("learning_curve")(lambda s, d: learning.learning_curve(learnt(s, d)))


def fitted(name: str, df: DataFrame, **params):
    return learning.estimator(name, **params).fit(df)


for _name in ("Decision Tree", "Random Forest", "XGBoost"):
    query(f"shap_{_slug(_name)}")(lambda s, d, n=_name: explain.tree_contributions(learnt(s, d), fitted(n, learnt(s, d))))
query("shap_top_features")(lambda s, d: explain.mean_contributions(explain.tree_contributions(learnt(s, d), fitted("Random Forest", learnt(s, d))), 10))
query("partial_dependence")(lambda s, d: explain.partial_dependence(learnt(s, d), fitted("Random Forest", learnt(s, d)), [3]))
query("partial_dependence_2d")(lambda s, d: explain.partial_dependence(learnt(s, d), fitted("Random Forest", learnt(s, d)), [3, 7], 5))
query("decision_areas_lda")(lambda s, d: explain.decision_areas(learnt(s, d), "LDA"))
query("decision_areas_tree")(lambda s, d: explain.decision_areas(learnt(s, d), "Decision Tree"))


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    data = learnt(spark, sf_dir)
    model = fitted("Decision Tree", data)
    return learning.permutation_importance(data, model, range(model.numFeatures))


for _name in _optimizers.METHODS:
    query(f"fit_method_{_slug(_name)}")(lambda s, d, n=_name: decompose.fit_batch(spectra(s, d), [500.0, 900.0], "Gaussian", 80.0, [700.0], n).select("key", "grp", "line", "param", F.round("value", 3).alias("value")))
