"""Tests of group differences: normality, Hotelling, permutation, rank sums with p values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.kernels import special
from lumenframe.operators import statistics
from lumenframe.operators.relational import hash_numbered, running_totals

#: Values up to which the p of the normality test holds.
NORMALITY_ROWS = 5_000
#: Rows relabelled at a time: with 10,000 rounds some 20 MB.
PICKED_ROWS = 256


def normality(long: DataFrame) -> DataFrame:
    """Shapiro-Wilk of each feature over all its values; p_valid: not more than the 5000 that its p holds for.

    W needs sums over the values with their ranks only. Equal values go as one: they share the mean of
    their weights, by the ranks before them. Null and NaN values take no part.
    """
    counts = long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("feature", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n"))
    moments = counts.groupBy("feature").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"))
    ranked = running_totals(counts, "value", ["n"], ["feature"]).join(moments, "feature")

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, d = b["n"].to_numpy(), (b["value"] - b["mean"]).to_numpy()
            first = b["cum_n"].to_numpy() - n
            ranks = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(1, n.sum() + 1) if len(b) else np.zeros(0)
            m = special.normal_scores(ranks, np.repeat(b["total"].to_numpy(), n))
            at = np.repeat(np.arange(len(b)), n)
            yield pd.DataFrame({"feature": b["feature"], "total": b["total"], "mx": np.bincount(at, m, len(b)) * d, "mm": np.bincount(at, m * m, len(b)), "xx": n * d * d, "first": first, "last": b["cum_n"], "d": d})

    each = ranked.select("feature", "value", "n", "cum_n", "total", "mean").mapInPandas(scores, "feature int, total long, mx double, mm double, xx double, first long, last long, d double")
    holds = lambda rank: F.max(F.when((F.col("first") < rank) & (F.col("last") >= rank), F.col("d")))
    ends = [holds(F.lit(1)), holds(F.lit(2)), holds(F.col("total") - 1), holds(F.col("total"))]
    sums = each.groupBy("feature").agg(F.max("total").alias("n"), *(F.sum(c).alias(c) for c in ("mx", "mm", "xx")), *(e.alias(f"e{i}") for i, e in enumerate(ends)))
    sums = long.select("feature").distinct().join(sums, "feature", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # a feature without values keeps its row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [special.shapiro_wilk_of_sums(int(r.n), r.mx, r.mm, r.xx, (r.e0, r.e1, r.e2, r.e3)) for r in b.itertuples()]
            yield pd.DataFrame({"feature": b["feature"], "w": [w for w, _ in found], "p": [p for _, p in found], "p_valid": b["n"] <= NORMALITY_ROWS})

    return sums.mapInPandas(run, "feature int, w double, p double, p_valid boolean")


def mann_whitney(long: DataFrame, first: int, second: int) -> DataFrame:
    """U and its two-sided p by feature; a row a feature reaches Python."""
    u = statistics.mann_whitney_u(long, first, second)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p=[special.mann_whitney_p(float(r.u), int(r.n1), int(r.n2), float(r.ties)) for r in b.itertuples()])

    return u.select("feature", F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), "ties", F.col("u").cast("double").alias("u")).mapInPandas(run, "feature int, n1 long, n2 long, ties long, u double, p double")


def anova(long: DataFrame) -> DataFrame:
    """F and p by feature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p=[special.f_sf(float(r.f), float(r.df1), float(r.df2)) for r in b.itertuples()])

    return statistics.anova_f(long).mapInPandas(run, "feature int, df1 long, df2 long, f double, p double")


def top_features(long: DataFrame, percent: float = 50.0) -> DataFrame:
    """ANOVA scores; active: the features whose F is among the highest percent."""
    scores = anova(long)
    cut = scores.agg(F.percentile("f", 1 - percent / 100).alias("cut"))
    return scores.crossJoin(F.broadcast(cut)).select("feature", "f", "p", (F.col("f") >= F.col("cut")).alias("active"))


def _moments(arrays: DataFrame, grp: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sum and sum of outer products of one group's arrays, added up in each task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, None, None
        for b in batches:
            if len(b):
                m = np.stack(list(b["y"])).astype(float)
                n += len(m)
                s, q = (m.sum(axis=0), m.T @ m) if s is None else (s + m.sum(axis=0), q + m.T @ m)
        if n:
            rows = np.concatenate([[n], s, q.ravel()])
            yield pd.DataFrame({"i": np.arange(len(rows)), "v": rows})

    sums = arrays.where(F.col("grp") == grp).select("y").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i").v.to_numpy()
    p = int(round((-1 + np.sqrt(1 + 4 * (len(sums) - 1))) / 2))
    return int(sums[0]), sums[1 : p + 1], sums[p + 1 :].reshape(p, p)


def hotelling(spark, arrays: DataFrame, first: int, second: int, components: int = 10) -> DataFrame:
    """T2, F and p after a principal component projection; what the driver holds has the size of one covariance matrix."""
    (n1, s1, q1), (n2, s2, q2) = _moments(arrays, first), _moments(arrays, second)
    n, mean = n1 + n2, (s1 + s2) / (n1 + n2)
    p = min(components, len(mean), n - 2)
    axes = np.linalg.eigh((q1 + q2) / n - np.outer(mean, mean))[1][:, ::-1][:, :p]
    d = (s1 / n1 - s2 / n2) @ axes
    within = lambda m, s, q: axes.T @ (q - np.outer(s, s) / m) @ axes
    t2 = float(n1 * n2 / n * d @ np.linalg.pinv((within(n1, s1, q1) + within(n2, s2, q2)) / (n - 2)) @ d)
    f = t2 * (n - p - 1) / (p * (n - 2))
    return spark.createDataFrame([(t2, f, special.f_sf(f, p, n - p - 1))], "t2 double, f double, p double")


def own_in_block(n: int, k: int, block: int, rounds: int, seed: int) -> np.ndarray:
    """How many of k labels, dealt over n rows in blocks of PICKED_ROWS, fall into a block, in each round.

    The rows are halved down to the block; each half's share is drawn from the hypergeometric distribution with a
    seed of the halves, so that all blocks agree and a round has k labels in all. From 1e9 rows on (the bound of
    the generator) the normal approximation is drawn, whose error is far below a label in a thousand there.
    """
    rows = lambda a, b: min(b * PICKED_ROWS, n) - a * PICKED_ROWS
    lo, hi, own = 0, -(-n // PICKED_ROWS), np.full(rounds, k, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng, whole, part = np.random.default_rng([seed, lo, hi]), rows(lo, hi), rows(lo, mid)
        if whole < 1_000_000_000:
            left = rng.hypergeometric(own, whole - own, part)
        else:
            share = own / whole
            left = np.rint(rng.normal(part * share, np.sqrt(part * share * (1 - share) * (whole - part) / (whole - 1)))).astype(np.int64)
            left = np.clip(left, np.maximum(0, own - (whole - part)), np.minimum(own, part))
        lo, hi, own = (lo, mid, left) if block < mid else (mid, hi, own - left)
    return own


def permutation(arrays: DataFrame, first: int, second: int, rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """Distance of the group means against seeded relabellings that keep the sizes of the groups.

    Rows are numbered in a hash order and dealt into blocks; each block knows how many labels it gets in each
    round and deals them among its rows. Sums are added up in each task before the shuffle.
    """
    rows = arrays.where(F.col("grp").isin(first, second)).select("key", (F.col("grp") == first).alias("own"), "y")
    counted = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("own").cast("long")), F.lit(0)).alias("k")).first()
    n_rows, k = counted["n"], counted["k"]
    dealt = hash_numbered(rows, "key", seed).withColumn("block", F.floor((F.col("hash_no") - 1) / PICKED_ROWS).cast("long"))

    def relabelled(block: int, held: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
        b = pd.concat(held).sort_values("hash_no")
        m, own = np.stack(list(b["y"])).astype(float), own_in_block(n_rows, k, block, rounds, seed)
        u = np.random.default_rng([seed, block]).random((rounds, len(m)))
        least = np.take_along_axis(np.sort(u, axis=1), np.maximum(own - 1, 0)[:, None], axis=1)
        pick = np.vstack([b["own"].to_numpy(bool), (u <= least) & (own > 0)[:, None]]).astype(float)
        return np.concatenate([pick @ m, np.tile(m.sum(axis=0), (rounds + 1, 1))], axis=1), np.column_stack([pick.sum(axis=1), np.full(rounds + 1, len(m))])

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[pd.DataFrame]]]:
        at, held = None, []
        for b in batches:
            for block, own in b.groupby("block"):
                if held and block != at:
                    yield at, held
                    held = []
                at = int(block)
                held.append(own)
        if held:
            yield at, held

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = count = None
        for block, held in blocks(batches):
            s, c = relabelled(block, held)
            total, count = (s, c) if total is None else (total + s, count + c)
        if total is not None:
            yield pd.DataFrame({"round": np.arange(rounds + 1), "sums": list(total), "n1": count[:, 0], "n": count[:, 1]})

    rows = dealt.select("block", "hash_no", "own", "y").repartition("block").sortWithinPartitions("block")
    parts = rows.mapInPandas(run, "round int, sums array<double>, n1 double, n double")
    w = F.posexplode("sums").alias("i", "s")
    sums = parts.select("round", "n1", "n", w).groupBy("round", "i").agg(F.sum("s").alias("s"), F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    width = F.max("i").over(statistics.Window.partitionBy("round"))
    sums = sums.withColumn("half", ((width + 1) / 2).cast("int"))
    pairs = sums.groupBy("round", F.pmod("i", "half").alias("f")).agg(F.sum(F.when(F.col("i") < F.col("half"), F.col("s"))).alias("s1"), F.sum(F.when(F.col("i") >= F.col("half"), F.col("s"))).alias("s"), F.max("n1").alias("n1"), F.max("n").alias("n"))
    d = F.col("s1") / F.greatest("n1", F.lit(1.0)) - (F.col("s") - F.col("s1")) / F.greatest(F.col("n") - F.col("n1"), F.lit(1.0))
    stats = pairs.groupBy("round").agg(F.sqrt(F.sum(d * d)).alias("stat"))
    seen = stats.agg(F.max(F.when(F.col("round") == 0, F.col("stat"))).alias("observed"))
    return stats.crossJoin(F.broadcast(seen)).groupBy("observed").agg(((F.sum(((F.col("round") > 0) & (F.col("stat") >= F.col("observed"))).cast("long")) + 1) / (F.sum((F.col("round") > 0).cast("long")) + 1)).alias("p")).withColumnRenamed("observed", "stat")


def compare(arrays: DataFrame, long: DataFrame, first: int, second: int, alpha: float = 0.05, rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """test, feature, statistic, p, differs: the tests that suit two groups.

    A group is normal if no feature's Shapiro-Wilk p is under alpha; its row has the least p, and differs if it
    is not normal. Two normal groups are compared by Hotelling's test of ten components, others by relabelling
    (no feature) and by the rank sums of each feature.
    """
    spark = arrays.sparkSession
    told, normal = [], True
    for grp in (first, second):
        p = normality(long.where(F.col("grp") == grp)).agg(F.min("p")).first()[0]
        told.append((f"normality of {grp}", None, None, p, p is not None and p < alpha))
        normal = normal and p is not None and p >= alpha
    schema = "test string, feature int, statistic double, p double, differs boolean"
    out = spark.createDataFrame(told, schema)
    row = lambda df, test, feature, statistic: df.select(F.lit(test).alias("test"), feature.cast("int").alias("feature"), F.col(statistic).alias("statistic"), "p", (F.col("p") < alpha).alias("differs"))
    if normal:
        return out.unionByName(row(hotelling(spark, arrays, first, second), "hotelling", F.lit(None), "t2"))
    ranks = row(mann_whitney(long, first, second), "mann-whitney", F.col("feature"), "u")
    return out.unionByName(row(permutation(arrays, first, second, rounds, seed), "permutation", F.lit(None), "stat")).unionByName(ranks)
