"""Statistics by feature and group: variance ratio, rank sums, clusters on a line, classifier metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.relational import hash_numbered, running_totals


def anova_f(long: DataFrame) -> DataFrame:
    """F of (feature, grp, value) by grouped moments: one pass, partial sums."""
    by = long.groupBy("feature", "grp").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    total = by.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"))
    between = F.col("nmm") - F.col("n") * F.col("gm") * F.col("gm")
    return total.select("feature", (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"), ((between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"))


def mean_ranks(counts: DataFrame, *by: str) -> DataFrame:
    """rank of each distinct value (columns value and n, its rows): from 1, ties get their mean."""
    ranked = running_totals(counts, "value", ["n"], by)
    return ranked.withColumn("rank", F.col("cum_n") - (F.col("n") - 1) / 2).drop("cum_n")


def mann_whitney_u(long: DataFrame, first: int, second: int) -> DataFrame:
    """U of the first group against the second, by feature, and the sum t^3 - t over ties; null values take no part."""
    own = F.count(F.when(F.col("grp") == first, 1)).alias("own")
    counts = long.where(F.col("grp").isin(first, second) & F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"), own)
    sums = mean_ranks(counts, "feature").groupBy("feature").agg(F.sum("own").alias("n1"), F.sum(F.col("n") - F.col("own")).alias("n2"), F.sum(F.col("rank") * F.col("own")).alias("r1"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    return sums.select("feature", "n1", "n2", "ties", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"))


def clusters_on_a_line(df: DataFrame, value: str, eps: float, *by: str) -> DataFrame:
    """DBSCAN with two members at least, in one dimension: a gap over eps ends a cluster; lone values are noise (-1)."""
    w = Window.partitionBy(*by).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) <= eps, 0).otherwise(1)
    runs = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")
    return runs.withColumn("run", F.when(F.count("*").over(Window.partitionBy(*by, "run")) > 1, F.col("run")).otherwise(-1))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced: n / (classes * n of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(whole)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def stratified_split(df: DataFrame, label: str, key: str, test_percent: float, seed: int = 0) -> DataFrame:
    """is_test for the rows of least seeded hash of each class: the same for any partitioning."""
    placed = hash_numbered(df, key, seed, [label])
    return placed.withColumn("is_test", F.col("hash_no") <= F.round(F.col("hash_rows") * test_percent / 100)).drop("hash_no", "hash_rows")


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def roc_auc(df: DataFrame, label: Column, score: str, *by: str) -> DataFrame:
    """Area under the curve by the rank sum; ties count half. Rows without a score take no part."""
    scored = df.where(F.col(score).isNotNull())
    counts = scored.groupBy(*by, F.col(score).alias("value")).agg(F.sum(label.cast("long")).alias("p"), F.count("*").alias("n"))
    p, n = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    return mean_ranks(counts, *by).groupBy(*by).agg(((F.sum(F.col("rank") * F.col("p")) - p * (p + 1) / 2) / (p * n)).alias("auc"))


def _cumulative(df: DataFrame, label: Column, score: str) -> DataFrame:
    """score, cum_p, cum_n at each distinct score from the highest, and the totals all_p, all_n."""
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(label.cast("long")).alias("p"), F.sum((~label).cast("long")).alias("n"))
    whole = counts.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))  # one row
    return running_totals(counts, "score", ["p", "n"], descending=True).crossJoin(F.broadcast(whole))


def roc_points(df: DataFrame, label: Column, score: str) -> DataFrame:
    """(score, tpr, fpr) at each distinct score, from the highest."""
    return _cumulative(df, label, score).select("score", (F.col("cum_p") / F.col("all_p")).alias("tpr"), (F.col("cum_n") / F.col("all_n")).alias("fpr"))


#: Places of the false positive rate, from 0 to 1, at which curves of several classes are averaged.
GRID = 1000


def roc_grid(df: DataFrame, hit: Column, score: str, curve: str, places: int = GRID) -> DataFrame:
    """(curve, place, fpr, tpr): each curve's true positive rate on an even grid of false positive rates, by straight lines between its points.

    Points are the distinct scores and (0, 0); of points at one rate the highest counts.  Each curve's points are
    counted by distinct score and added up in two levels; then the first and the last point of each step of the grid
    are enough, so no task holds more of a curve than the grid has places.  Curves without both kinds of rows have none.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(curve).alias("curve"), F.col(score).alias("score")).agg(F.sum(hit.cast("long")).alias("p"), F.sum((~hit).cast("long")).alias("n"))
    whole = counts.groupBy("curve").agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")).where("all_p > 0 AND all_n > 0")
    points = running_totals(counts, "score", ["p", "n"], ["curve"], descending=True).join(whole, "curve").select("curve", "cum_p", "cum_n", "all_p", "all_n")
    points = points.unionByName(whole.select("curve", F.lit(0).cast("long").alias("cum_p"), F.lit(0).cast("long").alias("cum_n"), "all_p", "all_n"))
    step = F.ceil(F.col("cum_n") * (places - 1) / F.col("all_n")).cast("int")  # the first place of the grid that is not below the point
    at = F.struct((F.col("cum_n") / F.col("all_n")).alias("fpr"), (F.col("cum_p") / F.col("all_p")).alias("tpr"))
    ends = points.groupBy("curve", step.alias("place")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    grid = whole.select("curve", F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("place")).join(ends, ["curve", "place"], "left")
    so_far = Window.partitionBy("curve").orderBy("place")
    left = F.last("last", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("first", ignorenulls=True).over(so_far.rowsBetween(1, Window.unboundedFollowing))
    drawn = grid.select("curve", "place", (F.col("place") / (places - 1)).alias("fpr"), left.alias("left"), right.alias("right"))
    rise = (F.col("right.tpr") - F.col("left.tpr")) * (F.col("fpr") - F.col("left.fpr")) / (F.col("right.fpr") - F.col("left.fpr"))
    return drawn.select("curve", "place", "fpr", (F.col("left.tpr") + F.coalesce(rise, F.lit(0.0))).alias("tpr"))


def roc_averages(cells: DataFrame, hit: Column, score: str, label: str, places: int = GRID) -> DataFrame:
    """(curve, place, fpr, tpr) of every class against the rest, of 'micro' (all cells as one curve) and of 'macro' (the mean of the classes' curves).

    cells: a row for each row and class, with the class's score and whether it is the row's class.
    """
    named = cells.select(F.explode(F.array(F.col(label).cast("string"), F.lit("micro"))).alias("curve"), F.col(score).alias("score"), hit.alias("hit"))
    each = roc_grid(named, F.col("hit"), "score", "curve", places)
    macro = each.where("curve <> 'micro'").groupBy("place").agg(F.first("fpr").alias("fpr"), F.avg("tpr").alias("tpr"))
    return each.unionByName(macro.select(F.lit("macro").alias("curve"), "place", "fpr", "tpr"))


def micro_f1(df: DataFrame, *by: str, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """f1 of all classes' hits together, by groups, from the confusion counts."""
    cells = df.groupBy(*by, label, predicted).agg(F.count("*").alias("n"))
    hits, whole = F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)), F.sum("n")
    return cells.groupBy(*by).agg((2 * hits / (2 * hits + 2 * (whole - hits))).alias("f1"))


def precision_recall_points(df: DataFrame, label: Column, score: str) -> DataFrame:
    """(score, precision, recall) at each distinct score, from the highest."""
    precision = F.col("cum_p") / (F.col("cum_p") + F.col("cum_n"))
    return _cumulative(df, label, score).select("score", precision.alias("precision"), (F.col("cum_p") / F.col("all_p")).alias("recall"))


def calibration(df: DataFrame, label: Column, score: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label.cast("double")).alias("share"))


def binary_scores(df: DataFrame, positive, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """accuracy, precision, recall, f1 with the given positive class."""
    hit = F.col(label) == F.col(predicted)
    said, own = F.col(predicted) == positive, F.col(label) == positive
    tp = F.sum((said & own).cast("long"))
    p, r = tp / F.sum(said.cast("long")), tp / F.sum(own.cast("long"))
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"), p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1"))


def log_loss(df: DataFrame, probability_of_label: Column, *by: str) -> DataFrame:
    p = F.greatest(F.least(probability_of_label, F.lit(1 - 1e-15)), F.lit(1e-15))
    return df.groupBy(*by).agg((-F.avg(F.log(p))).alias("log_loss"))


def det_points(df: DataFrame, label: Column, score: str) -> DataFrame:
    """(score, fpr, fnr) at each distinct score: detection error trade-off."""
    return roc_points(df, label, score).select("score", "fpr", (1 - F.col("tpr")).alias("fnr"))


def misclassified(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.where(F.col(label) != F.col(predicted))


def class_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """label, precision, recall, f1, support of every class that has rows, from the confusion counts; a class never predicted has precision 0."""
    cells = confusion(df, label, predicted).select(F.col(label).alias("label"), F.col(predicted).alias("said"), "n")
    own = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("said"), F.col("n")).otherwise(0)).alias("tp"))
    said = cells.groupBy(F.col("said").alias("label")).agg(F.sum("n").alias("times"))
    both = own.join(said, "label", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return both.select("label", F.coalesce(F.col("tp") / F.nullif(F.col("times"), F.lit(0)), F.lit(0.0)).alias("precision"), (F.col("tp") / F.col("support")).alias("recall"), (2 * F.col("tp") / (F.col("times") + F.col("support"))).alias("f1"), "support")
