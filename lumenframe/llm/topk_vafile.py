"""Exact top-k search by vector-approximation files.

Two files are written, once for all queries: the exact vectors, and their approximation,
one byte a dimension: the number of the cell on a grid that spans the whole table.  A
search scans the approximation only.  The cells bound each inner product from both
sides, and what can't reach the kth lower bound (of a task, then of all) is dropped.
The vectors of the candidates left are then fetched from the exact file in rounds, those
of the greatest upper bound (the least distance bound) first: FIRST * k a query, then GROWTH
times as many, until no bound left reaches the kth exact result, which then is certain.

Vectors that are equal as integers are one row of the files, with the k + 1 smallest of
their ids (limited before the shuffle), as no query needs more; so a vector that a third
of all rows repeat is bounded and fetched once a query.  Queries go in waves of at most
WAVE rows (checked before each broadcast), so what is broadcast never grows with the
table.  Several waves are each written before the next.

Vectors that are null or hold nulls or non-finite components (as given or times SCALE),
and rows without an id, take no part; an empty table gives none.  A query's candidates
are the vectors of its length with another id; of rows that repeat a query's id, the
least vector is the query.  Ties go to smaller ids; repeated candidates count each.  A
score outside a long is given as its nearest end.  Other columns, of any name, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import written

SCALE = 1024
CELLS = 256
WAVE = 8_192
#: Exact vectors fetched first for each query, as a multiple of k, and how much more in each further round.
FIRST, GROWTH = 2, 4
#: Rows of the bound matrix; candidates that a task holds before it hands them on.
QUERY_BLOCK, HELD = 512, 1 << 21
#: Integer components below this can't overflow a 64-bit sum of a few thousand products.
SAFE = float(1 << 25)
#: Bounds are computed in single precision below this.
SINGLE = 1e30


def integers(embedding: Column) -> Column:
    """floor(SCALE * x) of each component, as doubles (which hold every such value)."""
    scaled = lambda x: x.cast("double") * SCALE
    return F.transform(embedding, lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))


def valid(vectors: DataFrame) -> DataFrame:
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)


def exact_file(spark: SparkSession, vectors: DataFrame, k: int) -> DataFrame:
    """key, x, ids, times: each integer vector once, with the k + 1 smallest ids that have it and how often."""
    rows = vectors.select("vec_id", integers(F.col("embedding")).alias("x")).groupBy("x", "vec_id").agg(F.count("*").alias("n"))
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    own = few.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("vec_id", F.least("n", F.lit(k)).cast("int").alias("n")))).alias("own"))
    return written(spark, own.select(F.xxhash64("x").alias("key"), "x", F.col("own.vec_id").alias("ids"), F.col("own.n").alias("times")), "exact-vectors")


Grid = dict[int, tuple[np.ndarray, np.ndarray]]


def grid_of(exact: DataFrame) -> Grid:
    """For each length of vectors: least component and cell width of each dimension."""

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for d, at in _by_length(b.x):
                x = np.stack(list(b.x.iloc[at])) if d else np.zeros((len(at), 0))
                lo, hi = x.min(axis=0), x.max(axis=0)
                seen[d] = (np.minimum(lo, seen[d][0]), np.maximum(hi, seen[d][1])) if d in seen else (lo, hi)
        rows = [(d, i, lo[i], hi[i]) for d, (lo, hi) in seen.items() for i in range(d)]
        yield pd.DataFrame(rows, columns=["d", "i", "lo", "hi"])

    ends = exact.select("x").mapInPandas(spans, "d int, i int, lo double, hi double").groupBy("d", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out: Grid = {}
    for d, own in ends.toPandas().sort_values(["d", "i"]).groupby("d"):
        lo, hi = own.lo.to_numpy(), own.hi.to_numpy()
        out[int(d)] = lo, np.maximum(1.0, np.ceil(hi / CELLS - lo / CELLS + 1 / CELLS))
    return out


def _by_length(vectors: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    lengths = vectors.map(len).to_numpy(np.int64)
    for d in np.unique(lengths):
        yield int(d), np.flatnonzero(lengths == d)


def approximation_file(spark: SparkSession, exact: DataFrame, grid: Grid) -> DataFrame:
    """key, first and last of its ids, cells: a byte a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [b""] * b.num_rows
            xs = pd.Series([np.asarray(v) for v in b.column(3).to_pylist()], dtype=object)
            for d, at in _by_length(xs):
                if d:
                    lo, width = grid[d]
                    whole = np.clip(np.floor(np.stack(list(xs.iloc[at])) / width - lo / width), 0, CELLS - 1) if np.abs(lo).max() > SAFE else np.floor((np.stack(list(xs.iloc[at])) - lo) / width)
                    for i, row in zip(at, whole.astype(np.uint8), strict=True):
                        cells[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cells, pa.binary())], names=["key", "first_id", "last_id", "cells"])

    ends = exact.select("key", F.get("ids", F.lit(0)).alias("first_id"), F.element_at("ids", -1).alias("last_id"), "x")
    return written(spark, ends.mapInArrow(run, "key long, first_id long, last_id long, cells binary"), "approximation")


class Bounds:
    """Bounds of the inner products of one length of queries with cells: upper, and lower = upper - gap."""

    def __init__(self, q: np.ndarray, grid: tuple[np.ndarray, np.ndarray]):
        lo, width = grid
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = q * width
            reach = (np.abs(scaled) * CELLS).sum(axis=1)
            self.kind = np.float32 if not len(q) or reach.max(initial=0) < SINGLE else np.float64
            self.scaled = scaled.astype(self.kind)
            # cells of huge components may be one off by rounding
            off = 1.0 if np.abs(lo).max(initial=0) <= SAFE else 2.0
            self.base = (q * lo).sum(axis=1) + np.maximum(q, 0) @ (off * width - 1) + np.abs(q) @ ((off - 1) * width)
            error = (q.shape[1] + 4) * float(np.finfo(self.kind).eps) * reach + 1e-12 * (np.abs(q) @ np.abs(lo))
            self.gap = np.abs(q) @ ((2 * off - 1) * width - 1) + 2 * error
            self.base = self.base + error

    def upper(self, part: slice, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            out = (self.scaled[part] @ cells.T).astype(float) + self.base[part, None]
        return np.where(np.isnan(out), np.inf, out)


def candidates(spark: SparkSession, approximation: DataFrame, wave: Wave, k: int) -> DataFrame:
    """q, key, upper: what can be among the k best of query number q by the cells alone.

    Each task also hands on its k greatest lower bounds of each query (rows without a key); the kth of
    all tasks' is the floor that an upper bound must reach. Floors are a row a query, a wave at most.
    """
    sent = spark.sparkContext.broadcast(wave)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        best = np.full((len(own.ids), k), -np.inf)  # the k greatest lower bounds
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def pruned() -> pd.DataFrame:
            q, key, upper, lower = (np.concatenate([h[c] for h in held]) if held else np.zeros(0) for c in range(4))
            still = upper >= best[:, 0][q.astype(int)]
            held.clear()
            return pd.DataFrame({"q": q[still].astype("int32"), "key": pd.array(key[still], "Int64"), "upper": upper[still], "lower": lower[still]})

        def floors() -> pd.DataFrame:
            q, nth = np.nonzero(best > -np.inf)
            return pd.DataFrame({"q": q.astype("int32"), "key": pd.array([None] * len(q), "Int64"), "upper": np.nan, "lower": best[q, nth]})

        for b in batches:
            keys, firsts, lasts = (b[c].to_numpy(np.int64) for c in ("key", "first_id", "last_id"))
            for d, at in _by_length(b.cells):
                if d not in own.bounds:
                    continue
                numbers, bounds = own.bounds[d]
                cells = np.frombuffer(b"".join(b.cells.iloc[at]), np.uint8).reshape(len(at), d).astype(bounds.kind)
                alone = np.where(firsts[at] == lasts[at], firsts[at], np.int64(-1)), firsts[at] == lasts[at]
                for s in range(0, len(numbers), QUERY_BLOCK):
                    part = slice(s, s + QUERY_BLOCK)
                    some = numbers[part]
                    upper = bounds.upper(part, cells)
                    upper[(own.ids[some][:, None] == alone[0][None, :]) & alone[1][None, :]] = -np.inf
                    with np.errstate(invalid="ignore"):
                        lower = upper - bounds.gap[part, None]
                    lower[np.isnan(lower)] = -np.inf
                    top = np.partition(lower, -k, axis=1)[:, -k:] if lower.shape[1] > k else lower
                    best[some] = np.sort(np.concatenate([best[some], top], axis=1), axis=1)[:, -k:]
                    row, col = np.nonzero((upper >= best[some, 0][:, None]) & (upper > -np.inf))
                    held.append((some[row], keys[at][col], upper[row, col], lower[row, col]))
                    size += len(row)
                    if size > HELD:
                        yield pruned()
                        size = 0
        yield pruned()
        yield floors()

    found = written(spark, approximation.mapInPandas(run, "q int, key long, upper double, lower double"), "bounds")
    order = Window.partitionBy("q").orderBy(F.desc("lower"))
    floor = found.where("key IS NULL").withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select("q", F.col("lower").alias("floor"))
    near = found.where("key IS NOT NULL").join(F.broadcast(floor), "q", "left")
    return near.where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor"))).select("q", "key", "upper")


class Wave:
    """Queries that go together: ids, integer vectors, and bounds by length."""

    def __init__(self, queries: list, grid: Grid):
        self.ids = np.array([r["vec_id"] for r in queries], np.int64)
        self.x = [np.array(r["x"], float) for r in queries]
        self.bounds: dict[int, tuple[np.ndarray, Bounds]] = {}
        for d in sorted({len(x) for x in self.x}):
            numbers = np.array([i for i, x in enumerate(self.x) if len(x) == d], np.int64)
            self.bounds[d] = numbers, Bounds(np.stack([self.x[i] for i in numbers]) if d else np.zeros((len(numbers), 0)), grid.get(d, (np.zeros(0), np.ones(0))))


def _whole(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if not x.size or np.abs(x).max() < SAFE else np.array([int(v) for v in x], object)


def fetched(spark: SparkSession, exact: DataFrame, wanted: DataFrame, wave: Wave) -> DataFrame:
    """query_id, vec_id, score of the wanted (q, key), from their exact vectors."""
    sent = spark.sparkContext.broadcast((wave.ids, [_whole(x) for x in wave.x]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries = sent.value
        for b in batches:
            rows = []
            for q, x, own, times in zip(b.q, b.x, b.ids, b.times, strict=True):
                if len(x) == len(queries[q]):
                    score = max(-(1 << 63), min(int(_whole(np.asarray(x, float)) @ queries[q]) if len(x) else 0, (1 << 63) - 1))
                    rows += [(int(ids[q]), int(v), score) for v, n in zip(own, times, strict=True) if v != ids[q] for _ in range(n)]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return wanted.select("q", "key").join(exact, "key").select("q", "x", "ids", "times").mapInPandas(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(spark: SparkSession, exact: DataFrame, approximation: DataFrame, queries: list, grid: Grid, k: int) -> DataFrame:
    wave = Wave(queries, grid)
    rest, best, limit = written(spark, candidates(spark, approximation, wave, k), "candidates"), None, FIRST * k
    order = Window.partitionBy("q").orderBy(F.desc("upper"), "key")
    while True:
        placed = rest.withColumn("place", F.row_number().over(order))
        found = fetched(spark, exact, placed.where(F.col("place") <= limit), wave)
        best = written(spark, _ranked(found if best is None else best.drop("rank").unionByName(found), k), "best")
        kth = {r["query_id"]: r["score"] for r in best.where(F.col("rank") == k).select("query_id", "score").collect()}  # a wave at most
        reached = spark.createDataFrame([(i, kth.get(int(v))) for i, v in enumerate(wave.ids)], "q int, kth long")
        left = placed.where(F.col("place") > limit).join(F.broadcast(reached), "q").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth").cast("double")))
        rest = written(spark, left.select("q", "key", "upper"), "candidates-left")
        if rest.isEmpty():
            return best
        limit *= GROWTH


def search(spark: SparkSession, vectors: DataFrame, is_query: Column | None = None, k: int = 10, wave: int = WAVE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best by integer inner product of each query row against all other rows."""
    vectors = valid(vectors)
    queries = vectors.where(F.col("vec_id") % 100 == 0 if is_query is None else is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = queries.select("vec_id", integers(F.col("embedding")).alias("x"))
    exact = exact_file(spark, vectors, k)
    grid = grid_of(exact)
    approximation = approximation_file(spark, exact, grid)
    few = queries.limit(wave + 1).collect()
    if len(few) <= wave:
        return _searched(spark, exact, approximation, sorted(few, key=lambda r: r["vec_id"]), grid, k)
    queries = written(spark, queries, "queries")
    waves = -(-queries.count() // max(1, wave // 2))
    numbered = lambda w: queries.withColumn("wave", F.pmod(F.xxhash64("vec_id", F.lit(w)), F.lit(w)))
    while numbered(waves).groupBy("wave").count().agg(F.max("count")).first()[0] > wave:
        waves *= 2
    parts = [_searched(spark, exact, approximation, numbered(waves).where(F.col("wave") == i).orderBy("vec_id").collect(), grid, k) for i in range(waves)]
    return reduce(DataFrame.unionByName, parts)


#: The same for DuckDB, without approximation: every query against every vector.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 10
"""
