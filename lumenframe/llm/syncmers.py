"""Document fingerprints from closed syncmers, and their likeness.

A k-mer of code points is an anchor if the least of its inner s-mers, by hash, is
its first or its last.  Whether it is depends on the k-mer alone, so an edit moves or
removes only anchors that touch it.  A k-mer that occurs again counts as another
anchor, so repetition weighs by its length.  A fingerprint holds the SKETCH anchors of least
hash (all, of short texts) with their places; it is made from the whole text.
Likeness estimates the share of anchors that two texts have in common and in the same
order: of the least hashes of both sketches together, those that can be matched
in increasing places.

A text shorter than a k-mer is one anchor; an empty text (or null) has none, and two
texts without anchors are alike.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

K, S = 12, 6  # _anchors() has the window of K - S + 1 = 7 inner s-mers and the s-mer of 6 built in
SKETCH = 64
#: Text of one range of ids, on average, as long as there are no more than MAX_RANGES (the driver holds an id of each; beyond that ranges grow, and their sorts spill).
RANGE_BYTES, MAX_RANGES = 4 << 20, 1 << 15
#: Characters hashed at once; longer texts go in overlapping blocks.
BLOCK = 1 << 20
_POWER = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(S + 1)]
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the closed syncmers of at least K code points."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    two = h[:-1] * _POWER[1] + h[1:]
    four = two[:-2] * _POWER[2] + two[2:]
    six = four[:-2] * _POWER[2] + two[4:]
    smers = _finish(six.copy())
    low = np.minimum(smers[:-1], smers[1:])
    low = np.minimum(low[:-2], low[2:])
    low = np.minimum(low[:-3], low[3:])
    n = len(codes) - K + 1
    at = np.flatnonzero((smers[:n] == low) | (smers[K - S : K - S + n] == low))
    return _finish(six[at] * _POWER[S] + six[at + S]), at


def _numbered(h: np.ndarray) -> np.ndarray:
    """Hashes made distinct: the j-th occurrence of an anchor is an anchor of its own."""
    order = np.argsort(h, kind="stable")
    run = h[order]
    new = np.concatenate([[True], run[1:] != run[:-1]])
    if new.all():
        return h
    nth = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty_like(h)
    out[order] = np.where(nth == 0, run, _finish(run + nth.astype(np.uint64) * _MIX))
    return out


@dataclass(frozen=True)
class Fingerprint:
    hashes: tuple[int, ...]  # increasing
    places: tuple[int, ...]

    def __str__(self) -> str:
        return " ".join(f"{h:010x}@{p:x}" for p, h in sorted(zip(self.places, self.hashes, strict=True)))

    @staticmethod
    def parse(text: str) -> Fingerprint:
        pairs = sorted((int(h, 16), int(p, 16)) for h, p in (x.split("@") for x in text.split()))
        return Fingerprint(tuple(h for h, _ in pairs), tuple(p for _, p in pairs))


def fingerprint(text: str) -> Fingerprint:
    if not text:
        return Fingerprint((), ())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < K:
        whole = int.from_bytes(sha256(text.encode("utf-8", "surrogatepass")).digest()[:5], "big")
        return Fingerprint((whole,), (0,))
    found = [_anchors(codes[i : i + BLOCK + K - 1]) for i in range(0, len(codes) - K + 1, BLOCK)]
    hashes = _numbered(np.concatenate([h for h, _ in found])) >> np.uint64(24)
    places = np.concatenate([at + i * BLOCK for i, (_, at) in enumerate(found)])
    if len(hashes) > 4 * SKETCH:
        few = np.argpartition(hashes, 2 * SKETCH)[: 2 * SKETCH]
        few.sort()
        hashes, places = hashes[few], places[few]
    hashes, first = np.unique(hashes, return_index=True)
    return Fingerprint(tuple(hashes[:SKETCH].tolist()), tuple(places[first][:SKETCH].tolist()))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    if a.hashes == b.hashes:
        return 1.0
    of_a, of_b = dict(zip(a.hashes, a.places, strict=True)), dict(zip(b.hashes, b.places, strict=True))
    least = sorted(of_a.keys() | of_b.keys())
    if len(least) > SKETCH and (len(a.hashes) >= SKETCH or len(b.hashes) >= SKETCH):
        least = least[:SKETCH]
    shared = sorted((of_a[h], of_b[h]) for h in least if h in of_a and h in of_b)
    ends: list[int] = []
    for _, place in shared:
        at = bisect_left(ends, place)
        ends[at : at + 1] = [place]
    return len(ends) / len(least)


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the following text's first."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_neighbours(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and likenesses of every row.

    The next document is the next in ascending doc_id (null ids first, rows of one id
    by text), and the first follows the last.  Rows are dealt once into ranges of ids
    of about RANGE_BYTES of text, whose ends are quantiles; each range also gets the first row of the next range, so
    no task sees more than its range.  What the driver holds is one id per range.
    Repeated rows are neighbours of each other; a sole row is its own neighbour.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_RANGES, -(-size // RANGE_BYTES)))
    ends = np.unique(np.array(docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else [], np.float64))

    @F.pandas_udf(T.IntegerType())
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), -1, np.searchsorted(ends, ids.fillna(0).to_numpy(np.float64), side="right")).astype("int32"))

    ranged = docs.withColumn("part", range_of("doc_id"))
    heads = sorted((r["part"], r["first_id"]) for r in docs.select("doc_id").withColumn("part", range_of("doc_id")).groupBy("part").agg(F.min("doc_id").alias("first_id")).collect())
    schema = "head_part int, head_id long, to_part int"
    to = spark.createDataFrame([(p, i, heads[k - 1][0]) for k, (p, i) in enumerate(heads)], schema)
    tails = (
        ranged.where(F.col("doc_id").isNull() | F.col("doc_id").isin([i for _, i in heads if i is not None]))
        .join(F.broadcast(to), (F.col("part") == F.col("head_part")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
        .groupBy("to_part").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to_part").alias("part"), F.lit(1).alias("tail"))
    )
    rows = ranged.withColumn("tail", F.lit(0)).unionByName(tails)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for doc_id, text, tail in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                mark = fingerprint(text)
                if last is not None:
                    edited = edited_text(last[1], text)
                    edited_mark = last[2] if edited == last[1] else fingerprint(edited)
                    out.append((last[0], len(last[1]), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(last[2]), str(edited_mark), likeness(last[2], edited_mark), likeness(last[2], mark)))
                last = None if tail else (doc_id, text, mark)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(ARROW), ARROW.types, strict=True)], schema=ARROW)

    return rows.repartition(parts, "part").sortWithinPartitions(F.col("part"), F.col("tail"), F.col("doc_id").asc_nulls_first(), F.col("text")).select("doc_id", "text", "tail").mapInArrow(run, SCHEMA)
