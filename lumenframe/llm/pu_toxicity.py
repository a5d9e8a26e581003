"""Toxicity: non-negative positive-unlabelled learning on words and their beginnings.

Confirmed toxic texts are the positives, texts drawn from the whole corpus are
unlabelled, and the class prior is estimated from all confirmed rows.  A text is
the set of its words and of their first three to six letters (languages that
compound put the telling stem first).  Features found in toxic texts far more often
than in the corpus enter the model; a text's score depends on which of them occur
anywhere in it, not on its length, so one passage in a long text is enough.

Null texts count as empty.  Rows with a null id are scored too.  Repeated rows give
repeated results.  Empty tables give empty results; without confirmed rows every
score is the prior (0.5 if there is none).  Other columns aren't read; keep() hands
them on, whatever their names, types and nulls.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import nnpu, pu_sample
from lumenframe.llm.common import held_out, written
from lumenframe.llm.pu_quality import filtered, scored

#: Bounds of the sample that the model is fitted on, and of its features.
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 8_000
MAX_FEATURES = 2_048
BUCKETS = 1 << 22
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.5
#: Twice the log-likelihood ratio that a feature must reach; by chance alone 24 is passed once in a million times.
LEAST_GAIN = 24.0
#: Words remembered by a Python worker.
MEMORY = 300_000
_STRIP = ".,;:!?\"'()[]{}<>$&%*#|-_/\\@~^`=+"


def word_features(word: str) -> tuple[int, ...]:
    """Buckets of the word and of its beginnings; lower case, without marks around it."""
    w = word.strip(_STRIP).lower()
    if not w:
        return ()
    out = [zlib.crc32(b"w" + w.encode("utf-8", "replace")) % BUCKETS]
    out += [zlib.crc32(b"p%d" % k + w[:k].encode("utf-8", "replace")) % BUCKETS for k in PREFIXES if len(w) > k]
    return tuple(out)


class _Words(dict):
    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        if len(self) >= MEMORY:
            self.clear()
        out = self[word] = self.of(word)
        return out


@dataclass
class ToxicityModel:
    buckets: np.ndarray  # sorted
    linear: nnpu.LinearModel
    _seen: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"buckets": self.buckets, "linear": self.linear, "_seen": {}}

    def _number(self, buckets: tuple[int, ...]) -> tuple[int, ...]:
        known = self._seen.get("known")
        if known is None:
            known = self._seen["known"] = {int(b): i for i, b in enumerate(self.buckets)}
        return tuple(known[b] for b in buckets if b in known)

    def scores(self, texts: list[str]) -> np.ndarray:
        words = self._seen.get("words")
        if words is None:
            words = self._seen["words"] = _Words(lambda w: self._number(word_features(w)))
        z, weights = np.zeros(len(texts)), self.linear.weights
        for i, text in enumerate(texts):
            found = set()
            for numbers in map(words.__getitem__, set(text.split())):
                if numbers:
                    found.update(numbers)
            if found:
                z[i] = weights[sorted(found)].sum()
        return self.linear.probability(z)


def _text_features(words: _Words, text: str) -> np.ndarray:
    found: set[int] = set()
    for f in map(words.__getitem__, set(text.split())):
        found.update(f)
    return np.sort(np.fromiter(found, np.int32, len(found)))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> ToxicityModel:
    """The rows' features are written once; their counts are added up by Spark, and the driver gets the chosen features and the rows narrowed to these."""
    spark = docs.sparkSession

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words(word_features)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "positive": b.positive, "unlabelled": b.unlabelled, "features": [_text_features(words, t or "").tobytes() for t in b.text]})

    rows = pu_sample.sample(docs, labels, column, max_positive, max_unlabelled)
    rows = written(spark, rows.mapInPandas(describe, "doc_id long, positive int, unlabelled int, features binary"), "features")
    chosen = _select(rows)

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            numbers = []
            for r in b.features:
                own = np.frombuffer(r, np.int32)
                at = np.minimum(np.searchsorted(chosen, own), max(0, len(chosen) - 1))
                numbers.append(at[chosen[at] == own].astype("<u2").tobytes() if len(chosen) else b"")
            yield pd.DataFrame({"doc_id": b.doc_id, "positive": b.positive, "unlabelled": b.unlabelled, "numbers": numbers})

    got = sorted(rows.mapInPandas(narrow, "doc_id long, positive int, unlabelled int, numbers binary").collect(), key=lambda r: r["doc_id"])
    p, u = (nnpu.SparseRows.of([np.frombuffer(r["numbers"], "<u2") for r in got if r[c]]) for c in ("positive", "unlabelled"))
    return ToxicityModel(chosen, nnpu.fit(p, u, len(chosen), pu_sample.class_prior(labels, column), l2=1e-3))


def _select(rows: DataFrame) -> np.ndarray:
    """Features whose share among positives exceeds that of the corpus by more than chance explains, MAX_FEATURES at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of = lambda flags: np.unique(np.frombuffer(b"".join(b.features[flags == 1]), np.int32), return_counts=True)  # noqa: B023, E731
            (p, in_p), (u, in_u) = of(b.positive), of(b.unlabelled)
            yield pd.DataFrame({"bucket": np.concatenate([p, u]), "in_p": np.concatenate([in_p, 0 * in_u]), "in_u": np.concatenate([0 * in_p, in_u])})

    n_p, n_u = (x or 0 for x in rows.agg(F.sum("positive"), F.sum("unlabelled")).first())
    if not n_p or not n_u:
        return np.zeros(0, np.int64)
    seen = rows.mapInPandas(count, "bucket int, in_p long, in_u long").groupBy("bucket").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u")).where("in_p >= 4")
    in_p, expected = F.col("in_p"), n_p * (F.col("in_u") + 0.5) / (n_u + 1)
    share = F.least(expected / n_p, F.lit(1 - 1e-9))
    rest = F.when(in_p < n_p, (n_p - in_p) * F.log((n_p - in_p) / (n_p * (1 - share)))).otherwise(0.0)
    good = seen.withColumn("gain", 2 * (in_p * F.log(in_p / expected) + rest)).where((in_p > 2 * expected) & (F.col("gain") > LEAST_GAIN))
    return np.sort(np.array([r["bucket"] for r in good.orderBy(F.desc("gain"), "bucket").limit(MAX_FEATURES).collect()], np.int64))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""
    return scored(docs, model.scores, threshold)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier lets pass, all columns as they were."""
    model = train(docs, labels)
    return filtered(docs, model.scores, lambda s: s < THRESHOLD)
