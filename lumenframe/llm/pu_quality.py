"""Quality classifier: non-negative positive-unlabelled learning on statistics of the text.

Trusted good texts are the positives, texts drawn from the whole corpus are
unlabelled, and the class prior is estimated from all trusted rows.  A text is
described by statistics of its characters and words; each statistic is cut into
intervals at quantiles of the training rows, so the model is additive and may be
non-linear in each.  The model (intervals and weights, of fixed size) is the only
thing that leaves the driver.

Null texts count as empty.  Rows with a null id are scored too.  Repeated rows give
repeated results.  Empty tables give empty results; without trusted rows every
score is the prior (0.5 if there is none).  Other columns aren't read; keep() hands
them on, whatever their names, types and nulls.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import nnpu, pu_sample
from lumenframe.llm.common import beside, held_out

#: Bounds of the sample that the model is fitted on.
MAX_POSITIVE = 12_000
MAX_UNLABELLED = 12_000
INTERVALS = 16
THRESHOLD = 0.3

#: Characters whose shares are features, each alone; then classes of bytes.
SINGLE = b"$&%*#|!?.,;:'\"-_/@<>(){}[]=+~^\\`"
_CLASS = np.full(256, 6, np.uint8)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = 5 if _i >= 128 else 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit() else 3 if _c == "\n" else 4 if _c.isspace() else 6
for _k, _i in enumerate(SINGLE):
    _CLASS[_i] = 7 + _k
N_CLASSES = 7 + len(SINGLE)
N_STATS = N_CLASSES + 7


def statistics(text: str) -> np.ndarray:
    """Shares of character classes, and how words repeat; of the whole text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros(N_STATS)
    size = max(1, len(raw))
    out[:N_CLASSES] = np.bincount(_CLASS[raw], minlength=N_CLASSES) / size
    words = text.split()
    n = max(1, len(words))
    out[N_CLASSES] = np.log1p(len(words))
    out[N_CLASSES + 1] = np.log1p(size)
    out[N_CLASSES + 2] = size / n
    out[N_CLASSES + 3] = len(set(words)) / n
    out[N_CLASSES + 4] = len(set(words)) / n**0.8
    out[N_CLASSES + 5] = sum(map(operator.eq, words, islice(words, 1, None))) / n
    out[N_CLASSES + 6] = len(set(words)) / n > 0.05
    return out


@dataclass(frozen=True)
class QualityModel:
    edges: np.ndarray  # N_STATS x (INTERVALS - 1)
    linear: nnpu.LinearModel

    def indices(self, stats: np.ndarray) -> np.ndarray:
        """rows x N_STATS feature numbers."""
        out = np.empty(stats.shape, np.int64)
        for j in range(N_STATS):
            out[:, j] = np.searchsorted(self.edges[j], stats[:, j], side="left") + j * INTERVALS
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        stats = np.stack([statistics(t) for t in texts])
        return self.linear.probability(self.linear.weights[self.indices(stats)].sum(axis=1))


def _edges(stats: np.ndarray) -> np.ndarray:
    """Quantiles, denser towards both ends: what spoils a text is often rare."""
    at = np.concatenate([[0.005, 0.02, 0.05], np.linspace(0.1, 0.9, INTERVALS - 7), [0.95, 0.98, 0.995]])
    return np.quantile(stats, at, axis=0).T if len(stats) else np.zeros((N_STATS, INTERVALS - 1))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> QualityModel:
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "positive": b.positive, "unlabelled": b.unlabelled, "stats": [statistics(t or "") for t in b.text]})

    rows = pu_sample.sample(docs, labels, column, max_positive, max_unlabelled)
    got = rows.mapInPandas(describe, "doc_id long, positive int, unlabelled int, stats array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    stats = np.stack(list(got.stats)) if len(got) else np.zeros((0, N_STATS))
    model = QualityModel(_edges(stats[got.unlabelled.to_numpy() == 1]), nnpu.LinearModel(np.zeros(N_STATS * INTERVALS), 0.0))
    numbers = model.indices(stats)
    p, u = (nnpu.SparseRows.of(list(numbers[got[c].to_numpy() == 1])) for c in ("positive", "unlabelled"))
    return QualityModel(model.edges, nnpu.fit(p, u, N_STATS * INTERVALS, pu_sample.class_prior(labels, column), l2=1e-4))


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""
    return scored(docs, model.scores, threshold)


def scored(docs: DataFrame, scores: Callable[[list[str]], np.ndarray], threshold: float) -> DataFrame:
    def work(texts: list[str]) -> dict:
        s = scores(texts)
        return {"score": s, "predicted": (s >= threshold).astype("int32")}

    return beside(docs, ["doc_id"], "text", work, {"score": "double", "predicted": "int"})


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, all columns as they were."""
    model = train(docs, labels)
    return filtered(docs, model.scores, lambda s: s >= THRESHOLD)


def filtered(docs: DataFrame, scores: Callable[[list[str]], np.ndarray], accept: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rows whose scores are accepted, in one pass over the rows and without a join; no value of theirs is changed."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(accept(scores([t or "" for t in b.column(at).to_pylist()])), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
