"""Quality by regularised quadratic discriminant analysis over document statistics.

Each text gives a row of statistics (size, word length, shares of letters, capitals, digits, symbols and line ends,
distinct words, repeats of words and of three-word runs), each transformed towards a bell shape. Per class, a mean
and a covariance are fitted, the covariance shrunk towards the pooled one and its diagonal; the Cholesky factors are
kept. score is the posterior of label 1 from the difference of the two Gaussian log-densities (Mahalanobis distance
and log-determinant) and the class shares. Fitted on a bounded sample of labelled rows; each text is scored whole.

Defined cases: a null text is an empty text, which has statistics of its own and is scored like any other; without
labels of both kinds every score is the share of label 1, or 0.5 with no label; rows that repeat a doc_id are
scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._labels import TRAIN_ROWS, labelled_sample, remainder
from ._spark import tune

THRESHOLD, SHRINK, TO_DIAGONAL, FLOOR = 0.3, 0.1, 0.1, 0.05


def _is(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_UPPER, _LOWER, _DIGIT = (_is(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))
_PLAIN, _SHOUT, _SYMBOL = _is(".,;:?'\"()-"), _is("!"), _is("#$%&*+/<=>@[\\]^_`{|}~")
_ABOVE = np.arange(256) >= 128


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, 14) transformed statistics."""
    raw, offsets = X.buffers(texts)
    sizes = np.maximum(np.diff(offsets), 1)

    def count(kind: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)])
        return upto[offsets[1:]] - upto[offsets[:-1]]

    upper, lower, above = count(_UPPER), count(_LOWER), count(_ABOVE)
    starts, ends, first = X.spans(~X.SPACE_MASK[raw], offsets)
    h = X.run_hashes(X.LOWER[raw], starts, ends)
    words = np.diff(first)
    row = np.repeat(np.arange(len(words)), words)
    some = np.maximum(words, 1)
    lengths = np.bincount(row, ends - starts, len(words)) / some
    distinct, most = _repeats(h, row, len(words))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    runs, run_offsets, _ = X.shingle_hashes(raw, offsets, 3)
    run_counts = np.diff(run_offsets)
    distinct_runs, _ = _repeats(runs, np.repeat(np.arange(len(words)), run_counts), len(words))
    share = lambda x, of: np.log((x / of + 0.002) / (1.002 - np.minimum(x / of, 1)))
    return np.stack(
        [
            np.log1p(words),
            np.log1p(lengths),
            share(upper + lower + above, sizes),
            share(upper, np.maximum(upper + lower, 1)),
            share(above, sizes),
            share(count(_DIGIT), sizes),
            share(count(_PLAIN), sizes),
            share(count(_SHOUT), sizes),
            share(count(_SYMBOL), sizes),
            share(count(_is("\n")), sizes),
            share(some - distinct, some),
            share(most, some),
            share(np.bincount(row, again, len(words)), some),
            share(run_counts - distinct_runs, np.maximum(run_counts, 1)),
        ],
        1,
    )


def _repeats(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct hashes each row has, and how often its most frequent one occurs."""
    h = h.copy()
    ends = np.searchsorted(row, np.arange(n + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    many = np.diff(np.append(at, len(h)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row[at], many)
    return np.bincount(row[at], minlength=n), most


@dataclass
class Model:
    """For each class: mean, inverse Cholesky factor of the shrunk covariance, and log share - log determinant / 2."""

    share: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    constants: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        z = [(x - m) @ f.T for m, f in zip(self.means, self.factors, strict=True)]
        logs = [c - 0.5 * (v * v).sum(1) for v, c in zip(z, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    y = np.asarray(y)
    least = x.shape[1] // 2
    if len(y) == 0 or (y == 1).sum() < least or (y == 0).sum() < least:
        return Model(float(y.mean()) if len(y) else 0.5)
    scale = x.std(0) + 1e-6
    own = [x[y == k] for k in (0, 1)]
    covariances = [np.cov(v, rowvar=False) for v in own]
    pooled = sum(len(v) * c for v, c in zip(own, covariances, strict=True)) / len(x)
    floor = np.diag((FLOOR * scale) ** 2)
    factors, constants = [], []
    for v, c in zip(own, covariances, strict=True):
        shrunk = (1 - SHRINK) * c + SHRINK * ((1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))) + floor
        factor = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(factor))
        constants.append(np.log(len(v) / len(x)) - np.log(np.diag(factor)).sum())
    return Model(float(y.mean()), np.array([v.mean(0) for v in own]), np.array(factors), np.array(constants))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    texts, y = labelled_sample(docs, labels, "quality", 5, 0, rows)
    parts = [statistics(pa.array(texts[at : at + 100], pa.string())) for at in range(0, len(texts), 100)]  # bounds the driver's memory
    return fit(np.concatenate(parts) if parts else np.zeros((0, 14)), np.array(y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row."""
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, 1, 4 << 20):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(sent.value.scores(statistics(block.column(1))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
