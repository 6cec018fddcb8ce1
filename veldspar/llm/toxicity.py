"""Toxicity by a counterfactual-regularised classifier.

A sparse logistic regression over the words of a text and their beginnings (log of 1 + count, over those that
enough training texts hold). Beside the labelled loss and an L1 penalty, it pays for counterfactuals: in sentences of labelled texts an
identity term is swapped for another one of its kind, and the squared change of the score's logit is penalised, so
that naming a group can't move the score. Sentences without an identity term get one put in place of a word, so that
every term takes part. The model is fitted in numpy on a bounded sample of labelled rows (labels' TRAIN_ROWS and
TRAIN_BYTES); each text is scored whole.

Defined cases: a null or empty text gets the score of a text without known words; rows that repeat a doc_id are
scored each; without labels of both kinds every score is the share of label 1, or 0.5 with no label at all.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._labels import TRAIN_ROWS, labelled_sample, remainder
from ._spark import tune
from .decontamination import Words

#: Identity terms by kind; one is swapped for another of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslims", "christians", "jews", "hindus", "musulmans", "chrétiens", "juden", "christen", "musulmanes", "cristianos"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "homosexual"),
    ("immigrants", "refugees", "citizens", "foreigners", "migrants", "flüchtlinge", "réfugiés", "inmigrantes"),
    ("disabled", "blind", "deaf", "old", "young", "elderly"),
)
#: Lengths of the beginnings of words that are features beside the words.
PREFIXES = (4, 5, 6)
#: Texts that are counted at a time.
PART = 250
LEAST_TEXTS, L1, SWAPS, SWAP_WEIGHT, STEPS = 8, 1.5e-3, 2000, 2.0, 120


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    bias: float


def features(words: pa.Array) -> list[pa.Array]:
    """Each word itself, and its beginnings (marked by ~), null where the word is no longer than that."""
    plain = words.cast(pa.string())
    length = pc.utf8_length(plain)
    out = [plain]
    for k in PREFIXES:
        start = pc.binary_join_element_wise(pc.utf8_slice_codeunits(plain, 0, k), "~", "")
        out.append(pc.if_else(pc.greater(length, k), start, pa.scalar(None, pa.string())))
    return out


def _pairs(texts: pa.Array, vocabulary: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, feature and count of the features that texts hold; the vocabulary is that of all if none is given."""
    words = Words(texts)
    made = features(words.dictionary)
    if vocabulary is None:
        vocabulary = pc.unique(pa.chunked_array(made)).drop_null()
    row = np.repeat(np.arange(len(texts)), words.counts)
    rows, columns = [], []
    for own in made:
        found = pc.index_in(own, vocabulary, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
        column = found[words.ids - 1].astype(np.int64) if len(words.ids) else np.zeros(0, np.int64)
        rows.append(row[column >= 0])
        columns.append(column[column >= 0])
    size = max(1, len(vocabulary))
    pair, many = np.unique(np.concatenate(rows) * np.int64(size) + np.concatenate(columns), return_counts=True)
    return pair // size, pair % size, many, vocabulary


def _parts(texts: pa.Array) -> list[tuple[int, pa.Array]]:
    """Runs of texts, so that what is held for them at a time is bounded."""
    return [(at, texts.slice(at, PART)) for at in range(0, len(texts), PART)]


def _counts(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and log(1 + count) of the vocabulary's features in texts."""
    rows, columns, values = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for at, part in _parts(texts):
        row, column, many, _ = _pairs(part, vocabulary)
        rows.append((row + at).astype(np.int32))
        columns.append(column.astype(np.int32))
        values.append(np.log1p(many).astype(np.float32))
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


def _frequent(texts: pa.Array) -> list[str]:
    """Features that LEAST_TEXTS of the texts hold, in order."""
    found = []
    for _, part in _parts(texts):
        _, column, _, vocabulary = _pairs(part, None)
        found.append(pa.table({"feature": vocabulary, "n": np.bincount(column, minlength=len(vocabulary))}))
    if not found:
        return []
    held = pa.concat_tables(found).group_by("feature").aggregate([("n", "sum")])
    return sorted(held.filter(pc.greater_equal(held["n_sum"], LEAST_TEXTS))["feature"].to_pylist())


def counterfactuals(texts: list[str], n: int = SWAPS, seed: int = 3) -> list[tuple[str, str]]:
    """Pairs of sentences of the texts that differ in one identity term, swapped for another of its kind."""
    rng = random.Random(seed)
    kind = {w: k for k, group in enumerate(IDENTITY) for w in group}
    out: list[tuple[str, str]] = []
    terms = [w for group in IDENTITY for w in group]
    for k in range(n if texts else 0):
        sentences = [s for s in rng.choice(texts).split(".") if s.strip()]
        if not sentences:
            continue
        tokens = rng.choice(sentences).split()
        at = [i for i, w in enumerate(tokens) if w.lower() in kind]
        if at:
            i = rng.choice(at)
        else:
            i = rng.randrange(len(tokens))
            tokens[i] = terms[k % len(terms)]
        other = rng.choice([w for w in IDENTITY[kind[tokens[i].lower()]] if w != tokens[i].lower()])
        out.append((" ".join(tokens), " ".join([*tokens[:i], other, *tokens[i + 1 :]])))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[str], labels: list[int], swap_weight: float = SWAP_WEIGHT) -> Model:
    """Accelerated proximal gradient on the mean log-loss + swap_weight * mean squared logit change + L1 * |w|."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Model([], np.zeros(0), float(np.log(share / (1 - share))))
    pairs = counterfactuals(texts)
    terms = {w for group in IDENTITY for w in group}
    array = pa.array(texts, pa.string())
    known = [w for w in _frequent(array) if w not in terms] + sorted(terms)
    vocabulary = pa.array(known, pa.string())
    row, column, value = _counts(array, vocabulary)
    ra, ca, va = _counts(pa.array([a for a, _ in pairs], pa.string()), vocabulary)
    rb, cb, vb = _counts(pa.array([b for _, b in pairs], pa.string()), vocabulary)
    dr, dc, dv = np.concatenate([ra, rb]), np.concatenate([ca, cb]), np.concatenate([va, -vb])
    m, d, n_pairs = len(texts), len(known), max(1, len(pairs))
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** 0.5
    balance /= balance.mean()
    w, bias, v, bias_v, t = np.zeros(d), 0.0, np.zeros(d), 0.0, 1.0
    norm = np.bincount(column, value**2, d).max() / m * 0.25 * balance.max() * 6 + swap_weight * 2 * (np.bincount(dc, dv**2, d).max(initial=0) / n_pairs) + 0.25
    step = 1 / norm
    for _ in range(STEPS):
        p = _sigmoid(np.bincount(row, value * v[column], m) + bias_v)
        slope = (p - y) * balance / m
        grad = np.bincount(column, value * slope[row], d)
        if len(pairs):
            change = np.bincount(dr, dv * v[dc], n_pairs)
            grad += swap_weight * 2 / n_pairs * np.bincount(dc, dv * change[dr], d)
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        new_bias = bias_v - step * slope.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, bias_v = new + (t - 1) / after * (new - w), new_bias + (t - 1) / after * (new_bias - bias)
        w, bias, t = new, new_bias, after
    held = np.flatnonzero(w)
    # L1 shrinks what it keeps: fit those few words anew under a light L2, with the same penalty on swaps
    w, bias = _refit(w, bias, held, (row, column, value), (dr, dc, dv), y, balance, n_pairs, swap_weight)
    return Model([known[i] for i in held], w[held], float(bias))


def _refit(w, bias, held, data, swaps, y, balance, n_pairs, swap_weight, steps=200, l2=1e-4):
    row, column, value = data
    dr, dc, dv = swaps
    own, swap_own = np.isin(column, held), np.isin(dc, held)
    row, column, value, dr, dc, dv = row[own], column[own], value[own], dr[swap_own], dc[swap_own], dv[swap_own]
    m, d, w = len(y), len(w), w.copy()
    moment, second = np.zeros(d + 1), np.zeros(d + 1)
    for k in range(1, steps + 1):
        slope = (_sigmoid(np.bincount(row, value * w[column], m) + bias) - y) * balance / m
        grad = np.bincount(column, value * slope[row], d) + l2 * w
        change = np.bincount(dr, dv * w[dc], n_pairs)
        grad += swap_weight * 2 / n_pairs * np.bincount(dc, dv * change[dr], d)
        grad = np.append(grad, slope.sum())
        moment, second = 0.9 * moment + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = 0.05 * (moment / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        w[held] -= move[:-1][held]
        bias -= move[-1]
    return w, bias


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    logit = np.full(len(texts), model.bias)
    if len(model.words):
        row, column, value = _counts(texts, pa.array(model.words, pa.string()))
        logit += np.bincount(row, value * model.weights[column], len(texts))
    return _sigmoid(logit)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    return fit(*labelled_sample(docs, labels, "toxic", 5, 0, rows))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row."""
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(score_texts(sent.value, block.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, in all their columns."""
    tune(docs.sparkSession)
    sent, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, column):
            yield block.filter(pa.array(score_texts(sent.value, block.column(column)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
