"""Language ID by prediction by partial matching (PPM).

For each language, a context tree of bytes up to ORDER deep is counted on a bounded sample of its texts (A-Z
lowered). The statistics are frozen. In a context seen n times with d distinct next bytes, a byte seen c times costs
-log2(c / (n + d)) bits; any other costs the escape, -log2(d / (n + d)), and what it costs in the context one byte
shorter, down to 1/256 for each byte. The exact code length of a whole text under each language is the sum over its
bytes; the shortest wins. All costs are laid out in one table with a row for each context that any language has seen
(a row holds the costs of every byte under every language), so scoring is two lookups for each byte.

score is the winner's share when each language's code length, taken a byte, is turned into a likelihood of
SCORE_BYTES bytes. Defined cases: a null text, or one without a letter, is `und` with score 0; without any training
text all are `und`; rows that repeat a doc_id are scored each; null langs are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._labels import TRAIN_BYTES, remainder
from ._spark import tune

ORDER = 3
#: About how many texts of each language the statistics come from, fewer (LEAST or more) where there are over LANGUAGES
#: languages, and how many of the shortest texts where a language has none of up to TRAIN_BYTES.
TEXTS, LANGUAGES, LEAST, SHORTEST = 400, 200, 20, 4
SCORE_BYTES = 20


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # byte -> column
    rows: np.ndarray  # packed context of ORDER symbols -> row of costs
    costs: np.ndarray  # (rows, columns, languages) bits


def _packed(raw: np.ndarray, offsets: np.ndarray, symbol: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: the ORDER symbols before it, packed, and its own symbol. Column 0 stands before a text."""
    s = symbol[raw].astype(np.int64)
    context = np.zeros(len(s), np.int64)
    place = np.arange(len(s)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(ORDER, 0, -1):
        before = np.zeros(len(s), np.int64)
        before[k:] = s[:-k] if k < len(s) else 0
        context = context * columns + np.where(place >= k, before, 0)
    return context, s


def fit(texts: dict[str, list[str]]) -> Model:
    languages = sorted(texts)
    held = {k: X.buffers(pa.array(v, pa.string())) for k, v in texts.items()}
    seen = np.zeros(256, bool)
    for raw, _ in held.values():
        seen[np.unique(X.LOWER[raw])] = True
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(seen.sum()) + 2  # 0: before the text, 1: a byte never seen
    symbol[~seen] = 1
    symbol = symbol[X.LOWER]
    columns = int(seen.sum()) + 2
    coded = {k: _packed(raw, offsets, symbol, columns) for k, (raw, offsets) in held.items()}
    contexts = [np.zeros(1, np.int64)]  # by order; order 0 has one
    for order in range(1, ORDER + 1):
        contexts.append(np.unique(np.concatenate([c % columns**order for c, _ in coded.values()])) if coded else np.zeros(0, np.int64))
    if not coded:
        return Model([], symbol, np.zeros(1, np.int32), np.zeros((1, columns, 0), np.float32))
    made, starts, costs = [], [], np.full((1, columns, len(languages)), 8.0)
    for order, own in enumerate(contexts):
        if order:  # begin with what the context one byte shorter costs
            costs = costs[np.searchsorted(contexts[order - 1], own % columns ** (order - 1))]
        for k, name in enumerate(languages):
            context, s = coded[name]
            pair, many = np.unique(np.searchsorted(own, context % columns**order) * columns + s, return_counts=True)
            row, column = pair // columns, pair % columns
            n, d = np.bincount(row, many, len(own)), np.bincount(row, minlength=len(own))
            known = n > 0
            costs[known, :, k] += np.log2((n + d)[known] / d[known])[:, None]
            costs[row, column, k] = np.log2((n + d)[row] / many)
        starts.append(sum(map(len, made)))
        made.append(costs.astype(np.float32))
    # a context takes the row of its longest suffix that any language has seen
    packed = np.arange(columns**ORDER)
    rows = np.zeros(len(packed), np.int32)
    for order in range(1, ORDER + 1):
        suffix = packed % columns**order
        at = np.minimum(np.searchsorted(contexts[order], suffix), len(contexts[order]) - 1)
        has = contexts[order][at] == suffix
        rows[has] = starts[order] + at[has]
    return Model(languages, symbol, rows, np.concatenate(made))


def code_lengths(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) bits, and the number of bytes of each text."""
    raw, offsets = X.buffers(texts)
    columns = model.costs.shape[1]
    context, s = _packed(raw, offsets, model.symbol, columns)
    flat = model.costs.reshape(-1, len(model.languages))
    out = np.zeros((len(texts), len(model.languages)))
    sizes = np.diff(offsets)
    filled = np.flatnonzero(sizes > 0)
    if len(filled):
        at = model.rows[context].astype(np.int64) * columns + s
        for k in range(len(model.languages)):
            out[filled, k] = np.add.reduceat(flat[at, k], offsets[filled], dtype=np.float64)
    return out, sizes


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not model.languages or not len(texts):
        return names, scores
    bits, sizes = code_lengths(model, texts)
    best = bits.argmin(1)
    rate = bits / np.maximum(sizes, 1)[:, None]
    share = 1 / np.exp2((rate.min(1)[:, None] - rate) * SCORE_BYTES).sum(1)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    raw, offsets = X.buffers(texts)
    letters = np.concatenate([[0], np.cumsum(ascii_letter[raw])])[offsets]
    for i in range(len(texts)):
        if letters[i + 1] > letters[i] or (sizes[i] and any(c.isalpha() for c in texts[i].as_py())):
            names[i], scores[i] = model.languages[best[i]], share[i]
    return names, scores


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = TEXTS) -> Model:
    """About per_language texts of each language, picked by a hash of doc_id; every language with a text is learned, one
    without a text of up to TRAIN_BYTES from its SHORTEST ones, whole."""
    every = docs.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0) & (remainder("doc_id", 4) != 2)).select("doc_id", F.col(lang).alias("__lang"), F.col(text).alias("__text"), F.octet_length(text).alias("__size"))
    usable = every.where(F.col("__size") <= TRAIN_BYTES)
    found = [tuple(r) for r in every.groupBy("__lang").agg(F.count(F.when(F.col("__size") <= TRAIN_BYTES, 1)).alias("count")).collect()]
    if not found:
        return fit({})
    wanted = per_language if len(found) <= LANGUAGES else max(LEAST, per_language * LANGUAGES // len(found))
    counts = docs.sparkSession.createDataFrame(found, "__lang string, count long")
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    got = usable.withColumn("__place", place).join(F.broadcast(counts), "__lang").where(F.col("__place") * F.col("count") < wanted).select("__lang", "__text").collect()
    missing = {k for k, _ in found} - {r[0] for r in got}
    if missing:
        from pyspark.sql import Window

        nth = F.row_number().over(Window.partitionBy("__lang").orderBy("__size", F.xxhash64("__text")))
        few = every.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in sorted(missing)], "__lang string")), "__lang")
        got += few.withColumn("__nth", nth).where(F.col("__nth") <= SHORTEST).select("__lang", "__text").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r[0], r[1])):
        texts.setdefault(r[0], []).append(r[1])
    return fit(texts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, 1, 1 << 20):
            names, scores = predict(sent.value, block.column(1))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs)).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
