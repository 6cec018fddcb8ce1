"""Benchmark decontamination with suffix arrays over the training texts.

Each block of training texts becomes a shard: its words are numbered, and a suffix array over the words is built
by packing several words into one key and doubling from there, to the depth of the longest test item. Every suffix
of the test items is binary-searched in every shard; from each place found, the match is followed to its full
length. Matches are left-maximal verbatim runs (doc, word position, item, item position, number of words) of at
least `window` words, or of a whole item that is shorter. Numbering is exact (a dictionary of the words' bytes),
so a match needs no further check. A document lies in one shard, so nothing is shuffled.

The test items are broadcast in parts of about PART_BYTES, one part at a time: a larger benchmark means more passes
over the documents, whose results are written, and each part is gone before the next is read. The matches of a shard
are followed FOLLOWED at a time, so a passage that many items and many documents share takes time but no memory.

Defined cases: a null or empty text has no words and no match; an item without words matches nothing; rows with a
repeated doc_id are searched each on their own; rows with the same item_id are items of that one id; an item without
an id hits words but isn't listed or counted; extra columns may have any name; an empty table of documents gives no
rows, an empty benchmark no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._spark import tune, written

WINDOW = 10
PART_BYTES, FOLLOWED = 8 << 20, 1 << 20


class Words:
    """The words of texts: dense numbers from 1, the dictionary, and for each text the first of its words."""

    def __init__(self, texts: pa.Array):
        raw, offsets = X.buffers(texts)
        lowered = X.ALNUM[raw]
        inside = lowered != 0
        starts, ends, self.first = X.spans(inside, offsets)
        packed = lowered[inside]
        ends = np.concatenate([[0], np.cumsum(ends - starts)])
        large = ends[-1] >= 2**31
        words = pa.Array.from_buffers(pa.large_binary() if large else pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64 if large else np.int32)), pa.py_buffer(packed)])
        coded = words.dictionary_encode()
        self.ids, self.dictionary, self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, coded.dictionary, words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class Items:
    """Test items: for each suffix that starts a window, the item, the place, and how many words are left."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        words = Words(pa.array(texts, pa.string()))
        self.words, self.window = words.words, window
        self.ids, self.first = np.array(ids, dtype=object), words.first
        counts = words.counts
        keep = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
        self.item = np.repeat(np.arange(len(counts)), keep)
        self.place = np.arange(keep.sum()) - np.repeat(np.cumsum(keep) - keep, keep)
        self.least = np.minimum(window, counts[self.item])
        self.rest = counts[self.item] - self.place
        self.depth = int(counts.max(initial=0))


class Shard:
    """Suffix array over the words of a block of texts; the order of suffixes holds for their first `depth` words."""

    def __init__(self, texts: pa.Array, depth: int):
        words = Words(texts)
        self.dictionary, self.counts = words.dictionary, words.counts
        n = len(words.ids)
        texts_of = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(n) + texts_of  # a zero stands after each text
        self.x = np.zeros(n + len(self.counts) + depth + 2, np.int64)
        self.x[self.place] = words.ids
        self.text_at = np.concatenate([words.first[:-1] + np.arange(len(self.counts)), [n + len(self.counts)]])
        self.order = self._sorted(max(1, len(self.dictionary)).bit_length() + 1, depth)

    def _sorted(self, bits: int, depth: int) -> np.ndarray:
        x, at = self.x, self.place
        if not len(at):
            return at
        packed = min(max(1, 62 // bits), max(1, depth))
        key = x[at].copy()
        for k in range(1, packed):
            key <<= bits
            key |= x[np.minimum(at + k, len(x) - 1)]
        by = np.argsort(key)
        order, key = at[by], key[by]
        rank = np.zeros(len(x), np.int64)
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        rank[order] = heads + 1
        alone = fresh & np.concatenate([fresh[1:], [True]])
        slots = np.flatnonzero(~alone)
        done = packed
        while done < depth and len(slots):
            some = order[slots]
            key = rank[some] * (len(x) + 1) + rank[np.minimum(some + done, len(x) - 1)]
            by = np.argsort(key)
            order[slots], key = some[by], key[by]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            rank[order[slots]] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
            slots = slots[~(fresh & np.concatenate([fresh[1:], [True]]))]
            done *= 2
        return order

    def _bound(self, wanted: np.ndarray, least: np.ndarray, after: bool) -> np.ndarray:
        """For each row of wanted, how many suffixes are below it (after: or begin with it), by its first `least` words."""
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.order), np.int64)
        span = np.arange(wanted.shape[1])
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            have, want = self.x[np.minimum(self.order[mid][:, None] + span, len(self.x) - 1)], wanted[open_]
            differ = (have != want) & (span < least[open_][:, None])
            k = differ.argmax(1)
            rows = np.arange(len(open_))
            unequal = differ[rows, k]
            right = np.where(unequal, have[rows, k] < want[rows, k], after)
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]

    def matches(self, items: Items) -> Iterator[tuple[np.ndarray, ...]]:
        """Text, word position, item, item position and words of every left-maximal match, in runs of about FOLLOWED."""
        if not len(self.order) or not len(items.item):
            return
        found = pc.index_in(items.words, self.dictionary)
        ids = np.concatenate([found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1, np.zeros(items.window, np.int64)])
        ids[: len(found)][ids[: len(found)] == 0] = -1  # not a word of the shard
        start = items.first[items.item] + items.place
        span = np.arange(items.window)
        wanted = ids[start[:, None] + span]
        here = np.flatnonzero(~((wanted == -1) & (span < items.least[:, None])).any(1))
        lo = self._bound(wanted[here], items.least[here], False)
        many = self._bound(wanted[here], items.least[here], True) - lo
        runs = (np.cumsum(many) - many) // FOLLOWED
        for k in np.unique(runs[many > 0]):
            own = (runs == k) & (many > 0)
            yield self._followed(items, ids, start, here[own], lo[own], many[own])

    def _followed(self, items: Items, ids: np.ndarray, start: np.ndarray, here: np.ndarray, lo: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
        q = np.repeat(here, many)
        at = self.order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        left = (items.place[q] > 0) & (at > 0) & (self.x[np.maximum(at - 1, 0)] == ids[np.maximum(start[q] - 1, 0)])
        q, at = q[~left], at[~left]
        length, going = items.least[q].copy(), np.arange(len(q))
        while len(going):
            going = going[length[going] < items.rest[q[going]]]
            going = going[self.x[at[going] + length[going]] == ids[start[q[going]] + length[going]]]
            length[going] += 1
        text = np.searchsorted(self.text_at, at, side="right") - 1
        return text, at - self.text_at[text], items.item[q], items.place[q], length

    def hits(self, items: Items) -> tuple[list[set], list[list[tuple[int, int]]]]:
        """For each text, the items that match, and the runs of words that lie in a match."""
        found: list[set] = [set() for _ in self.counts]
        change = np.zeros(len(self.x) + 1, np.int64)
        for text, place, item, _, words in self.matches(items):
            for pair in np.unique(text * len(items.ids) + item).tolist():
                found[pair // len(items.ids)].add(items.ids[pair % len(items.ids)])
            np.add.at(change, self.text_at[text] + place, 1)
            np.add.at(change, self.text_at[text] + place + words, -1)
        edge = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8)]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a zero after each text parts their runs
        runs: list[list[tuple[int, int]]] = [[] for _ in self.counts]
        text = np.searchsorted(self.text_at, begin, side="right") - 1
        for t, a, b in zip(text.tolist(), (begin - self.text_at[text]).tolist(), (end - self.text_at[text]).tolist(), strict=True):
            runs[t].append((a, b))
        return found, runs


def n_parts(benchmark: DataFrame) -> int:
    return -(-max(1, benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // PART_BYTES)


def passes(benchmark: DataFrame, window: int, n: int) -> Iterator[Broadcast]:
    """The benchmark in n parts, each broadcast for as long as its pass lasts."""
    spark = benchmark.sparkSession
    for k in range(n):
        own = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else benchmark.select("item_id", "text")
        rows = own.collect()  # about PART_BYTES
        sent = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], window))
        yield sent
        if n > 1:
            sent.destroy()


def _shards(batches: Iterator[pa.RecordBatch], column: int, items: Items) -> Iterator[tuple[pa.RecordBatch, Shard]]:
    for block in X.blocks(batches, column):
        yield block, Shard(block.column(column), max(1, items.depth))


MATCHES = "doc_id long, doc_place long, item_id string, item_place long, n_words long"


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every left-maximal verbatim match: where it is in the document and in the item (from 0), and its words."""
    tune(docs.sparkSession)
    n, out = n_parts(benchmark), None
    for sent in passes(benchmark, window, n):

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for block, shard in _shards(batches, 1, items):
                for text, place, item, item_place, words in shard.matches(items):
                    ids = pa.array([None if x is None else str(x) for x in items.ids[item]], pa.string())
                    yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(text)), pa.array(place), ids, pa.array(item_place), pa.array(words)], names=[c.split()[0] for c in MATCHES.split(", ")])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATCHES)
        found = written(found, "matches") if n > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each item, the longest match over all shards and its first place."""
    best = F.max(F.struct("n_words", (-F.col("doc_id")).alias("d"), (-F.col("doc_place")).alias("p"), (-F.col("item_place")).alias("i"))).alias("m")
    return find_matches(docs, benchmark, window).groupBy("item_id").agg(best).select("item_id", F.col("m.n_words").alias("n_words"), (-F.col("m.d")).alias("doc_id"), (-F.col("m.p")).alias("doc_place"), (-F.col("m.i")).alias("item_place"))


RUNS = "array<struct<s:long,e:long>>"


def _hits(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """doc_id, key, n_words, items (ids as strings), runs of hit words of each row. Rows of one key have one text."""
    tune(docs.sparkSession)
    schema = f"doc_id long, key string, n_words long, items array<string>, runs {RUNS}"
    rows = docs.select(F.col("doc_id").cast("long"), F.md5("text").alias("key"), "text")
    n, every, more = n_parts(benchmark), None, None
    for sent in passes(benchmark, window, n):

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            for block, shard in _shards(batches, 2, sent.value):
                items, runs = shard.hits(sent.value)
                listed = pa.array([sorted({str(x) for x in own if x is not None}) for own in items], pa.list_(pa.string()))
                spans = pa.array([[{"s": a, "e": b} for a, b in own] for own in runs], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(shard.counts), listed, spans], names=["doc_id", "key", "n_words", "items", "runs"])

        found = rows.mapInArrow(run, schema)
        if n == 1:
            return found
        found = written(found, "hits")
        hit = found.where(F.size("runs") > 0).select("doc_id", "key", "items", "runs")
        every, more = (found, hit) if every is None else (every, more.unionByName(hit))
    merged = more.distinct().groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"))
    merged = merged.withColumnsRenamed({"doc_id": "__id", "key": "__key"})
    own = every.select("doc_id", "key", "n_words").join(merged, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    return own.select("doc_id", "key", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as sorted strings, comma-joined) of each document."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    more = lambda at, x: F.struct(F.greatest(at["upto"], x["e"]).alias("upto"), (at["n"] + F.greatest(x["e"] - F.greatest(x["s"], at["upto"]), F.lit(0))).alias("n"))
    n_hit = F.aggregate(F.array_sort("runs"), start, more, lambda at: at["n"])
    return _hits(docs, benchmark, window).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort("items"), ",").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, in all their columns."""
    tune(docs.sparkSession)
    n, column = n_parts(benchmark), docs.columns.index("text")
    if n > 1:
        hit = _hits(docs, benchmark, window).where(F.size("runs") > 0).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
        rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.md5("text").alias("key"))
        return rows.join(hit, F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left_anti").select("row.*")
    (sent,) = passes(benchmark, window, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, shard in _shards(batches, column, sent.value):
            clean = np.ones(block.num_rows, bool)
            for text, *_ in shard.matches(sent.value):
                clean[text] = False
            yield block.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op1(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB SQL for op1's rows.
OP1_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bench AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bench WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM low),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM pos, lens WHERE i + n - 1 <= len(w)),
hits AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.s = win.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT low.doc_id, len(low.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
