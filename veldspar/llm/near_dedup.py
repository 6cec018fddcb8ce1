"""MinHash near-dedup by a chosen-path set similarity join.

A document's set holds the 64-bit hashes of its distinct shingles of `words` words. Documents with equal sets are
one vertex. In each of TREES independent trees, a vertex takes at each level the branch named by its minwise token
under that level's hash function, so that two sets of similarity J stay together for one level with probability J.
A node at level 1 that is small (in members and in shingles) is compared exhaustively; a large node is branched again,
down to DEPTH levels; a node still large there is compared in blocks of bounded size. With depth d and T trees, a pair is
missed with probability (1 - J^d)^T: 7e-12 for J = 0.8, d = 1 and T = 16.

Comparing goes in two rounds, so that a group of near copies doesn't give all its pairs:
1. in each node, each member with the node's smallest vertex; the links found give first components;
2. in nodes that still hold several components, members of different components with each other, from the most to
   the least alike and within the task that holds the node: only links are written, never pairs.
A pair is put forward if its sketches (128 bytes of minhashes, the path's own among them) agree in so many places
that a similar pair fails with probability below 1e-4, and if its sizes allow the similarity; then it is confirmed
on the full sets, recomputed from the whole texts: 100 * |A and B| >= threshold * |A or B|.

Components come from large-star and small-star steps over the links, each step a written table; nothing about all
documents reaches the driver. Hot groups: equal sets collapse by a partial aggregate before any pairing, and the classes and
stars that hold over 1/HOT of all rows (fewer than HOT of them) are broadcast or dealt out in parts. A task holds the
set of a star's centre and streams the rest, or the sets of one block.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; a text of fewer than
`words` words has its whole sequence as one shingle; equal rows get equal results, and rows that share a doc_id but
not a text get each the component of its own text; a row whose doc_id is null is linked with nothing and stays; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._spark import SIEVE, bitmap, drop_table, tune, written

WORDS, THRESHOLD = 4, 80
TREES, DEPTH, SKETCH = 16, 4, 128
#: Members of a node that is compared exhaustively, and the shingles in their sets altogether.
SMALL, SHINGLES = 1024, 8 << 20
#: A class of copies or a star that holds over 1/HOT of all rows (there are fewer than HOT of them) is dealt with apart.
HOT = 1000
#: Equal bytes of two sketches: 0.8 * 128 = 102.4, with a standard deviation of 4.5 for a pair at the threshold.
AGREE_DEVIATIONS = 3.8

_SEEDS = X.fmix(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES, _PLUS = _SEEDS[:SKETCH] | np.uint64(1), _SEEDS[SKETCH:]


def agreement(threshold: int) -> int:
    j = threshold / 100
    return int(np.floor(SKETCH * j - AGREE_DEVIATIONS * np.sqrt(SKETCH * j * (1 - j))))


class Sets:
    """Sorted distinct shingle hashes of the texts of a block."""

    def __init__(self, texts: pa.Array, words: int):
        h, offsets, _ = X.shingle_hashes(*X.buffers(texts), words)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            h[a:b].sort()
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        fresh[offsets[:-1][np.diff(offsets) > 0]] = True
        self.values = h[fresh]
        self.offsets = np.concatenate([[0], np.cumsum(fresh)])[offsets]

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.offsets[i] : self.offsets[i + 1]]

    def __len__(self) -> int:
        return len(self.offsets) - 1


def minhashes(sets: Sets) -> np.ndarray:
    """(texts, SKETCH) minima; all ones for an empty set. The texts go in runs of a bounded number of hashes."""
    out = np.full((len(sets), SKETCH), np.uint64(2**64 - 1))
    filled = np.flatnonzero(np.diff(sets.offsets) > 0)
    at = 0
    while at < len(filled):
        end = max(at + 1, int(np.searchsorted(sets.offsets[filled + 1], sets.offsets[filled[at]] + 32768, side="right")))
        own = filled[at:end]
        first = sets.offsets[own[0]]
        h, starts = sets.values[first : sets.offsets[own[-1] + 1]], sets.offsets[own] - first
        for k in range(SKETCH):
            out[own, k] = np.minimum.reduceat(h * _TIMES[k] + _PLUS[k], starts)
        at = end
    return out


SIGNATURE = "doc_id long, n long, h1 long, h2 long, sketch binary, " + ", ".join(f"p{d} array<long>" for d in range(1, DEPTH + 1))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Of each row: size and digest of its set, sketch, and the keys of its nodes by level, one for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, 1, 1 << 20):
            sets = Sets(block.column(1), words)
            sums = []
            for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                upto = np.concatenate([[np.uint64(0)], np.cumsum(X.fmix(sets.values ^ np.uint64(salt)))])
                sums.append((upto[sets.offsets[1:]] - upto[sets.offsets[:-1]]).view(np.int64))
            least = minhashes(sets)
            paths, key = [], np.zeros((len(sets), TREES), np.uint64) + np.arange(1, TREES + 1, dtype=np.uint64)
            for d in range(DEPTH):
                key = X.fmix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, d * TREES : (d + 1) * TREES])
                paths.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * TREES), pa.array(key.ravel().view(np.int64))))
            sketch = (least & np.uint64(255)).astype(np.uint8)
            held = pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH), pa.py_buffer(sketch.tobytes())])
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(sets.offsets)), *map(pa.array, sums), held, *paths], names=[c.strip().split()[0] for c in SIGNATURE.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNATURE)


def _sketches(column: pa.Array) -> np.ndarray:
    _, _, data = column.buffers()
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(data, np.uint8, SKETCH * len(column), first).reshape(-1, SKETCH)


def similar_pairs(pairs: DataFrame, vertices: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b), those whose sizes and sketches allow the similarity."""
    least = agreement(threshold)
    side = lambda x: vertices.select(F.col("v").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_sketches(batch.column(2)) == _sketches(batch.column(3))).sum(1) >= least
                yield batch.select([0, 1]).filter(pa.array(near))
        X.give_back()

    return sized.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], made: Callable[[pa.RecordBatch], list] | None = None) -> Iterator:
    """Runs of equal values in the first column, which the rows are sorted by; a run may go over batches. With made,
    also what it makes of each row, in place of the last column."""
    held: list[pa.RecordBatch] = []
    extra: list = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1 if len(keys) else []
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if b > a:
                if held and held[0].column(0)[0].as_py() != keys[a]:
                    yield (X.merged(held), extra) if made else X.merged(held)
                    held, extra = [], []
                part = batch.slice(a, b - a)
                if made:
                    extra += made(part)
                    part = part.select(range(part.num_columns - 1))
                held.append(part)
    if held:
        yield (X.merged(held), extra) if made else X.merged(held)


def _candidates(group: pa.RecordBatch, threshold: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """rows (key, v, c, n, part, sketch) of one node: for each member, the later members of other components whose
    sizes and sketches allow the similarity, and how far the sketches agree. In a node of two parts, only across them."""
    c, n, part = (group.column(k).to_numpy() for k in range(2, 5))
    sketch, two = _sketches(group.column(5)), part.min() != part.max()
    for i in range(len(c) - 1):
        j = np.flatnonzero((c[i + 1 :] != c[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= threshold * np.maximum(n[i + 1 :], n[i]))) + i + 1
        j = j[part[j] != part[i]] if two else j
        agree = (sketch[j] == sketch[i]).sum(1)
        near = agree >= least
        if near.any():
            yield i, j[near], agree[near]


NODE = "key long, v long, c long, n long, part int, sketch binary"


def node_members(rows: DataFrame, threshold: int) -> DataFrame:
    """Of the rows of nodes (key, v, c, n, part, sketch), those that have a candidate in their node. Pairs aren't written."""
    least = agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            held = np.zeros(group.num_rows, bool)
            for i, j, _ in _candidates(group, threshold, least):
                held[i] = held[j] = True
            if held.any():
                yield group.filter(pa.array(held))
        X.give_back()

    return rows.select("key", "v", "c", "n", F.col("part").cast("int").alias("part"), "sketch").repartition("key").sortWithinPartitions("key").mapInArrow(run, NODE)


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets are; exact."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(x) < threshold * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= threshold * (len(x) + len(y) - both)


def node_links(members: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """(a, b): links between components that the full sets of each node's members confirm. A node's candidates are
    taken from the most to the least alike, and a pair whose components a link has joined by then isn't looked at: what
    is written is at most one link less than the node has components. A node's sets are held, its texts are not."""
    least = agreement(threshold)

    def links(group: pa.RecordBatch, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        v, c = group.column(1).to_pylist(), group.column(2).to_pylist()
        pairs = [(np.full(len(j), i), j, agree) for i, j, agree in _candidates(group, threshold, least)]
        if not pairs:
            return []
        a, b, agree = (np.concatenate(x) for x in zip(*pairs, strict=True))
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = up[x]
            return x

        found = []
        for k in np.argsort(-agree, kind="stable"):
            i, j = int(a[k]), int(b[k])
            x, y = root(c[i]), root(c[j])
            if x != y and similar(sets[i], sets[j], threshold):
                up[x] = y
                found.append((v[i], v[j]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, sets in _groups(batches, lambda part: _own_sets(part.column(6), words)):
            found = links(group, sets)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
            del group, sets  # before the next node's are made
        X.give_back()

    sent = members.join(texts, "v").select("key", "v", "c", "n", "part", "sketch", "text").repartition("key").sortWithinPartitions("key")
    return sent.mapInArrow(run, "a long, b long")


def _own_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The set of each text, the texts taken a few at a time."""
    out: list[np.ndarray] = []
    for block in X.cut(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), 0, 1 << 20):
        sets = Sets(block.column(0), words)
        out += [sets[i].copy() for i in range(len(sets))]
    return out


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """Distinct pairs (a, b), texts (v, text) -> (a, b) of those that are similar on full sets.

    The pairs of one a make a star. A task goes through a star's texts with the set of a alone in memory. A star that
    holds over 1/HOT of the pairs is dealt out in parts of that size, with a in each."""
    total = pairs.count()
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") * HOT > total)
    hot = pairs.sparkSession.createDataFrame([(r[0], -(-r[1] * HOT // total)) for r in many.collect()], "a long, parts int")  # fewer than HOT rows
    parted = pairs.join(F.broadcast(hot), "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int"))
    rows = parted.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("v"))
    heads = parted.select("a", "part").distinct().select("a", "part", F.lit(0).alias("role"), F.col("a").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centres = None, []  # several where a doc_id repeats
        for batch in batches:
            a, part, role, v = (batch.column(k).to_pylist() for k in range(4))
            found = []
            for i, own in enumerate(_own_sets(batch.column(4), words)):
                if (a[i], part[i]) != star:
                    star, centres = (a[i], part[i]), []
                if role[i] == 0:
                    centres.append(own)
                elif any(similar(x, own, threshold) for x in centres):
                    found.append((a[i], v[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
        X.give_back()

    sent = rows.unionByName(heads).join(texts, "v").select("a", "part", "role", "v", "text").repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return sent.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(v, c) for each end v of links (a, b): c is the smallest end reachable. Large-star, then small-star, until nothing changes."""
    edges, last = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = written(small.distinct(), "edges")
        now = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        drop_table(edges)
        if now == last or not now[0]:
            break
        edges, last = after, now
    return after.select(F.col("a").alias("v"), F.col("b").alias("c")).unionByName(after.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())


def _keys(level: int) -> Column:
    return F.posexplode(f"p{level}").alias("tree", "key")


def _second_round(vertices: DataFrame, first: DataFrame, threshold: int) -> DataFrame:
    """Members of small nodes, and of the blocks of large ones, that have a candidate of another component there."""
    rows = vertices.select("v", "n", _keys(1)).join(first, "v", "left").select("tree", "key", "v", "n", F.coalesce("c", "v").alias("c"))
    out: list[DataFrame] = []
    for level in range(1, DEPTH + 1):
        mixed = rows.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key", "members", "shingles")
        rows = written(rows.join(mixed, "key"), f"level{level}")
        is_small = (F.col("members") <= SMALL) & (F.col("shingles") <= SHINGLES)
        out.append(rows.where(is_small).select("key", "v", "c", F.lit(0).alias("part")))
        large = rows.where(~is_small).drop("members", "shingles")
        if large.isEmpty():
            break
        if level == DEPTH:
            out.append(_blocks(large))
            break
        deeper = vertices.select("v", F.col(f"p{level + 1}").alias("p"))
        rows = large.join(deeper, "v").select("tree", F.element_at("p", F.col("tree") + 1).alias("key"), "v", "n", "c")
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return node_members(every.join(vertices.select("v", "n", "sketch"), "v"), threshold)


def _blocks(rows: DataFrame) -> DataFrame:
    """(key, v, c, part) of the blocks in which the members of large nodes (tree, key, v, n, c) are compared.

    Pairs inside a node's largest component need no comparing. Its members are dealt out in parts, the others' too, and
    a block holds one part of the others with one part of either: with few others, each member of a large component
    is in one block."""
    sizes = rows.groupBy("key", "c").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    top = sizes.groupBy("key").agg(F.max_by("c", F.struct("members", "c")).alias("most"))
    parts = lambda own: F.greatest(F.ceil(F.sum(F.when(own, F.col("members")).otherwise(0)) / (SMALL // 2)), F.ceil(F.sum(F.when(own, F.col("shingles")).otherwise(0)) / (SHINGLES // 2)), F.lit(1)).cast("int")
    is_most = F.col("c") == F.col("most")
    shape = written(sizes.join(top, "key").groupBy("key", "most").agg(parts(is_most).alias("whole"), parts(~is_most).alias("others")), "shapes")
    placed = rows.join(shape, "key").withColumn("own", F.pmod(F.xxhash64("v"), F.when(is_most, F.col("whole")).otherwise(F.col("others"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    most = placed.where(is_most).withColumn("with", F.explode(upto("others"))).select(F.xxhash64("key", F.lit(0), "own", "with").alias("key"), "v", "c", F.lit(0).alias("part"))
    across = placed.where(~is_most).withColumn("with", F.explode(upto("whole"))).select(F.xxhash64("key", F.lit(0), "with", "own").alias("key"), "v", "c", F.lit(1).alias("part"))
    inner = placed.where(~is_most).withColumn("with", F.explode(upto("others"))).select(F.xxhash64("key", F.lit(1), F.least("own", "with"), F.greatest("own", "with")).alias("key"), "v", "c", F.col("own").alias("part"))
    return most.unionByName(across).unionByName(inner)


def near_groups(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n (size of its set), component_id of each row."""
    tune(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(signatures(own, words), "signatures")
    filled = signed.where("n > 0 and doc_id is not null")
    classes = written(filled.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("v"), F.count("*").alias("copies")), "copies")
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    is_hot = F.col("copies") * HOT > total  # fewer than HOT classes
    hold = lambda c: F.when(F.col("doc_id") == F.col("v"), F.col(c)).alias(c)
    hot = classes.where(is_hot).select(*(F.col(c).alias(f"hot_{c}") for c in ("h1", "h2", "n", "v")))
    split = filled.join(F.broadcast(hot), (F.col("h1") == F.col("hot_h1")) & (F.col("h2") == F.col("hot_h2")) & (F.col("n") == F.col("hot_n")), "left")
    kept = lambda df: df.select("doc_id", "n", "v", *map(hold, ("sketch", *(f"p{d}" for d in range(1, DEPTH + 1)))))
    in_hot = kept(split.where("hot_v is not null").withColumn("v", F.col("hot_v")))
    rest = kept(split.where("hot_v is null").join(classes.where(~is_hot).drop("copies"), ["h1", "h2", "n"]))
    classed = written(in_hot.unionByName(rest), "classes")
    alone = written(signed.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id")), "alone")
    drop_table(signed)
    vertices = classed.where("doc_id = v").drop("doc_id")

    rows = vertices.select("v", _keys(1)).drop("tree")
    heads = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("v").alias("a")).where("members > 1").drop("members")
    stars = rows.join(heads, "key").where("v > a").select("a", F.col("v").alias("b")).distinct()
    near = written(similar_pairs(stars, vertices, threshold), "stars")
    links = written(_confirmed(near, own, words, threshold), "links")
    first = components(links)

    members = written(_second_round(vertices, first, threshold), "members")
    more = node_links(members, sifted(own, members.select("v")).withColumnRenamed("doc_id", "v"), words, threshold)
    final = components(first.where("v > c").select(F.col("v").alias("a"), F.col("c").alias("b")).unionByName(more))
    placed = classed.select("doc_id", "n", "v").join(final, "v", "left").select("doc_id", "n", F.coalesce("c", "v").alias("component_id"))
    return placed.unionByName(alone)


def _confirmed(pairs: DataFrame, own: DataFrame, words: int, threshold: int) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v")))
    return confirmed(pairs, sifted(own, wanted).withColumnRenamed("doc_id", "v"), words, threshold)


def sifted(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of own(doc_id, text) whose id may be among wanted(v), by a bitmap of SIEVE bits over the ids' hashes.

    The bitmap has a fixed size (4 MB, sent to the driver and broadcast whatever the input); it lets through all
    wanted ids and a share of others, which the join that follows leaves out. So texts that no pair needs aren't
    shuffled."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE)).cast("long")
    sent = own.sparkSession.sparkContext.broadcast(bitmap(wanted.select(place("v").alias("p"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).to_numpy()
            keep = (sent.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1
            yield batch.select([0, 1]).filter(pa.array(keep.astype(bool)))

    return own.where("doc_id is not null").select("doc_id", "text", place("doc_id")).mapInArrow(run, "doc_id long, text string")


def near_dedup(docs: DataFrame, words: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs, in all their columns, without those of a doc_id that isn't its component's smallest: one
    document of each group stays (with all its rows, if its doc_id repeats)."""
    gone = near_groups(docs, words, threshold).where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")


def op2(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: DuckDB SQL for op2's rows.
OP2_SQL = r"""
WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM low WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM inter JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS v, doc_id AS r FROM low UNION SELECT e.y, reach.r FROM reach JOIN e ON e.x = reach.v),
comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT low.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, c = low.doc_id AS kept
FROM low JOIN comp ON comp.v = low.doc_id LEFT JOIN n ON n.doc_id = low.doc_id
"""
