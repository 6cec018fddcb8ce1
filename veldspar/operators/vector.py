"""Vector search: exact k nearest neighbours, an inverted-file index, tuning, and the adaptive plan of filtered search.

Vectors are array columns; distances are native expressions over them in double precision. Lower is closer; ties go to
the smaller id. Top k is taken per partition before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions.series import safe

METRICS = ("l2", "cosine", "dot")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column | str, b: Column | str, metric: str = "l2") -> Column:
    """Squared Euclidean, 1 - cosine (1 for a zero vector) or minus the inner product."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric == "cosine":
        return 1 - safe(_dot(a, b), F.sqrt(_dot(a, a) * _dot(b, b)), F.lit(0.0))
    if metric == "dot":
        return -_dot(a, b)
    raise ValueError(f"no such metric: {metric}")


def as_vectors(df: DataFrame, id_: str, columns: Sequence[str]) -> DataFrame:
    """(id, embedding) from one column for each dimension."""
    return df.select(F.col(id_).alias("id"), F.array(*(F.col(c).cast("float") for c in columns)).alias("embedding"))


def _literal(query: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def check_dimension(vectors: DataFrame, query: Sequence[float]) -> None:
    first = vectors.select(F.size("embedding")).first()
    if first and first[0] != len(query):
        raise ValueError(f"the query has {len(query)} dimensions, the vectors {first[0]}")


def knn(vectors: DataFrame, query: Sequence[float], k: int, label: str | int = "*", metric: str = "l2", allowed: DataFrame | None = None) -> DataFrame:
    """(id, distance) of the k nearest of vectors(id, embedding[, label]); '*' is any label, allowed(id) a list of ids.
    The distance of l2 is reported as its root, after ranking."""
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    rows = vectors if label == "*" else vectors.where(F.col("label") == label)
    rows = rows if allowed is None else rows.join(allowed.select("id").distinct(), "id", "left_semi")
    top = rows.select("id", distance("embedding", _literal(query), metric).alias("__d")).orderBy("__d", "id").limit(k)
    return top.select("id", (F.sqrt("__d") if metric == "l2" else F.col("__d")).alias("distance"))


def series_windows(df: DataFrame, by: Sequence[str], order: str, value: str, size: int) -> DataFrame:
    """(by, start, embedding): each run of `size` values as a vector, for similarity search over series."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, size - 1)
    return df.select(*by, F.col(order).alias("start"), F.collect_list(F.col(value).cast("float")).over(w).alias("embedding")).where(F.size("embedding") == size)


# --- inverted file


@dataclass(frozen=True)
class Ivf:
    """Centroids (bounded by nlist), and the vectors with the cell of their nearest centroid."""

    centroids: np.ndarray
    cells: DataFrame
    metric: str = "l2"

    def probe(self, query: Sequence[float], nprobe: int) -> list[int]:
        d = ((self.centroids - np.asarray(query)) ** 2).sum(1)
        return [int(i) for i in np.lexsort((np.arange(len(d)), d))[:nprobe]]

    def search(self, query: Sequence[float], k: int, nprobe: int, label: str | int = "*", allowed: DataFrame | None = None) -> DataFrame:
        """Exact distances within the nprobe nearest cells; a filtered search doubles nprobe until k are found or all cells are read."""
        filtered = label != "*" or allowed is not None
        while True:
            found = knn(self.cells.where(F.col("cell").isin(self.probe(query, nprobe))), query, k, label, self.metric, allowed)
            if not filtered or nprobe >= len(self.centroids) or found.count() >= k:
                return found
            nprobe *= 2

    def write(self, path: str) -> None:
        self.cells.write.partitionBy("cell").parquet(path)


def build_ivf(vectors: DataFrame, nlist: int, metric: str = "l2", seed: int = 1, sample: int = 20_000, rounds: int = 25, restarts: int = 3) -> Ivf:
    """k-means in numpy over a sample of at most about `sample` vectors (a parameter), the best of `restarts` starts by
    the sum of squares; every vector gets a cell."""
    total = vectors.count()
    share = min(1.0, sample / max(1, total))
    picked = vectors if share == 1 else vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))
    x = np.array([r[0] for r in picked.select("embedding").orderBy("id").collect()], float)
    rng = np.random.default_rng(seed)
    tries = [_kmeans(x, min(nlist, len(x)), rng, rounds) for _ in range(restarts)]
    c = min(tries, key=lambda found: found[1])[0]
    return Ivf(c, vectors.withColumn("cell", F.array_min(_by_cell("embedding", c))["cell"]), metric)


def _kmeans(x: np.ndarray, nlist: int, rng: np.random.Generator, rounds: int) -> tuple[np.ndarray, float]:
    """Centroids from one k-means++ start, and their sum of squares."""
    centers, d = [x[rng.integers(len(x))]], np.full(len(x), np.inf)
    for _ in range(1, nlist):
        d = np.minimum(d, ((x - centers[-1]) ** 2).sum(1))
        centers.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centers)
    squares = lambda c: (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
    for _ in range(rounds):
        own = squares(c).argmin(1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return c, float(squares(c).min(1).sum())


def _by_cell(embedding: str, centroids: np.ndarray) -> Column:
    """An array with (d, cell) of each centroid."""
    return F.array(*(F.struct(distance(F.col(embedding), _literal(v)).alias("d"), F.lit(j).alias("cell")) for j, v in enumerate(centroids)))


def recall(exact: DataFrame, found: DataFrame) -> float:
    """Share of the exact ids that were found; both are of size k."""
    want = {r[0] for r in exact.select("id").collect()}
    return len(want & {r[0] for r in found.select("id").collect()}) / max(1, len(want))


def recalls(index: Ivf, queries: DataFrame, k: int) -> list[float]:
    """Mean recall at k of search() for nprobe 1, 2, ... over queries(id, embedding), against the exact neighbours. An
    exact neighbour is found just when its cell is probed, so one exact pass gives all of them."""
    from pyspark.sql import Window

    asked = queries.select(F.col("id").alias("__q"), F.col("embedding").alias("__e"), F.transform(F.array_sort(_by_cell("embedding", index.centroids)), lambda x: x["cell"]).alias("__order"))
    pairs = index.cells.select("id", "embedding", "cell").crossJoin(asked).select("__q", "id", F.array_position("__order", F.col("cell")).alias("probe"), distance("embedding", "__e", index.metric).alias("__d"))
    place = F.row_number().over(Window.partitionBy("__q").orderBy("__d", "id"))
    near = pairs.withColumn("__place", place).where(F.col("__place") <= k)
    counts = {r["probe"]: r["count"] for r in near.groupBy("probe").count().collect()}
    total = max(1, sum(counts.values()))
    return [sum(n for p, n in counts.items() if p <= nprobe) / total for nprobe in range(1, len(index.centroids) + 1)]


def enough_probes(index: Ivf, queries: DataFrame, k: int, target: float, least: int = 1) -> int:
    """The smallest nprobe, not under least, whose measured recall reaches target."""
    return next((n for n, x in enumerate(recalls(index, queries, k), 1) if n >= least and x >= target), len(index.centroids))


def tune_ivf(vectors: DataFrame, queries: DataFrame, k: int, nlists: Sequence[int], nprobes: Sequence[int], target: float) -> tuple[list[tuple], tuple]:
    """The curve (nlist, nprobe, recall, share of cells read) over queries(id, embedding), and the cheapest setting that
    reaches target, else the best."""
    curve = []
    for nlist in nlists:
        found = recalls(build_ivf(vectors, nlist), queries, k)
        curve += [(nlist, nprobe, found[nprobe - 1], nprobe / nlist) for nprobe in nprobes if nprobe <= len(found)]
    good = [x for x in curve if x[2] >= target]
    return curve, min(good, key=lambda x: (x[3], x[1])) if good else max(curve, key=lambda x: x[2])


# --- filtered search


@dataclass(frozen=True)
class Plan:
    strategy: str
    oversample: int


def adaptive_plan(matching: int, total: int, force_exact: bool = False, pre: float = 0.01, filtered: float = 0.20) -> Plan:
    """Exact if forced; without a real filter, search then filter; very selective filters first and exact; selective
    ones inside the index; the rest by oversampling 1.5 over the selectivity, from 1 to 64 times."""
    share = matching / total if total else 0.0
    if force_exact:
        return Plan("exact", 1)
    if share >= 1:
        return Plan("post_filter", 1)
    if share < pre:
        return Plan("pre_filter_exact", 1)
    oversample = min(64, max(1, math.ceil(1.5 / share)))
    return Plan("filtered_index", oversample) if share < filtered else Plan("oversample", oversample)


def ann(vectors: DataFrame, index: Ivf | None, query: Sequence[float], k: int, metric: str = "l2", allowed: DataFrame | None = None, strategy: str = "auto", nprobe: int = 8) -> DataFrame:
    """(id, distance): planned by the filter's selectivity, reranked by exact distances."""
    if strategy not in ("auto", "exact"):
        raise ValueError(f"no such strategy: {strategy}")
    total = vectors.count()
    matching = total if allowed is None else vectors.join(allowed.select("id").distinct(), "id", "left_semi").count()
    plan = adaptive_plan(matching, total, strategy == "exact" or index is None)
    if plan.strategy in ("exact", "pre_filter_exact"):
        return knn(vectors, query, k, metric=metric, allowed=allowed)
    if plan.strategy == "post_filter":
        return index.search(query, k, nprobe)
    return index.search(query, k, nprobe * (plan.oversample if plan.strategy == "oversample" else 1), allowed=allowed)


def ann_explain(vectors: DataFrame, index: Ivf | None, query: Sequence[float], k: int, allowed: DataFrame | None = None, nprobe: int = 8) -> DataFrame:
    """One row: total, matching, selectivity, strategy, oversample, k, returned, recall against the exact search."""
    total = vectors.count()
    matching = total if allowed is None else vectors.join(allowed.select("id").distinct(), "id", "left_semi").count()
    plan = adaptive_plan(matching, total, index is None)
    found = ann(vectors, index, query, k, allowed=allowed, nprobe=nprobe)
    row = (total, matching, matching / total if total else 0.0, plan.strategy, plan.oversample, k, found.count(), recall(knn(vectors, query, k, allowed=allowed), found))
    return vectors.sparkSession.createDataFrame([row], "total long, matching long, selectivity double, strategy string, oversample int, k int, returned long, recall double")


# --- governed embeddings


def active_embeddings(df: DataFrame, as_of: int | None = None, tenant: str | None = None) -> DataFrame:
    rows = df if as_of is None else df.where((F.col("effective_from") <= as_of) & (F.lit(as_of) < F.col("effective_to")))
    return rows if tenant is None else rows.where(F.col("tenant") == tenant)


def validate_embeddings(df: DataFrame, dimension: int) -> None:
    """Raises unless there are rows, of one model, version and metric, all of that dimension."""
    row = df.agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(c) for c in ("model", "version", "metric")), F.count(F.when(F.coalesce(F.size("embedding"), F.lit(-1)) != dimension, 1)).alias("odd")).first()
    if not row["n"]:
        raise ValueError("no embeddings")
    for c in ("model", "version", "metric"):
        if row[c] != 1:
            raise ValueError(f"{row[c]} values of {c}")
    if row["odd"]:
        raise ValueError(f"{row['odd']} embeddings aren't of dimension {dimension}")


def embedding_search(df: DataFrame, query: Sequence[float], k: int, tenant: str | None = None, as_of: int | None = None) -> DataFrame:
    """The k nearest of the embeddings in force for the tenant, with model and version."""
    rows = active_embeddings(df, as_of, tenant)
    top = rows.select("id", "model", "version", distance("embedding", _literal(query)).alias("__d")).orderBy("__d", "id").limit(k)
    return top.select("id", F.sqrt("__d").alias("distance"), "model", "version")
