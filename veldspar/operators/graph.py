"""Temporal graphs: edges (src, dst, edge_type, valid_from, valid_to), in force while valid_from <= t < valid_to.

Traversals are loops of joins. What a loop keeps from step to step is written to the cluster's shared folder, so a
lost executor costs no earlier step; the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.sources.shared import written

from .temporal import active_at


class BudgetExceeded(RuntimeError):
    """A traversal would go over its limit of hops, edges, frontier or rows."""


def neighbors(edges: DataFrame, src: int, t: int) -> DataFrame:
    """Out-edges of src in force at t, in (valid_from, valid_to, dst) order."""
    return active_at(edges.where(F.col("src") == src), t).orderBy("valid_from", "valid_to", "dst")


def batch_neighbors(edges: DataFrame, sources: DataFrame, t: int) -> DataFrame:
    """Edges in force at t out of the ids in sources(src)."""
    return active_at(edges, t).join(sources.select("src").distinct(), "src", "left_semi")


def transpose(edges: DataFrame) -> DataFrame:
    swapped = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    return edges.select(*(swapped.get(c, F.col(c)) for c in edges.columns))


def khop(
    edges: DataFrame, seeds: DataFrame, k: int, t: int, keep: Column | None = None, once: bool = True,
    max_hops: int | None = None, max_edges: int | None = None, max_frontier: int | None = None, max_rows: int | None = None, cancelled: Callable[[], bool] = lambda: False,
) -> DataFrame:
    """(hop, dst) breadth first from seeds(id). once: a node is reached at its first hop only, and never a seed; else
    nodes are distinct within a hop. keep is a condition on edges. A limit that would be passed raises BudgetExceeded."""
    if max_hops is not None and k > max_hops:
        raise BudgetExceeded(f"{k} hops")
    live = active_at(edges, t)
    live = written((live.where(keep) if keep is not None else live).select("src", "dst"), "edges")
    frontier = written(seeds.select(F.col("id").alias("dst")).distinct(), "hop")
    out, seen, n_edges, n_rows = frontier.select(F.lit(0).alias("hop"), "dst").where(F.lit(False)), frontier, 0, 0
    for hop in range(1, k + 1):
        if cancelled():
            raise BudgetExceeded("cancelled")
        step = frontier.select(F.col("dst").alias("src")).join(live, "src")
        if max_edges is not None:
            n_edges += step.count()
            if n_edges > max_edges:
                raise BudgetExceeded(f"{n_edges} edges")
        found = step.select("dst").distinct()
        frontier = written(found.join(seen, "dst", "left_anti") if once else found, "hop")
        n = frontier.count()
        n_rows += n
        if max_frontier is not None and n > max_frontier or max_rows is not None and n_rows > max_rows:
            raise BudgetExceeded(f"{n} nodes at hop {hop}, {n_rows} in all")
        if not n:
            break
        out = out.unionByName(frontier.select(F.lit(hop).alias("hop"), "dst"))
        seen = seen.unionByName(frontier)
    return out


def degree_stats(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, max_degree)."""
    degrees = edges.groupBy("src").count()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().agg(F.count("*").alias("n_nodes"))
    return nodes.crossJoin(degrees.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_edges"), F.coalesce(F.max("count"), F.lit(0)).alias("max_degree")))


def degree_histogram(edges: DataFrame) -> DataFrame:
    """(bucket, n): nodes with out-edges by floor(log2(degree))."""
    return edges.groupBy("src").count().groupBy(F.floor(F.log2("count")).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


# --- patterns


def match(
    edges: DataFrame, pattern: Sequence[tuple[int, int]], t: int, types: Sequence[int | None] | None = None, before: Sequence[tuple[int, int]] | None = None,
    start: int | None = None, span: int | None = None, event_types: Sequence[int] | None = None, distinct: bool = True,
    max_rows: int | None = None, cancelled: Callable[[], bool] = lambda: False,
) -> DataFrame:
    """Rows v0, v1, ... of all ways to lay the pattern's edges (pairs of variables) on edges in force at t.

    before: pairs of pattern edges of which the first must begin earlier (default: each earlier than the next). types
    fixes edge types; start fixes v0; span limits latest less earliest valid_from; event_types is the sequence of types
    in order of time; distinct: no two variables are one node. Edges join one by one on the variables known by then,
    with the time order and distinctness as conditions of each join. With max_rows each step is written, and one of more
    rows raises BudgetExceeded, as does cancelled() before a step."""
    live = active_at(edges, t).select("src", "dst", "edge_type", "valid_from")
    before = [(i, i + 1) for i in range(len(pattern) - 1)] if before is None else before
    out, known = None, []
    for i, (a, b) in enumerate(pattern):
        if cancelled():
            raise BudgetExceeded("cancelled")
        e = live if not types or types[i] is None else live.where(F.col("edge_type") == types[i])
        if start is not None:
            e = e.where(F.col("src") == start) if a == 0 else e
        e = e.select(F.col("src").alias(f"__s{i}"), F.col("dst").alias(f"__d{i}"), F.col("valid_from").alias(f"__t{i}"), F.col("edge_type").alias(f"__y{i}"))
        on = [F.col(f"__t{x}") < F.col(f"__t{y}") for x, y in before if i in (x, y) and max(x, y) == i]
        new = []
        for v, c in ((a, f"__s{i}"), (b, f"__d{i}")):
            if v in known:
                on.append(F.col(f"v{v}") == F.col(c))
            else:
                new.append((v, c))
        if distinct:
            on += [F.col(f"v{w}") != F.col(c) for v, c in new for w in known]
            if len(new) == 2:
                e = e.where(F.col(f"__s{i}") != F.col(f"__d{i}"))
        if out is None:
            out = e
        else:
            cond = on[0]
            for x in on[1:]:
                cond = cond & x
            out = out.join(e, cond)
        for v, c in new:
            out = out.withColumn(f"v{v}", F.col(c))
            known.append(v)
        out = out.drop(f"__s{i}", f"__d{i}")
        if max_rows is not None:
            out = written(out, "match")
            if (n := out.count()) > max_rows:
                raise BudgetExceeded(f"{n} rows after edge {i}")
    times = [F.col(f"__t{i}") for i in range(len(pattern))]
    if span is not None and len(times) > 1:
        out = out.where(F.greatest(*times) - F.least(*times) <= span)
    if event_types is not None:
        in_time = F.transform(F.array_sort(F.array(*(F.struct(F.col(f"__t{i}").alias("t"), F.col(f"__y{i}").alias("y")) for i in range(len(pattern))))), lambda x: x["y"])
        out = out.where(in_time == F.array(*(F.lit(y).cast("int") for y in event_types)))
    return out.select(*(f"v{v}" for v in sorted(known)))


def path(edges: DataFrame, length: int, t: int, **more) -> DataFrame:
    return match(edges, [(i, i + 1) for i in range(length)], t, **more)


def diamond(edges: DataFrame, t: int, **more) -> DataFrame:
    """v0 -> v1 -> v3 and v0 -> v2 -> v3, each arm in time order."""
    return match(edges, [(0, 1), (1, 3), (0, 2), (2, 3)], t, before=[(0, 1), (2, 3)], **more)


def ring(edges: DataFrame, length: int, t: int, **more) -> DataFrame:
    return match(edges, [(i, (i + 1) % length) for i in range(length)], t, **more)


def wash_trades(edges: DataFrame, t: int, limit: int = 10_000) -> DataFrame:
    """(a, b, c) of rings of three, the first `limit` in order of (a, b, c): a report of bounded size."""
    return ring(edges, 3, t).toDF("a", "b", "c").orderBy("a", "b", "c").limit(limit)


def apply_delta(edges: DataFrame, inserts: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Edges without the exact edges of tombstones, with the inserts, each once."""
    return edges.join(tombstones.select(*edges.columns), edges.columns, "left_anti").unionByName(inserts).distinct()
