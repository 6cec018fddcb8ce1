"""JN, GR and VEC rows: temporal lookups, graphs and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import graph as G
from veldspar.operators import temporal as J
from veldspar.operators import vector as V

from ._base import Query, nanos, r, rs, table

DAY = 86400 * 10**9
T = "epoch_us(ts) * 1000"


def _sides(spark, d):
    e = table(spark, d, "events").withColumn("t", nanos("ts"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'click'").select("user_id", F.col("t").alias("rt"), F.col("value").alias("price"), (F.col("value") * 0.1).alias("spread"), F.col("event_id").alias("seq"))
    return left, right


SIDES = f"WITH l AS (SELECT event_id, user_id, {T} AS t FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, {T} AS rt, value AS price, value * 0.1::DOUBLE AS spread FROM events WHERE event_type = 'click')"
ASOF = SIDES + " SELECT event_id, rt AS matched_time, price FROM l ASOF LEFT JOIN q ON l.user_id = q.user_id AND l.t >= q.rt"
TOLERANCE = 6 * 3600 * 10**9


def _asof(spark, d, **more):
    left, right = _sides(spark, d)
    return J.asof_join(left, right, "t", "rt", ["price", "spread"], ["user_id"], seq="seq", **more).select("event_id", "matched_time", "price")


def _unkeyed(spark, d):
    left, right = _sides(spark, d)
    return J.asof_join(left.drop("user_id"), right.drop("user_id"), "t", "rt", ["price"], seq="seq", chunk=DAY).select("event_id", "matched_time", "price")


def _validity(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    ends = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ship"))
    return o.join(ends, "o_orderkey").select("o_orderkey", nanos("o_orderdate").alias("valid_from"), (nanos("o_orderdate") + 60 * DAY).alias("valid_to"))


VALID = f"WITH v AS (SELECT o_orderkey, epoch_us(o_orderdate) * 1000 AS valid_from, epoch_us(o_orderdate) * 1000 + {60 * DAY} AS valid_to FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"
AT = 883612800 * 10**9


def _versions(spark, d):
    """Orders as a bitemporal table: three system versions, the later ones with later ends."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", nanos("o_orderdate").alias("valid_from"))
    return o.withColumn("system_from", F.explode(F.array(*(F.lit(x).cast("long") for x in (100, 200, 300))))).withColumn("valid_to", F.col("valid_from") + F.col("system_from") * DAY)


def _overlaps(versions):
    return J.bitemporal_overlaps(J.to_bitemporal(versions.where("system_from = 100").drop("system_from"), 5, 6), "o_custkey", "o_orderkey")


VERSIONS = f"WITH b AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) * 1000 AS valid_from, s AS system_from, epoch_us(o_orderdate) * 1000 + s * {DAY} AS valid_to FROM orders, (VALUES (100), (200), (300)) x(s))"


def _edges(spark, d):
    """Users in order of their events: an edge from each event's user to the next event's, of the event's type, for two days."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("src"), nanos("ts").alias("valid_from"), (F.length("event_type") % 4).cast("int").alias("edge_type"), F.pmod(F.col("event_id") * 7919 + F.col("user_id") * 31, F.lit(150)).alias("dst"))
    return e.select("src", "dst", "edge_type", "valid_from", (F.col("valid_from") + DAY // 2).alias("valid_to"))


EDGES = f"edges AS (SELECT user_id AS src, (event_id * 7919 + user_id * 31) % 150 AS dst, (length(event_type) % 4)::INT AS edge_type, {T} AS valid_from, {T} + {DAY // 2} AS valid_to FROM events)"
NOW = 1704067200 * 10**9 + 5 * DAY
LIVE = EDGES + f", live AS (SELECT * FROM edges WHERE valid_from <= {NOW} AND {NOW} < valid_to)"


def _seeds(spark):
    return spark.createDataFrame([(8,), (46,)], "id long")


KHOP = f"WITH RECURSIVE {LIVE}, walk AS (SELECT 0 AS hop, v AS dst FROM (VALUES (8::BIGINT), (46::BIGINT)) s(v) UNION SELECT hop + 1, live.dst FROM walk JOIN live ON live.src = walk.dst WHERE hop < 3)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


QUERY = [((i * 37) % 17 - 8) / 40 for i in range(64)]
QSQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in QUERY) + "]"
DIST = {"l2": f"list_distance(embedding::DOUBLE[], {QSQL})", "cosine": f"1 - list_cosine_similarity(embedding::DOUBLE[], {QSQL})", "dot": f"-list_inner_product(embedding::DOUBLE[], {QSQL})"}


def _asked(spark, d):
    return _vectors(spark, d).where("id % 50 = 0")


def _probe(spark, d):
    """From 3 cells up, as many as the recall needs."""
    index = V.build_ivf(_vectors(spark, d), 8)
    return index.search(QUERY, 10, V.enough_probes(index, _asked(spark, d), 10, 0.9, 3)).select("id", r("distance").alias("distance"))


def _knn(metric: str, label: str | int = "*", where: str = "true") -> Query:
    def run(spark, d):
        allowed = None if where == "true" else _vectors(spark, d).where(where.replace("vec_id", "id")).select("id")
        return V.knn(_vectors(spark, d), QUERY, 10, label, metric, allowed).select("id", r("distance").alias("distance"))

    cond = where + ("" if label == "*" else f" AND label = {label}")
    return run, f"SELECT id, {rs('d')} AS distance FROM (SELECT vec_id AS id, {DIST[metric]} AS d FROM embeddings WHERE {cond} ORDER BY d, id LIMIT 10)"


def _governed(spark, d):
    return _vectors(spark, d).select("*", F.lit("m").alias("model"), F.lit(1).alias("version"), F.lit("l2").alias("metric"), (F.col("id") % 50).alias("effective_from"), (F.col("id") % 50 + 20).alias("effective_to"), F.concat(F.lit("t"), F.col("id") % 2).alias("tenant"))


def _windows(spark, d):
    s = V.series_windows(table(spark, d, "events").where("event_type = 'click'"), ["event_type"], "event_id", "value", 8)
    return V.knn(s.withColumnRenamed("start", "id"), [50.0] * 8, 5).select("id", r("distance", 4).alias("distance"))


QUERIES: dict[str, Query] = {
    "JN01_asof": (_asof, ASOF),
    "JN01_asof_unkeyed": (_unkeyed, SIDES + " SELECT event_id, rt AS matched_time, price FROM l ASOF LEFT JOIN q ON l.t >= q.rt"),
    "JN02_asof_tolerance": (
        lambda spark, d: _asof(spark, d, tolerance=TOLERANCE).withColumn("price", r("price")),
        SIDES + f" SELECT event_id, CASE WHEN t - rt <= {TOLERANCE} THEN rt END AS matched_time, CASE WHEN t - rt <= {TOLERANCE} THEN {rs('price')} END AS price FROM l ASOF LEFT JOIN q ON l.user_id = q.user_id AND l.t >= q.rt",
    ),
    "JN03_asof_sorted": (_asof, ASOF),
    "JN04_asof_unsorted": (lambda spark, d: J.asof_join(_sides(spark, d)[0].orderBy(F.rand(3)), _sides(spark, d)[1], "t", "rt", ["price"], ["user_id"], seq="seq", chunk=DAY).select("event_id", "matched_time", "price"), ASOF),
    "JN05_aj_whole": (
        lambda spark, d: _asof(spark, d).agg(F.count("*").alias("n"), F.count("price").alias("matched"), r(F.sum("price"), 2).alias("total")),
        SIDES + f" SELECT count(*) AS n, count(price) AS matched, {rs('sum(price)', 2)} AS total FROM l ASOF LEFT JOIN q ON l.user_id = q.user_id AND l.t >= q.rt",
    ),
    "JN06_point_in_time": (
        lambda spark, d: J.point_in_time(_validity(spark, d), AT),
        VALID + f" SELECT * FROM (SELECT row_number() OVER (ORDER BY valid_from, valid_to) - 1 AS idx, valid_from, valid_to FROM v) WHERE valid_from <= {AT} AND {AT} < valid_to",
    ),
    "JN07_active_at": (lambda spark, d: J.active_at(_validity(spark, d), AT), VALID + f" SELECT * FROM v WHERE valid_from <= {AT} AND {AT} < valid_to"),
    "JN08_key_slice": (lambda spark, d: J.key_slice(table(spark, d, "orders"), "o_orderkey", 100, 200).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200"),
    "JN09_snapshot": (lambda spark, d: J.snapshot_as_of(_versions(spark, d), 250, "system_from"), VERSIONS + " SELECT * FROM b WHERE system_from = 200"),
    "JN10_as_of": (lambda spark, d: J.as_of(_versions(spark, d), AT, 250), VERSIONS + f" SELECT * FROM b WHERE system_from = 200 AND valid_from <= {AT} AND {AT} < valid_to"),
    "JN11_overlaps": (
        lambda spark, d: _overlaps(_versions(spark, d)),
        VERSIONS + " SELECT x.o_custkey, x.o_orderkey AS a, y.o_orderkey AS b FROM b x JOIN b y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.valid_from < y.valid_to AND y.valid_from < x.valid_to WHERE x.system_from = 100 AND y.system_from = 100",
    ),
    "JN13_commit_as_of": (lambda spark, d: J.commit_as_of(_versions(spark, d), 399, "system_from").groupBy("system_from").count(), VERSIONS + " SELECT system_from, count(*) AS count FROM b WHERE system_from = 300 GROUP BY 1"),
    "JN12_to_bitemporal": (
        lambda spark, d: J.to_bitemporal(_validity(spark, d), 5, 6).select("o_orderkey", "business_valid_to", "system_from", "system_to", "event_ts", "ingest_ts", F.col("business_date").cast("string").alias("business_date")),
        VALID + f" SELECT o_orderkey, valid_to AS business_valid_to, 5::BIGINT AS system_from, {2**63 - 1} AS system_to, valid_from AS event_ts, 6::BIGINT AS ingest_ts, strftime(make_timestamp(valid_from // 1000), '%Y-%m-%d') AS business_date FROM v",
    ),
    "GR01_neighbors": (lambda spark, d: G.neighbors(_edges(spark, d), 8, NOW), f"WITH {LIVE} SELECT * FROM live WHERE src = 8"),
    "GR02_batch_neighbors": (lambda spark, d: G.batch_neighbors(_edges(spark, d), _seeds(spark).withColumnRenamed("id", "src"), NOW), f"WITH {LIVE} SELECT * FROM live WHERE src IN (8, 46)"),
    "GR03_khop": (lambda spark, d: G.khop(_edges(spark, d), _seeds(spark), 3, NOW), KHOP + " SELECT min(hop)::INT AS hop, dst FROM walk GROUP BY dst HAVING min(hop) > 0"),
    "GR04_khop_unbounded": (lambda spark, d: G.khop(_edges(spark, d), _seeds(spark), 3, NOW, once=False), KHOP + " SELECT DISTINCT hop::INT AS hop, dst FROM walk WHERE hop > 0"),
    "GR05_khop_transposed": (
        lambda spark, d: G.khop(G.transpose(_edges(spark, d)), _seeds(spark), 2, NOW),
        f"WITH RECURSIVE {LIVE}, walk AS (SELECT 0 AS hop, v AS dst FROM (VALUES (8::BIGINT), (46::BIGINT)) s(v) UNION SELECT hop + 1, live.src FROM walk JOIN live ON live.dst = walk.dst WHERE hop < 2) SELECT min(hop)::INT AS hop, dst FROM walk GROUP BY dst HAVING min(hop) > 0",
    ),
    "GR06_khop_budget": (lambda spark, d: G.khop(_edges(spark, d), _seeds(spark), 3, NOW, max_hops=5, max_edges=10**9, max_frontier=10**6, max_rows=10**6), KHOP + " SELECT min(hop)::INT AS hop, dst FROM walk GROUP BY dst HAVING min(hop) > 0"),
    "GR07_khop_filtered": (lambda spark, d: G.khop(_edges(spark, d), _seeds(spark), 3, NOW, keep=F.col("edge_type") == 1), KHOP.replace("WHERE hop < 3", "WHERE hop < 3 AND edge_type = 1") + " SELECT min(hop)::INT AS hop, dst FROM walk GROUP BY dst HAVING min(hop) > 0"),
    "GR08_transpose": (lambda spark, d: G.transpose(_edges(spark, d)), f"WITH {EDGES} SELECT dst AS src, src AS dst, edge_type, valid_from, valid_to FROM edges"),
    "GR09_degree_stats": (lambda spark, d: G.degree_stats(_edges(spark, d)), f"WITH {EDGES} SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS n_nodes, count(*) AS n_edges, (SELECT max(c) FROM (SELECT count(*) AS c FROM edges GROUP BY src)) AS max_degree FROM edges"),
    "GR09_degree_histogram": (lambda spark, d: G.degree_histogram(_edges(spark, d)), f"WITH {EDGES} SELECT floor(log2(c))::INT AS bucket, count(*) AS n FROM (SELECT count(*) AS c FROM edges GROUP BY src) GROUP BY 1"),
    "GR10_path": (
        lambda spark, d: G.path(_edges(spark, d), 3, NOW),
        f"WITH {LIVE} SELECT a.src AS v0, a.dst AS v1, b.dst AS v2, c.dst AS v3 FROM live a JOIN live b ON b.src = a.dst AND a.valid_from < b.valid_from JOIN live c ON c.src = b.dst AND b.valid_from < c.valid_from WHERE a.src <> a.dst AND b.dst NOT IN (a.src, a.dst) AND c.dst NOT IN (a.src, a.dst, b.dst)",
    ),
    "GR11_diamond": (
        lambda spark, d: G.diamond(_edges(spark, d), NOW),
        f"WITH {LIVE} SELECT a.src AS v0, a.dst AS v1, c.dst AS v2, b.dst AS v3 FROM live a JOIN live b ON b.src = a.dst AND a.valid_from < b.valid_from JOIN live c ON c.src = a.src JOIN live e ON e.src = c.dst AND e.dst = b.dst AND c.valid_from < e.valid_from WHERE a.src <> a.dst AND b.dst NOT IN (a.src, a.dst) AND c.dst NOT IN (a.src, a.dst, b.dst)",
    ),
    "GR12_ring": (
        lambda spark, d: G.ring(_edges(spark, d), 4, NOW),
        f"WITH {LIVE} SELECT a.src AS v0, a.dst AS v1, b.dst AS v2, c.dst AS v3 FROM live a JOIN live b ON b.src = a.dst AND a.valid_from < b.valid_from JOIN live c ON c.src = b.dst AND b.valid_from < c.valid_from JOIN live e ON e.src = c.dst AND e.dst = a.src AND c.valid_from < e.valid_from WHERE a.src <> a.dst AND b.dst NOT IN (a.src, a.dst) AND c.dst NOT IN (a.src, a.dst, b.dst)",
    ),
    "GR13_wash_trades": (
        lambda spark, d: G.wash_trades(_edges(spark, d), NOW),
        f"WITH {LIVE} SELECT a.src AS a, a.dst AS b, b.dst AS c FROM live a JOIN live b ON b.src = a.dst AND a.valid_from < b.valid_from JOIN live c ON c.src = b.dst AND c.dst = a.src AND b.valid_from < c.valid_from WHERE a.src <> a.dst AND b.dst NOT IN (a.src, a.dst) ORDER BY ALL LIMIT 10000",
    ),
    "GR14_wash_other_table": (
        lambda spark, d: G.wash_trades(G.transpose(_edges(spark, d)), NOW, 50),
        f"WITH {LIVE}, x AS (SELECT dst AS src, src AS dst, valid_from FROM live) SELECT a.src AS a, a.dst AS b, b.dst AS c FROM x a JOIN x b ON b.src = a.dst AND a.valid_from < b.valid_from JOIN x c ON c.src = b.dst AND c.dst = a.src AND b.valid_from < c.valid_from WHERE a.src <> a.dst AND b.dst NOT IN (a.src, a.dst) ORDER BY ALL LIMIT 50",
    ),
    "GR15_typed_path": (
        lambda spark, d: G.path(_edges(spark, d), 2, NOW, types=[1, None]),
        f"WITH {LIVE} SELECT a.src AS v0, a.dst AS v1, b.dst AS v2 FROM live a JOIN live b ON b.src = a.dst AND a.valid_from < b.valid_from WHERE a.edge_type = 1 AND a.src <> a.dst AND b.dst NOT IN (a.src, a.dst)",
    ),
    "GR16_anchored_path": (
        lambda spark, d: G.path(_edges(spark, d), 2, NOW, start=8),
        f"WITH {LIVE} SELECT a.src AS v0, a.dst AS v1, b.dst AS v2 FROM live a JOIN live b ON b.src = a.dst AND a.valid_from < b.valid_from WHERE a.src = 8 AND a.src <> a.dst AND b.dst NOT IN (a.src, a.dst)",
    ),
    "GR17_windowed_motif": (
        lambda spark, d: G.path(_edges(spark, d), 2, NOW, span=DAY // 8, event_types=[1, 2]),
        f"WITH {LIVE} SELECT a.src AS v0, a.dst AS v1, b.dst AS v2 FROM live a JOIN live b ON b.src = a.dst AND a.valid_from < b.valid_from WHERE a.edge_type = 1 AND b.edge_type = 2 AND b.valid_from - a.valid_from <= {DAY // 8} AND a.src <> a.dst AND b.dst NOT IN (a.src, a.dst)",
    ),
    "GR18_bounded_match": (
        lambda spark, d: G.match(_edges(spark, d), [(0, 1), (1, 2)], NOW, [1, None], max_rows=10**6),
        f"WITH {LIVE} SELECT a.src AS v0, a.dst AS v1, b.dst AS v2 FROM live a JOIN live b ON b.src = a.dst AND a.valid_from < b.valid_from WHERE a.edge_type = 1 AND a.src <> a.dst AND b.dst NOT IN (a.src, a.dst)",
    ),
    "GR19_delta": (
        lambda spark, d: G.apply_delta(_edges(spark, d), G.transpose(_edges(spark, d)).where("src < 5"), _edges(spark, d).where("edge_type = 2")),
        f"WITH {EDGES} SELECT * FROM edges WHERE edge_type <> 2 UNION SELECT dst, src, edge_type, valid_from, valid_to FROM edges WHERE dst < 5",
    ),
    "VEC01_knn": _knn("l2"),
    "VEC01_knn_label": _knn("l2", 3),
    "VEC02_cosine": _knn("cosine"),
    "VEC02_dot": _knn("dot"),
    "VEC03_as_vectors": (
        lambda spark, d: V.knn(V.as_vectors(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"]), [25.0, 1000.0], 5).select("id", r("distance", 3).alias("distance")),
        f"SELECT id, {rs('d', 3)} AS distance FROM (SELECT p_partkey AS id, list_distance([p_size::FLOAT::DOUBLE, p_retailprice::FLOAT::DOUBLE], [25.0::DOUBLE, 1000.0::DOUBLE]) AS d FROM part ORDER BY d, id LIMIT 5)",
    ),
    "VEC04_masked_knn": _knn("l2", "*", "vec_id % 3 = 1"),
    "VEC05_flat": _knn("l2"),
    "VEC06_ivf_all_cells": (lambda spark, d: V.build_ivf(_vectors(spark, d), 8).search(QUERY, 10, 8).select("id", r("distance").alias("distance")), _knn("l2")[1]),
    "VEC06_ivf_probe": (_probe, None),
    "VEC08_ivf_tuning": (lambda spark, d: spark.createDataFrame(V.tune_ivf(_vectors(spark, d), _asked(spark, d), 10, [8], range(1, 9), 0.9)[0], "nlist int, nprobe int, recall double, cost double"), None),
    "VEC09_ann": (lambda spark, d: V.ann(_vectors(spark, d), V.build_ivf(_vectors(spark, d), 8), QUERY, 5, allowed=_vectors(spark, d).where("id < 4").select("id")).select("id", r("distance").alias("distance")), _knn("l2", "*", "vec_id < 4")[1].replace("LIMIT 10", "LIMIT 5")),
    "VEC11_ann_explain": (lambda spark, d: V.ann_explain(_vectors(spark, d), None, QUERY, 5).select("total", "matching", "strategy", "returned", "recall"), "SELECT count(*) AS total, count(*) AS matching, 'exact' AS strategy, 5 AS returned, 1.0::DOUBLE AS recall FROM embeddings"),
    "VEC12_embedding_search": (
        lambda spark, d: V.embedding_search(_governed(spark, d), QUERY, 10, "t1", 30).select("id", r("distance").alias("distance"), "model", "version"),
        f"SELECT id, {rs('d')} AS distance, 'm' AS model, 1 AS version FROM (SELECT vec_id AS id, {DIST['l2']} AS d FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 50 <= 30 AND 30 < vec_id % 50 + 20 ORDER BY d, id LIMIT 10)",
    ),
    "VEC16_series_search": (
        _windows,
        f"SELECT id, {rs('d', 4)} AS distance FROM (SELECT id, list_distance(w::DOUBLE[], {[50.0] * 8}::DOUBLE[]) AS d FROM (SELECT event_id AS id, list(value::FLOAT) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS w FROM events WHERE event_type = 'click') WHERE len(w) = 8 ORDER BY d, id LIMIT 5)",
    ),
}
