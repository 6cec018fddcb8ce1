"""Rows of files, the store, lineage, admission, streaming, priorities and user functions that no other module registers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from veldspar.engine import Engine
from veldspar.functions import user as U
from veldspar.functions.scalars import vector_udf
from veldspar.operators import exposure as E
from veldspar.operators import forecast as FC
from veldspar.operators import mitigation as M
from veldspar.operators import quality as Q
from veldspar.operators import vector as V
from veldspar.sources import files as S
from veldspar.sources.shared import new_path
from veldspar.sources.store import TableStore, partition_columns
from veldspar.streaming import pipeline as P
from veldspar.workload import Rejected, Workload

from ._base import Query, nanos, r, rs, table
from .operations import QUERIES as OPERATIONS
from .operations import STREAM, _gate, _providers, _stored, _streamed

# --- tables and files


def _created(spark, d):
    engine = Engine.over(spark, d, ["nation"])
    kept = engine.sql("CREATE TABLE by_region AS SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
    return kept.crossJoin(engine.sql("DROP TABLE by_region"))


def _left(spark, d):
    engine = Engine.over(spark, d, ["nation", "region"])
    engine.drop("nation")
    return spark.createDataFrame([(x,) for x in sorted(engine.tables)], "name string")


def _explained(spark, d):
    text = Engine.over(spark, d, ["orders"]).explain("SELECT count(*) FROM orders")
    return spark.createDataFrame([("Statistics(" in text,)], "statistics boolean")


def _loaded_csv(spark, d):
    path, engine = new_path(spark, "table") + ".csv", Engine(spark)
    table(spark, d, "supplier").select("s_suppkey", "s_nationkey").write.option("header", True).csv(path)
    S.load(engine, "s", path)
    return engine.sql("SELECT s_nationkey, count(*) AS n FROM s GROUP BY s_nationkey")


def _loaded(spark, d):
    engine = Engine(spark)
    S.load(engine, "o", f"{d}/orders.parquet")
    return engine.sql("SELECT o_custkey, count(*) AS n FROM o GROUP BY o_custkey")


def _refreshed(spark, d):
    """The table before and after files were added to its folder."""
    path, engine = new_path(spark, "grown"), Engine(spark)
    e = table(spark, d, "events").select("event_id", "value")
    S.save(e.where("event_id % 2 = 0"), path)
    first = S.refresh(engine, "grown", path, e.schema).count()
    S.save(e.where("event_id % 2 = 1"), path, "append")
    return S.refresh(engine, "grown", path, e.schema).agg(F.lit(first).alias("before"), F.count("*").alias("after"))


def _replaced(spark, d):
    """A date saved twice holds its last rows; the other dates stay."""
    path, e = _stored(spark, d)
    S.hdb_save(e.where("event_id % 4 = 3"), path, "ticks", "2024-01-02")
    return S.hdb_scan(spark, path, "ticks", "2024-01-01", "2024-01-03").select("event_id", "date")


def _flushed(spark, d):
    """Two runs of the scheduled job, the second on a new date."""
    path, engine = new_path(spark, "days"), Engine(spark)
    e = table(spark, d, "events").select(F.col("event_type").alias("symbol"), "event_id")
    engine.register("ticks", e)
    held = S.checkpoint_day(engine, "ticks", path, "2024-01-01", "2024-01-01")
    held = S.checkpoint_day(engine, "ticks", path, "2024-01-02", held)
    stored = S.hdb_scan(spark, path, "ticks", "2024-01-01", held).groupBy("date").agg(F.count("*").alias("n"))
    return stored.withColumn("hot", F.lit(engine.table("ticks").count()))


def _cached(spark, d):
    p = _providers(spark, d)
    p.cached("file", "klines", "C5")
    return p.cached("file", "klines", "C5").select("code", "ts", "close")


def _ticks(spark, d):
    out = S.Providers(spark)
    e = table(spark, d, "events")
    out.add("file", ticks=lambda spark, code, period: e.select(F.col("event_type").alias("code"), (nanos("ts") + F.col("event_id") % 1000).alias("ts"), F.col("value").alias("price"), *(F.lit(1.0).alias(c) for c in ("volume", "amount")), F.lit("buy").alias("side"), *(F.col("value").alias(c) for c in ("bid", "ask"))))
    return out.ticks("file", "view").select("ts", "price")


def _persisted(spark, d):
    """A table kept by one engine, read by the next; a forgotten one isn't found again."""
    root, engine = new_path(spark, "tables"), Engine.over(spark, d, ["orders"])
    S.persist(engine, "spent", "SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey", root)
    S.persist(engine, "gone", "SELECT 1 AS one", root)
    S.forget(engine, "gone", root)
    later = Engine(spark)
    found = S.restore(later, root)
    return later.sql("spent").select("o_custkey", r("total", 2).alias("total"), F.lit(",".join(found)).alias("tables"))


# --- mitigation, limits


def _faults(spark, d):
    """Line items as edges from parts to the customers of orders: ids occur twice and are missing."""
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("col_id"), F.col("l_suppkey").alias("loan_id"))
    return M.edge_faults(edges, "col_id", table(spark, d, "part").select((F.col("p_partkey") + 5).alias("col_id")), table(spark, d, "orders").select(F.col("o_custkey").alias("loan_id")))


def _snapshot(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "Base").otherwise("Stress").alias("scenario_id"), (F.col("c_custkey") % 10).alias("valid_from"), (F.col("c_custkey") % 10 + 5).alias("valid_to"))
    return M.snapshot(c, "BASE", 7).select("c_custkey")


def _priorities(spark, d, method: str):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("col_id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("double")).alias("priority"), F.element_at(F.array(*map(F.lit, ("cash", "bond", "odd"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("type"), (F.col("p_retailprice") * 0.9).alias("capacity"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("loan_id"), F.element_at(F.array(*map(F.lit, ("AAA", "BB", "none"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("rating"), F.when(F.col("c_custkey") % 4 == 0, F.lit(0.35)).alias("risk_weight"))
    own = lambda df, kind, key: M.with_priority(df, kind, method).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), r("__priority", 4).alias("priority"))
    return own(p, "collateral", "col_id").unionByName(own(c, "loan", "loan_id"))


def _limits(spark, d):
    dims = F.array(*(F.lit(x[0]) for x in E.LIMITS))
    point = table(spark, d, "part").select(F.element_at(dims, (F.col("p_partkey") % 5 + 1).cast("int")).alias("dim"), F.col("p_partkey").alias("key"), F.lit("after").alias("measure"), F.col("p_retailprice").alias("exposure"))
    return E.ratios(point, 5000.0).select("dim", "key", "status", r("headroom", 2).alias("headroom"))


# --- the store, lineage, admission


def _publish(spark, d):
    """Blocked without reasons; written with them, and the audit rows."""
    result, path = _gate(spark, d), new_path(spark, "published")
    try:
        Q.publish(table(spark, d, "orders"), result, lambda df: df.write.parquet(path))
        blocked = False
    except Q.GateClosed:
        blocked = True
    failed = [x["rule"] for x in result.where("not passed").select("rule").collect()]  # one row a rule
    audit = Q.publish(table(spark, d, "orders"), result, lambda df: df.write.parquet(path), {x: "known" for x in failed}, "me")
    return spark.createDataFrame(audit, "rule string, user string, reason string").withColumn("blocked", F.lit(blocked)).withColumn("written", F.lit(spark.read.parquet(path).count()))


def _commits(spark, d):
    """(at, id): the table as of each of four commits; one is tried twice."""
    store, n = TableStore(spark, new_path(spark, "store")), table(spark, d, "nation").select("n_nationkey")
    store.commit("t", n.where("n_nationkey < 5"), at=100)
    for _ in range(2):
        store.commit("t", n.where("n_nationkey BETWEEN 5 AND 9"), at=200, key="second")
    store.commit("t", n.where("n_nationkey > 20"), "overwrite", at=300)
    store.commit("t", None, "delete", at=400)
    out = None
    for at in (100, 250, 300, 400):
        one = store.scan("t", at).withColumn("at", F.lit(at))
        out = one if out is None else out.unionByName(one)
    return out


def _pruned(spark, d):
    """The rows of folders that meet the range: pruning leaves whole folders."""
    store, e = TableStore(spark, new_path(spark, "store")), table(spark, d, "events").select("event_id", "value")
    for rows in (e.where("value < 50"), e.where("value >= 50 AND value < 200"), e.where("value >= 200")):
        store.commit("t", rows, event_time="value")
    return store.scan("t", start=60.0, end=150.0).select("event_id")


def _evolved(spark, d):
    store, n = TableStore(spark, new_path(spark, "store")), table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("name"))
    store.commit("t", n.where("k < 10"))
    store.evolve("t", add={"note": "string"}, rename={"name": "label"}, widen={"k": "long"})
    store.commit("t", n.where("k >= 10").select(F.col("k").cast("long").alias("k"), F.col("name").alias("label"), F.lit("new").alias("note")))
    return store.scan("t")


def _spec(spark, d):
    e = partition_columns(table(spark, d, "events").select("event_type", "ts", "user_id"), [("event_type", "identity", None), ("ts", "date_trunc", "month"), ("user_id", "bucket", 8)])
    return e.groupBy(F.col("__p0").alias("event_type"), F.col("__p1").cast("string").alias("month")).agg(F.count("*").alias("n"), F.count(F.when(~F.col("__p2").between(0, 7), 1)).alias("outside"))


LINEAGE = "SELECT o_custkey, count(*) AS n, rand() AS x FROM orders GROUP BY o_custkey"


def _lineage(spark, d):
    rec = Q.lineage_record(LINEAGE, Engine.over(spark, d, ["orders"]).sql(LINEAGE), ["orders"])
    return spark.createDataFrame([(rec["query_hash"], rec["rows"], ",".join(rec["sources"]), ",".join(rec["changing"]))], "query_hash string, n_rows long, sources string, changing string")


def _admitted():
    """Three places: a training query gives way to an interactive one; a maintenance query finds no room."""
    w = Workload(most=3)
    for kind, tag in (("training", "a"), ("batch", "b"), ("batch", "c")):
        w.admit(kind, tag)
    try:
        w.admit("maintenance", "d")
    except Rejected:
        pass
    w.admit("interactive", "e")
    return w


# --- streaming


def _replayed(spark, d):
    """JSON lines in three files, one file a batch, replayed twice into one sink."""
    files, pipe = new_path(spark, "lines"), P.Pipeline(spark, new_path(spark, "sink"), lateness=1 << 60)
    rows = table(spark, d, "events").select(F.lit("s").alias("source"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), (nanos("ts") / 1000).cast("long").alias("event_time"), "value")
    for k in range(3):
        rows.where(F.col("offset") % 3 == k).coalesce(1).write.mode("append").json(files)
    stream = P.replay_files(spark, files, "source string, partition int, offset long, event_time long, value double")
    for _ in range(2):
        pipe.start(stream, new_path(spark, "offsets")).awaitTermination()
    return pipe


def _watermarks(spark, d):
    pipe = _streamed(spark, d)
    return spark.createDataFrame([(k, pipe.watermark(k + 1)) for k in range(3)], "batch_id int, top long")


# --- user functions


def _function_engine(spark, d):
    engine = Engine.over(spark, d, ["nation"])
    engine.define(("nations_of", "no"), lambda e, region: e.table("nation").where(F.col("n_regionkey") == region).select("n_nationkey"))
    return engine


def _weighted(spark, d):
    """A volume-weighted mean, from sums that merge."""
    mean = U.Algebraic({"xw": lambda x, w: F.sum(x * w), "w": lambda x, w: F.sum(w)}, lambda s: s["xw"] / s["w"])
    return mean.by(table(spark, d, "lineitem"), ["l_suppkey"], ["l_extendedprice", "l_quantity"], "mean").select("l_suppkey", r("mean", 4).alias("mean"))


def _distances(spark, d):
    """Each value less its symbol's first."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return U.window_udf(e, ["event_type"], ["event_id"], lambda x: x - x[0], "value", "moved").select("event_id", r("moved", 4).alias("moved"))


def _reserved(spark, d):
    try:
        FC.forward_probability(spark.createDataFrame([], "symbol string, ts long, close double"), 1, 1, [], model="gbdt")
    except NotImplementedError:
        return spark.createDataFrame([("gbdt", True)], "model string, refused boolean")
    return spark.createDataFrame([("gbdt", False)], "model string, refused boolean")


def _strategies(spark, d):
    rows = [(m, (p := V.adaptive_plan(m, 1000)).strategy, p.oversample) for m in range(0, 1001)]
    return spark.createDataFrame(rows, "matching int, strategy string, oversample int")


def _valid_embeddings(spark, d):
    """Half are in force at 5; those pass, with another dimension they don't."""
    e = table(spark, d, "embeddings")
    key, vector = [f.name for f in e.schema.fields][0], next(f.name for f in e.schema.fields if f.dataType.typeName() == "array")
    held = e.select(F.col(key).alias("id"), F.col(vector).alias("embedding"), F.lit("m").alias("model"), F.lit("1").alias("version"), F.lit("l2").alias("metric"), (F.col(key) % 2 * 10).alias("effective_from"), F.lit(100).alias("effective_to"))
    now, size = V.active_embeddings(held, 5), len(e.select(vector).first()[0])
    V.validate_embeddings(now, size)
    try:
        V.validate_embeddings(now, size + 1)
        refused = False
    except ValueError:
        refused = True
    return now.agg(F.count("*").alias("active")).withColumn("refused", F.lit(refused))


_VALUES = "SELECT * FROM (VALUES "
QUERIES: dict[str, Query] = {
    "REL20_create_and_drop": (_created, "SELECT n_regionkey, count(*) AS n, true AS dropped FROM nation GROUP BY n_regionkey"),
    "REL21_explain": (_explained, "SELECT true AS statistics"),
    "SRC02_read_parquet": (lambda spark, d: S.read_parquet(spark, f"{d}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal"), "SELECT s_suppkey, s_name, s_acctbal FROM supplier"),
    "SRC03_load_csv": (_loaded_csv, "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey"),
    "SRC04_load": (_loaded, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"),
    "SRC06_refresh": (_refreshed, "SELECT count(*) FILTER (event_id % 2 = 0) AS before, count(*) AS after FROM events"),
    "SRC07_hdb_save": (
        _replaced,
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2024-01-01' WHEN 3 THEN '2024-01-02' ELSE '2024-01-03' END AS date FROM events e WHERE event_id % 4 <> 1 UNION ALL SELECT event_id, '2024-01-02' FROM events e WHERE event_id % 4 = 1 AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_type = e.event_type AND f.event_id % 4 = 3)",
    ),
    "SRC08_hdb_load": (lambda spark, d: S.hdb_load(spark, _stored(spark, d)[0], "ticks", "2024-01-03", "view").select("event_id"), "SELECT event_id FROM events WHERE event_type = 'view' AND event_id % 4 = 2"),
    "SRC12_flush": (_flushed, "SELECT '2024-01-01' AS date, count(*) AS n, 0 AS hot FROM events"),
    "SRC13_day_cache": (_cached, "SELECT 'C5' AS code, epoch_us(o_orderdate::TIMESTAMP) * 1000 AS ts, o_totalprice AS close FROM orders WHERE o_custkey % 20 = 5"),
    "SRC17_ticks": (_ticks, "SELECT epoch_us(ts) * 1000 + event_id % 1000 AS ts, value AS price FROM events WHERE event_type = 'view' ORDER BY 1 DESC LIMIT 500"),
    "SRC22_drop_table": (_left, "SELECT 'region' AS name"),
    "SRC23_persistent_tables": (_persisted, f"SELECT o_custkey, {rs('sum(o_totalprice)', 2)} AS total, 'spent' AS tables FROM orders GROUP BY o_custkey"),
    "CRM03_snapshot": (_snapshot, "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 10 <= 7 AND c_custkey % 10 + 5 > 7"),
    "CRM04_edge_faults": (
        _faults,
        """SELECT 'twice' AS fault, 'loan_id' AS "column", o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1
UNION ALL SELECT 'unknown', 'col_id', l_partkey, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey + 5 FROM part) GROUP BY 3
UNION ALL SELECT 'unknown', 'loan_id', l_suppkey, count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 3""",
    ),
    "CRM05_priorities": (
        lambda spark, d: _priorities(spark, d, "greedy"),
        "SELECT 'collateral' AS kind, p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN 4 ELSE 0 END::DOUBLE AS priority FROM part UNION ALL SELECT 'loan', c_custkey, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 0 END::DOUBLE FROM customer",
    ),
    "CRM06_efficiency_order": (
        lambda spark, d: _priorities(spark, d, "haircut_efficiency"),
        f"SELECT 'collateral' AS kind, p_partkey AS id, {rs('p_retailprice * 0.9::DOUBLE', 4)} AS priority FROM part UNION ALL SELECT 'loan', c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.35 ELSE CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 0 END END::DOUBLE FROM customer",
    ),
    "LE13_limit_set": (
        _limits,
        f"""WITH l AS ({_VALUES}(0, 'lc_group', 0.25, 0.20, 0.10), (1, 'entity', 0.25, 0.20, 0.10), (2, 'connected_party', 0.15, 0.12, 0.10), (3, 'sector', 1.0, 0.8, 0.5), (4, 'country', 1.0, 0.8, 0.5)) t(k, dim, lim, warn, report))
SELECT dim, p_partkey AS "key", CASE WHEN x >= lim::DOUBLE THEN 'breach' WHEN x >= warn::DOUBLE THEN 'warn' WHEN x >= report::DOUBLE THEN 'reportable' ELSE 'ok' END AS status, {rs('lim::DOUBLE * 5000 - p_retailprice', 2)} AS headroom FROM (SELECT *, p_retailprice / 5000.0::DOUBLE AS x FROM part) p JOIN l ON p_partkey % 5 = k""",
    ),
    "CAT05_publish_gate": (_publish, "SELECT rule, 'me' AS user, 'known' AS reason, true AS blocked, (SELECT count(*) FROM orders) AS written FROM (" + OPERATIONS["CAT04_dq_gate"][1] + ") WHERE NOT passed"),
    "CAT06_atomic_commit": (_commits, "SELECT n_nationkey, k::INT AS \"at\" FROM nation, (VALUES (100), (250), (300)) t(k) WHERE (k <= 250 AND n_nationkey < 5) OR (k = 250 AND n_nationkey BETWEEN 5 AND 9) OR (k = 300 AND n_nationkey > 20)"),
    "CAT07_pruned_scan": (_pruned, "SELECT event_id FROM events WHERE value >= 50 AND value < 200"),
    "CAT08_schema_evolve": (_evolved, "SELECT n_nationkey::BIGINT AS k, n_name AS label, CASE WHEN n_nationkey >= 10 THEN 'new' END AS note FROM nation"),
    "CAT09_partition_spec": (_spec, "SELECT event_type, date_trunc('month', ts)::DATE::VARCHAR AS month, count(*) AS n, 0::BIGINT AS outside FROM events GROUP BY 1, 2"),
    "CAT11_lineage_record": (_lineage, f"SELECT sha256('{LINEAGE}') AS query_hash, count(DISTINCT o_custkey) AS n_rows, 'orders' AS sources, 'rand' AS changing FROM orders"),
    "CAT13_workload_status": (
        lambda spark, d: _admitted().status(spark).select("class", "priority", "quota", "queue", "running", "waiting"),
        _VALUES + "('interactive', 100, 16, 64, 1, 0), ('streaming', 90, 8, 16, 0, 0), ('reporting', 60, 8, 32, 0, 0), ('batch', 40, 4, 64, 2, 0), ('training', 20, 2, 8, 0, 0), ('maintenance', 10, 2, 8, 0, 0)) t(class, priority, quota, queue, running, waiting)",
    ),
    "CAT14_admission": (
        lambda spark, d: _admitted().status(spark).select("class", "admitted", "rejected", "preempted"),
        _VALUES + "('interactive', 1, 0, 1), ('streaming', 0, 0, 0), ('reporting', 0, 0, 0), ('batch', 2, 0, 0), ('training', 1, 0, 0), ('maintenance', 0, 1, 0)) t(class, admitted, rejected, preempted)",
    ),
    "STR02_file_replay": (lambda spark, d: _replayed(spark, d).data().select("offset", "value"), 'SELECT event_id AS "offset", value FROM events'),
    "STR03_event_id": (
        lambda spark, d: table(spark, d, "events").select(F.lit("s").alias("source"), F.lit(0).alias("partition"), F.col("event_id").alias("offset")).select("offset", F.hex(P.event_id()).alias("id"), F.hex(P.event_id("offset")).alias("keyed")),
        "SELECT event_id AS \"offset\", upper(substr(sha256('s' || chr(31) || '0' || chr(31) || event_id), 1, 32)) AS id, upper(substr(sha256(event_id::VARCHAR), 1, 32)) AS keyed FROM events",
    ),
    "STR04_dedup": (lambda spark, d: _streamed(spark, d, "recompute").data().groupBy("offset").agg(F.count("*").alias("n")), 'SELECT event_id AS "offset", 1::BIGINT AS n FROM events WHERE value < 300'),
    "STR05_watermark": (_watermarks, STREAM + " SELECT k::INT AS batch_id, top FROM m"),
    "STR09_idempotent_sink": (lambda spark, d: _replayed(spark, d).data().agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids")), "SELECT count(*) AS n, count(*) AS ids FROM events"),
    "STR10_offsets": (lambda spark, d: _streamed(spark, d).offsets(), 'SELECT \'s\' AS source, 0 AS "partition", max(event_id) AS "offset" FROM events'),
    "STR11_rate_limit": (lambda spark, d: _replayed(spark, d).data().agg(F.count_distinct("batch_id").alias("batches")), "SELECT 3::BIGINT AS batches"),
    "UDF01_scalar": (lambda spark, d: table(spark, d, "events").select("event_id", r(vector_udf(lambda x: np.sqrt(np.abs(x)))(F.col("value")), 4).alias("root")), f"SELECT event_id, {rs('sqrt(abs(value))', 4)} AS root FROM events"),
    "UDF02_aggregate": (_weighted, f"SELECT l_suppkey, {rs('sum(l_extendedprice * l_quantity) / sum(l_quantity)', 4)} AS mean FROM lineitem GROUP BY l_suppkey"),
    "UDF03_window": (_distances, f"SELECT event_id, {rs('value - first_value(value) OVER (PARTITION BY event_type ORDER BY event_id)', 4)} AS moved FROM events"),
    "UDF04_table_function": (lambda spark, d: _function_engine(spark, d).sql("nations_of(2)"), "SELECT n_nationkey FROM nation WHERE n_regionkey = 2"),
    "UDF05_alias": (lambda spark, d: _function_engine(spark, d).sql("no(3)"), "SELECT n_nationkey FROM nation WHERE n_regionkey = 3"),
    "UDF08_bare_name": (lambda spark, d: _function_engine(spark, d).sql("nation").select("n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation"),
    "FC06_reserved_model": (_reserved, "SELECT 'gbdt' AS model, true AS refused"),
    "VEC10_strategy": (
        _strategies,
        """SELECT m::INT AS matching, CASE WHEN m >= 1000 THEN 'post_filter' WHEN m < 10 THEN 'pre_filter_exact' WHEN m < 200 THEN 'filtered_index' ELSE 'oversample' END AS strategy,
CASE WHEN m >= 1000 OR m < 10 THEN 1 ELSE least(64, greatest(1, ceil(1.5::DOUBLE / (m / 1000.0::DOUBLE)))) END::INT AS oversample FROM range(1001) t(m)""",
    ),
    "VEC13_active_embeddings": (_valid_embeddings, None),
}
