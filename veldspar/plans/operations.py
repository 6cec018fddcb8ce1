"""CRM, CAT, STR and SRC rows over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.engine import Engine
from veldspar.operators import mitigation as M
from veldspar.operators import quality as Q
from veldspar.sources import files as S
from veldspar.sources.shared import new_path
from veldspar.streaming import pipeline as P

from ._base import Query, nanos, r, rs, table


def _crm(spark, d):
    """Customers as loans, parts as collateral, suppliers as guarantors."""
    c, p, s = (table(spark, d, x) for x in ("customer", "part", "supplier"))
    loans = c.select(F.col("c_custkey").alias("loan_id"), F.abs("c_acctbal").alias("ead"), F.element_at(F.array(*map(F.lit, ("AAA", "A", "BB"))), (F.col("c_nationkey") % 3 + 1).cast("int")).alias("rating"))
    coll = p.select(F.col("p_partkey").alias("col_id"), (F.col("p_retailprice") * 2).alias("value"), F.lit(0.1).alias("haircut"), F.lit(0.05).alias("fx_haircut"), (F.col("p_size") / 500.0).alias("maturity_mm"), F.element_at(F.array(*map(F.lit, ("cash", "bond", "equity"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("type"))
    guar = s.select(F.col("s_suppkey").alias("guarantor_id"), F.abs("s_acctbal").alias("amount"), F.lit("A").alias("rating"))
    mode = F.when(F.col("col_id") % 4 == 0, "specified").otherwise("optimizable")
    edges = coll.select("col_id", F.explode(F.array((F.col("col_id") * 7) % c.count(), (F.col("col_id") * 7 + 1) % c.count())).alias("loan_id")).withColumn("allocation_mode", mode).withColumn("seq", F.col("col_id"))
    guards = guar.select("guarantor_id", ((F.col("guarantor_id") * 13) % c.count()).alias("loan_id"), F.lit("optimizable").alias("allocation_mode"))
    return loans, coll, guar, edges, guards


def _covered(spark, d):
    return M.allocate(*_crm(spark, d))


def _rules(spark):
    return spark.createDataFrame([("cash", True, 0.0, 0.08, 1.0), ("bond", True, 0.05, 0.08, 0.3), ("equity", False, 0.3, 0.08, 0.1)], "type string, eligible boolean, haircut double, fx_haircut double, cap_share double")


def _governed(spark, d):
    coll = table(spark, d, "part").select(F.col("p_partkey").alias("col_id"), F.col("p_retailprice").alias("value"), F.element_at(F.array(*map(F.lit, ("cash", "bond", "equity", "odd"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("type"), F.when(F.col("p_partkey") % 2 == 0, "USD").otherwise("EUR").alias("currency"), F.lit("USD").alias("loan_currency"))
    return M.governed_collateral(coll, _rules(spark))


GOVERNED = """WITH g AS (SELECT p_partkey AS col_id, ['cash', 'bond', 'equity', 'odd'][(p_partkey % 4 + 1)::INT] AS type, p_partkey % 4 < 2 AS ok, p_retailprice * greatest(1 - CASE p_partkey % 4 WHEN 1 THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN p_partkey % 2 = 1 THEN 0.08::DOUBLE ELSE 0 END, 0) AS gross FROM part),
h AS (SELECT *, coalesce(sum(gross) FILTER (ok) OVER (PARTITION BY type ORDER BY col_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(CASE WHEN ok THEN gross ELSE 0 END) OVER () AS total FROM g),
k AS (SELECT col_id, type, ok, CASE WHEN ok THEN gross ELSE 0 END AS gross, CASE WHEN ok THEN least(gross, greatest(CASE type WHEN 'cash' THEN 1.0 ELSE 0.3 END::DOUBLE * total - before, 0)) ELSE 0 END AS cap FROM h)"""

RULES = [
    {"kind": "completeness", "column": "o_orderpriority", "min_ratio": 0.99}, {"kind": "uniqueness", "columns": ["o_orderkey"]}, {"kind": "uniqueness", "columns": ["o_custkey"]}, {"kind": "range", "column": "o_totalprice", "min": 0, "max": 400000},
    {"kind": "referential", "column": "o_custkey", "table": "customer", "key": "c_custkey"}, {"kind": "reconciliation", "column": "o_totalprice", "table": "orders", "tolerance": 0.01},
]


def _gate(spark, d):
    o = table(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice"))
    return Q.dq_gate(o, RULES, lambda n: table(spark, d, n).withColumnRenamed("c_custkey", "c_custkey"))


def _report(spark, d):
    e = table(spark, d, "events").select(F.pmod(F.col("event_id") * 37, F.lit(1000)).alias("ts"), F.col("event_type").alias("sym"), F.when(F.col("event_id") % 100 == 0, float("nan")).when(F.col("event_id") % 333 == 0, float("inf")).otherwise(F.col("value")).alias("v"), "event_id")
    return Q.dq_report(e, "ts", "sym", "event_id", ["v"])


DQ = """WITH e AS (SELECT (event_id * 37) % 1000 AS ts, event_type AS sym, event_id FROM events), l AS (SELECT *, ts < lag(ts) OVER (PARTITION BY sym ORDER BY event_id) AS back FROM e),
s AS (SELECT sym, count(*) AS n FROM e GROUP BY sym), t AS (SELECT count(*) - 1 AS n FROM e GROUP BY sym, ts),
rep AS (SELECT (SELECT count(*) FROM e) AS n_rows, (SELECT count(*) FROM s) AS n_symbols, (SELECT count(*) FROM e WHERE event_id % 100 = 0) AS n_nan, (SELECT count(*) FROM e WHERE event_id % 333 = 0 AND event_id % 100 <> 0) AS n_inf, (SELECT count(*) FROM l WHERE back) AS n_backward, (SELECT min(n) FROM s) AS min_rows, (SELECT max(n) FROM s) AS max_rows, (SELECT sum(n)::BIGINT FROM t) AS n_duplicates)"""


def _streamed(spark, d, policy: str = "dlq"):
    """Events in three batches, with repeats and late rows, through the pipeline; its own folder for each call."""
    folder = new_path(spark, "stream")
    e = table(spark, d, "events").select(F.lit("s").alias("source"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), (nanos("ts") / 1000).cast("long").alias("event_time"), "value")
    pipe = P.Pipeline(spark, folder, lateness=3600 * 10**6, policy=policy, valid="value < 300")
    for k in range(3):
        pipe.run_batch(e.where((F.col("offset") % 3 == k) | (F.col("offset") % 10 == 0)), k)
    pipe.run_batch(e.where((F.col("offset") % 3 == 2) | (F.col("offset") % 10 == 0)), 2)  # run again: nothing changes
    return pipe


#: A row's first batch; late if older than the newest of that batch and those before, less an hour.
STREAM = """WITH e AS (SELECT event_id AS o, epoch_us(ts) AS t, value AS v, CASE WHEN event_id % 10 = 0 THEN 0 ELSE event_id % 3 END AS b FROM events),
m AS (SELECT k, (SELECT max(t) FROM e WHERE o % 3 <= k OR o % 10 = 0) AS top FROM (VALUES (0), (1), (2)) x(k)),
f AS (SELECT e.*, t < top - 3600000000 AS late FROM e JOIN m ON m.k = e.b)"""


def _stored(spark, d):
    path = new_path(spark, "hdb")
    e = table(spark, d, "events").select(F.col("event_type").alias("symbol"), "event_id", "value", nanos("ts").alias("t"))
    for date, part in (("2024-01-01", 0), ("2024-01-02", 1), ("2024-01-03", 2)):
        S.hdb_save(e.where(F.col("event_id") % 4 == part), path, "ticks", date)
    return path, e


def _scan(spark, d):
    path, _ = _stored(spark, d)
    return S.hdb_scan(spark, path, "ticks", "2024-01-01", "2024-01-02", "click").select("event_id", "value", "date")


def _hot_cold(spark, d):
    path, e = _stored(spark, d)
    engine = Engine(spark)
    engine.register("ticks", e.where("event_id % 4 = 3"))
    return S.hot_and_cold(engine, "ticks", path, "2024-01-02", "2024-01-03", "view").select("event_id", "value")


def _rolled(spark, d):
    path, e = _stored(spark, d)
    engine = Engine(spark)
    engine.register("ticks", e.where("event_id % 4 = 3"))
    left = S.rollover(engine, "ticks", path, "2024-01-04").count()
    return S.hdb_load(spark, path, "ticks", "2024-01-04", "error").select("event_id", F.lit(left).alias("hot"))


def _csv(spark, d):
    path = new_path(spark, "csv")
    table(spark, d, "nation").write.option("header", True).csv(path)
    engine = Engine(spark)
    engine.register("n", S.read_csv(spark, path))
    return engine.sql("SELECT n_nationkey, n_name FROM n")


def _saved(spark, d):
    path, engine = new_path(spark, "saved"), Engine(spark)
    S.save(table(spark, d, "region").withColumn("k", F.lit(1)), path)
    S.load(engine, "reg", path)
    engine.sql("CREATE TABLE doubled AS SELECT r_regionkey * 2 AS k2 FROM reg")
    return engine.sql("doubled")


def _providers(spark, d):
    path = new_path(spark, "cache")
    bars = lambda spark, code, period: table(spark, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey") % 20).alias("code"), F.lit("1d").alias("period"), nanos("o_orderdate").alias("ts"), *(F.col("o_totalprice").alias(c) for c in ("open", "high", "low", "close", "volume", "amount")), F.lit("qfq").alias("adjust"))
    out = S.Providers(spark, path)
    out.add("file", klines=bars)
    return out


QUERIES: dict[str, Query] = {
    "CRM01_allocate": (lambda spark, d: _covered(spark, d).select("loan_id", *(r(c, 2).alias(c) for c in ("collateral_cover", "guarantee_cover", "uncovered"))), None),
    "CRM02_haircuts": (
        lambda spark, d: _crm(spark, d)[1].select("col_id", r(M.adjusted_value(F.col("value"), F.col("haircut"), F.col("fx_haircut"), F.col("maturity_mm")), 4).alias("capacity")),
        f"SELECT p_partkey AS col_id, {rs('p_retailprice * 2 * greatest(1 - 0.1::DOUBLE - 0.05::DOUBLE - p_size / 500.0::DOUBLE, 0)', 4)} AS capacity FROM part",
    ),
    "CRM08_audit": (lambda spark, d: M.audit(*_crm(spark, d)).select("part", "seq", "stage", "source_kind", "source_id", "loan_id", r("amount", 2).alias("amount")), None),
    "CRM09_rating_map": (lambda spark, d: M.rating_map(spark).where("map = 'rating'").select("key", "priority"), "SELECT * FROM (VALUES ('AAA', 1.0::DOUBLE), ('AA', 2.0), ('A', 3.0), ('BBB', 4.0), ('BB', 5.0), ('B', 6.0), ('CCC', 7.0)) t(key, priority)"),
    "CRM10_governed": (lambda spark, d: _governed(spark, d).select("col_id", r("capacity", 4).alias("capacity")), GOVERNED + f" SELECT col_id, {rs('cap', 4)} AS capacity FROM k"),
    "CRM11_reasons": (lambda spark, d: _governed(spark, d).groupBy(F.coalesce("reason", F.lit("used")).alias("reason")).agg(F.count("*").alias("n")), GOVERNED + " SELECT CASE WHEN type = 'odd' THEN 'no rule' WHEN NOT ok THEN 'not eligible' WHEN cap < gross THEN 'concentration cap' ELSE 'used' END AS reason, count(*) AS n FROM k GROUP BY 1"),
    "CRM13_netting": (
        lambda spark, d: M.netting_summary(table(spark, d, "customer").select(F.col("c_nationkey").alias("netting_set"), (F.col("c_acctbal") - 4000).alias("amount"))).select("netting_set", r("gross", 2).alias("gross"), r("net", 2).alias("net")),
        f"SELECT c_nationkey AS netting_set, {rs('sum(greatest(c_acctbal - 4000, 0))', 2)} AS gross, {rs('greatest(sum(c_acctbal - 4000), 0)', 2)} AS net FROM customer GROUP BY 1",
    ),
    "CRM13_method_diff": (lambda spark, d: M.allocation_diff(_covered(spark, d), M.allocate(*_crm(spark, d), method="haircut_efficiency")).select("loan_id", r("difference", 2).alias("difference")), None),
    "CAT01_dq_report": (_report, DQ + " SELECT * FROM rep"),
    "CAT02_dq_check": (lambda spark, d: Q.dq_check(_report(spark, d)), DQ + " SELECT * FROM (SELECT unnest(['n_nan', 'n_inf', 'n_duplicates', 'n_backward']) AS issue, unnest([n_nan, n_inf, n_duplicates, n_backward]) AS count FROM rep) WHERE count > 0"),
    "CAT03_health_check": (lambda spark, d: Q.health_check(_report(spark, d), 3.0), DQ + " SELECT unnest(['rows', 'fresh', 'finite', 'unique', 'ordered']) AS \"check\", unnest([CASE WHEN min_rows >= 50 THEN 'ok' ELSE 'warn' END, 'ok', 'warn', CASE WHEN n_duplicates = 0 THEN 'ok' ELSE 'warn' END, CASE WHEN n_backward = 0 THEN 'ok' ELSE 'warn' END]) AS status FROM rep"),
    "CAT04_dq_gate": (
        lambda spark, d: _gate(spark, d).select("rule", "kind", "passed", r("measured", 4).alias("measured")),
        """SELECT * FROM (SELECT 'completeness_0' AS rule, 'completeness' AS kind, true AS passed, 1.0::DOUBLE AS measured UNION ALL SELECT 'uniqueness_1', 'uniqueness', true, 0 UNION ALL SELECT 'uniqueness_2', 'uniqueness', false, (SELECT count(*) - count(DISTINCT o_custkey) FROM orders)
UNION ALL SELECT 'range_3', 'range', count(*) = 0, count(*) FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'referential_4', 'referential', count(*) = 0, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'reconciliation_5', 'reconciliation', true, 0)""",
    ),
    "CAT10_column_stats": (
        lambda spark, d: Q.column_stats(table(spark, d, "nation").select("n_nationkey", "n_name")),
        "SELECT 'n_nationkey' AS \"column\", count(*) AS n_rows, 0::BIGINT AS n_null, min(n_nationkey)::VARCHAR AS min, max(n_nationkey)::VARCHAR AS max FROM nation UNION ALL SELECT 'n_name', count(*), 0, min(n_name), max(n_name) FROM nation",
    ),
    "CAT12_replay": (
        lambda spark, d: spark.createDataFrame([(Q.replay(Q.lineage_record(q := "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey", (e := Engine.over(spark, d, ["orders"])).sql(q), ["orders"]), e.sql),)], "same boolean"),
        "SELECT true AS same",
    ),
    "STR08_micro_batches": (lambda spark, d: _streamed(spark, d).data().select("offset", "batch_id"), STREAM + " SELECT o AS \"offset\", b::INT AS batch_id FROM f WHERE v < 300 AND NOT late"),
    "STR07_dead_letters": (lambda spark, d: _streamed(spark, d).dead_letters().select("offset", "error"), STREAM + " SELECT o AS \"offset\", CASE WHEN v >= 300 THEN 'invalid' ELSE 'late' END AS error FROM f WHERE v >= 300 OR late"),
    "STR06_recompute": (lambda spark, d: _streamed(spark, d, "recompute").data().agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM events WHERE value < 300"),
    "STR12_tumbling": (
        lambda spark, d: P.windowed(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", by=("event_type",), value="value").select("event_type", F.unix_micros("start").alias("start"), "n", r("total", 2).alias("total")),
        f"SELECT event_type, (epoch_us(ts) // 21600000000) * 21600000000 AS start, count(*) AS n, {rs('sum(value)', 2)} AS total FROM events GROUP BY 1, 2",
    ),
    "STR12_sessions": (
        lambda spark, d: P.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "12 hours", ("user_id",)).select("user_id", F.unix_micros("start").alias("start"), "n"),
        "WITH g AS (SELECT user_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 43200000000, true) AS new FROM events), s AS (SELECT user_id, t, sum(new::INT) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g) SELECT user_id, min(t) AS start, count(*) AS n FROM s GROUP BY user_id, k",
    ),
    "SRC01_read_csv": (_csv, "SELECT n_nationkey, n_name FROM nation"),
    "SRC05_save_load": (_saved, "SELECT r_regionkey * 2 AS k2 FROM region"),
    "SRC09_hdb_scan": (_scan, "SELECT event_id, value, CASE event_id % 4 WHEN 0 THEN '2024-01-01' ELSE '2024-01-02' END AS date FROM events WHERE event_type = 'click' AND event_id % 4 < 2"),
    "SRC10_rollover": (_rolled, "SELECT event_id, 0 AS hot FROM events WHERE event_type = 'error' AND event_id % 4 = 3"),
    "SRC11_hot_and_cold": (_hot_cold, "SELECT event_id, value FROM events WHERE event_type = 'view' AND event_id % 4 > 0"),
    "SRC16_klines": (lambda spark, d: _providers(spark, d).klines("file", "C3", most=20).select("code", "close"), "SELECT code, close FROM (SELECT 'C3' AS code, o_totalprice AS close, o_orderdate FROM orders WHERE o_custkey % 20 = 3 ORDER BY o_orderdate DESC LIMIT 20)"),
    "SRC18_provider_cache": (lambda spark, d: (p := _providers(spark, d), p.cached("file", "klines", "C3"), p.cached("file", "klines", "C3"))[2].agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM orders WHERE o_custkey % 20 = 3"),
    "SRC19_providers": (lambda spark, d: _providers(spark, d).names(), "SELECT 'file' AS provider, true AS klines, false AS ticks"),
}
