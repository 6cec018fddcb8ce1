"""LE rows: large exposures, counterparty risk, transactions and ownership, over orders as exposure events."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import exposure as E

from ._base import Query, nanos, r, rs, table

DAY = 86400 * 10**9
AT, START, END = 883612800 * 10**9, 880000000 * 10**9, 890000000 * 10**9
TIER1 = 2e7


def _events(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("entity_id"), F.col("o_totalprice").alias("amount"), (F.col("o_totalprice") * 0.25).alias("crm_reduction"), (F.col("o_orderkey") % 11 == 0).alias("exempt"),
        F.col("c_mktsegment").alias("sector"), F.col("c_nationkey").alias("country"), F.col("o_orderpriority").alias("rating"), (F.col("o_custkey") % 50 == 0).alias("connected"), (F.col("o_custkey") % 70 == 0).alias("affiliate"),
        nanos("o_orderdate").alias("valid_from"), (nanos("o_orderdate") + 90 * DAY).alias("valid_to"),
    )


def _relations(spark, d):
    """Customers in runs of four (control, not always enough of it) and pairs that depend on each other."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    control = c.where("k % 4 <> 3").select("k", (F.col("k") + 1).alias("child"), F.lit("Control").alias("kind"), F.when(F.col("k") % 3 == 0, 0.3).otherwise(0.6).alias("pct"))
    depends = c.where("k % 10 = 0").select("k", (F.col("k") + 40).alias("child"), F.lit("EconomicDependence").alias("kind"), F.lit(0.0).alias("pct"))
    person = c.where("k % 25 = 0").select("k", (F.col("k") + 7).alias("child"), F.lit("ConnectedPerson").alias("kind"), F.lit(0.0).alias("pct"))
    return control.unionByName(depends).unionByName(person).select(F.col("k").alias("parent"), "child", "kind", "pct", F.lit(0).cast("long").alias("valid_from"), F.lit(2**62).alias("valid_to"))


EV = f"""WITH RECURSIVE ev AS (SELECT o_orderkey AS event_id, o_custkey AS entity_id, o_totalprice AS amount, greatest(o_totalprice - o_totalprice * 0.25::DOUBLE, 0) AS after, o_orderkey % 11 = 0 AS exempt,
  c_mktsegment AS sector, c_nationkey AS country, o_orderpriority AS rating, o_custkey % 50 = 0 AS connected, o_custkey % 70 = 0 AS affiliate, epoch_us(o_orderdate) * 1000 AS valid_from, epoch_us(o_orderdate) * 1000 + {90 * DAY} AS valid_to FROM orders JOIN customer ON o_custkey = c_custkey),
ln AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 4 <> 3 AND c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_custkey + 40 FROM customer WHERE c_custkey % 10 = 0),
sy AS (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln),
wk AS (SELECT a AS id, a AS r FROM sy UNION SELECT sy.b, wk.r FROM wk JOIN sy ON sy.a = wk.id),
gr AS (SELECT id, min(r) AS rep FROM wk GROUP BY id),
ks AS (SELECT event_id, unnest([{{'dim': 'entity', 'key': entity_id::VARCHAR}}, {{'dim': 'lc_group', 'key': coalesce(rep, entity_id)::VARCHAR}}, {{'dim': 'sector', 'key': sector}}, {{'dim': 'connected_party', 'key': CASE WHEN connected THEN entity_id::VARCHAR END}},
  {{'dim': 'group_affiliate', 'key': CASE WHEN affiliate THEN entity_id::VARCHAR END}}, {{'dim': 'country', 'key': country::VARCHAR}}, {{'dim': 'rating', 'key': rating}}]) AS k, amount, after, exempt, valid_from, valid_to FROM ev LEFT JOIN gr ON gr.id = ev.entity_id),
led AS (SELECT event_id, k.dim AS dim, k.key AS key, m.measure AS measure, m.v AS amount, valid_from, valid_to FROM (SELECT *, unnest([{{'measure': 'before', 'v': amount}}, {{'measure': 'after', 'v': after}}, {{'measure': 'exempted', 'v': CASE WHEN exempt THEN amount END}}]) AS m FROM ks WHERE k.key IS NOT NULL) WHERE m.v IS NOT NULL),
pt AS (SELECT dim, key, measure, sum(amount) AS exposure FROM led WHERE valid_from <= {AT} AND {AT} < valid_to GROUP BY ALL),
mv AS (SELECT dim, key, measure, greatest(valid_from, {START}) AS t, amount AS d FROM led WHERE valid_from <= {END} AND valid_to > {START} UNION ALL SELECT dim, key, measure, valid_to, -amount FROM led WHERE valid_from <= {END} AND valid_to > {START}),
st AS (SELECT dim, key, measure, t, sum(d) AS d FROM mv WHERE t <= {END} GROUP BY ALL),
rt AS (SELECT *, {rs('sum(d) OVER (PARTITION BY dim, key, measure ORDER BY t)', 4)} AS total FROM st),
pk AS (SELECT dim, key, measure, max(total) AS peak, arg_max(t, (total, -t)) AS peak_at FROM rt GROUP BY dim, key, measure)"""


def _groups(spark, d):
    return E.lc_groups(_relations(spark, d), AT)


def _ledger(spark, d):
    return E.ledger(_events(spark, d), _groups(spark, d))


def _rounded(df, *names, digits=4):
    return df.select(*(r(c, digits).alias(c) if c in names else c for c in df.columns))


LIMIT = "(VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for a, b, c, e in E.LIMITS) + ") lim(dim, lim, warn, report)"
POSITIONS = lambda spark, d: table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("entity_id"), F.lit(4.0).alias("duration"))


def _trades(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_suppkey") % 40).alias("netting_set"), (F.col("l_partkey") % 5).alias("hedging_set"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("value"), (F.col("l_tax") * 1000).alias("collateral"), F.col("l_extendedprice").alias("notional"), F.lit(0.005).alias("factor"), F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0).alias("delta"))


def _transactions(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("tx_id"), F.col("user_id").alias("src"), F.pmod(F.col("event_id") * 7919 + F.col("user_id") * 31, F.lit(150)).alias("dst"), F.col("value").alias("amount"), F.col("event_type").alias("channel"), (F.col("user_id") % 7).alias("jurisdiction"))


TX = "tx AS (SELECT event_id AS tx_id, user_id AS src, (event_id * 7919 + user_id * 31) % 150 AS dst, value AS amount, event_type AS channel, user_id % 7 AS jurisdiction FROM events)"


def _stakes(spark, d):
    """Every customer is owned by the two of twice its number plus 1 and 2; numbers without a customer have no owner."""
    return _stakes_of(table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


def _stakes_of(c):
    return c.select((F.col("k") * 2 + 1).alias("owner"), F.col("k").alias("owned"), F.lit(0.6).alias("pct")).unionByName(c.select((F.col("k") * 2 + 2).alias("owner"), F.col("k").alias("owned"), F.lit(0.4).alias("pct")))


def _alerts(spark, d):
    return table(spark, d, "events").select("event_id", ((F.col("user_id") % 100) / 100.0).alias("score"), F.when(F.col("event_id") % 5 != 0, F.col("value") > 100 - F.col("user_id")).alias("outcome"))


ALERTS = "al AS (SELECT event_id, (user_id % 100) / 100.0::DOUBLE AS score, CASE WHEN event_id % 5 <> 0 THEN value > 100 - user_id END AS outcome FROM events)"

QUERIES: dict[str, Query] = {
    "LE01_lc_groups": (_groups, EV + " SELECT id, rep FROM gr"),
    "LE02_connected_parties": (
        lambda spark, d: E.connected_parties(table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") % 50 == 0).alias("is_connected")), _relations(spark, d), AT),
        "SELECT c_custkey AS id FROM customer WHERE c_custkey % 50 = 0 UNION SELECT c_custkey + 7 FROM customer WHERE c_custkey % 25 = 0",
    ),
    "LE03_measures": (
        lambda spark, d: _events(spark, d).select("event_id", r(E.before_crm(F.col("amount"), F.col("crm_reduction") * 5)).alias("before"), r(E.after_crm(F.col("amount"), F.col("crm_reduction"))).alias("after")),
        f"SELECT o_orderkey AS event_id, {rs('greatest(o_totalprice - o_totalprice * 0.25::DOUBLE * 5, 0)')} AS before, {rs('greatest(o_totalprice - o_totalprice * 0.25::DOUBLE, 0)')} AS after FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
    "LE04_ledger_keys": (lambda spark, d: _ledger(spark, d).groupBy("dim", "measure").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys")), EV + " SELECT dim, measure, count(*) AS n, count(DISTINCT key) AS keys FROM led GROUP BY ALL"),
    "LE05_point_exposure": (lambda spark, d: _rounded(E.point_exposure(_ledger(spark, d), AT), "exposure", digits=2), EV + f" SELECT dim, key, measure, {rs('exposure', 2)} AS exposure FROM pt"),
    "LE06_period_max": (lambda spark, d: _rounded(E.period_max(_ledger(spark, d), START, END), "peak", digits=2), EV + f" SELECT dim, key, measure, {rs('peak', 2)} AS peak, peak_at FROM pk"),
    "LE07_corrections": (
        lambda spark, d: E.current_events(_events(spark, d).withColumn("corrects", F.when(F.col("event_id") % 9 == 0, F.col("event_id") - 1))).agg(F.count("*").alias("n"), r(F.sum("amount"), 2).alias("total")),
        EV + f" SELECT count(*) AS n, {rs('sum(amount)', 2)} AS total FROM ev WHERE event_id NOT IN (SELECT event_id - 1 FROM ev WHERE event_id % 9 = 0)",
    ),
    "LE08_report": (
        lambda spark, d: _rounded(E.report_parts(_ledger(spark, d), START, END, TIER1, 0.05, 10), "peak", digits=2),
        EV + f""", rep AS (SELECT 'I' AS part, key, measure, peak, peak_at FROM pk WHERE dim = 'lc_group' AND measure = 'after' AND peak >= 0.05 * {TIER1} UNION ALL SELECT 'II', key, measure, peak, peak_at FROM pk WHERE dim = 'lc_group' AND measure = 'before' AND peak >= 0.05 * {TIER1}
UNION ALL SELECT 'III', key, measure, peak, peak_at FROM pk WHERE dim = 'lc_group' AND measure = 'exempted' AND peak >= 0.05 * {TIER1} UNION ALL SELECT 'IV', key, measure, peak, peak_at FROM pk WHERE dim = 'connected_party' AND measure = 'after' AND peak >= 0
UNION ALL SELECT 'V', key, measure, peak, peak_at FROM (SELECT *, row_number() OVER (ORDER BY peak DESC, key) AS rk FROM pk WHERE dim = 'entity' AND measure = 'after') WHERE rk <= 10) SELECT part, key, measure, {rs('peak', 2)} AS peak, peak_at FROM rep""",
    ),
    "LE09_ratios": (
        lambda spark, d: _rounded(E.ratios(E.point_exposure(_ledger(spark, d), AT), TIER1), "exposure", "ratio", "headroom"),
        EV + f" SELECT dim, key, {rs('exposure', 4)} AS exposure, {rs(f'exposure / {TIER1}', 4)} AS ratio, {rs(f'lim * {TIER1} - exposure', 4)} AS headroom, CASE WHEN exposure / {TIER1} >= lim THEN 'breach' WHEN exposure / {TIER1} >= warn THEN 'warn' WHEN exposure / {TIER1} >= report THEN 'reportable' ELSE 'ok' END AS status FROM pt JOIN {LIMIT} USING (dim) WHERE measure = 'after'",
    ),
    "LE10_breach_scan": (
        lambda spark, d: _rounded(E.breach_scan(_ledger(spark, d), START, END, TIER1), "peak", "ratio"),
        EV + f", g AS (SELECT *, row_number() OVER (ORDER BY peak DESC, key) AS rank FROM pk WHERE dim = 'lc_group' AND measure = 'after') SELECT rank::INT AS rank, key, {rs('peak', 4)} AS peak, {rs(f'peak / {TIER1}', 4)} AS ratio, peak_at FROM g WHERE rank <= 20 OR peak / {TIER1} >= 0.1",
    ),
    "LE11_concentration": (lambda spark, d: _rounded(E.concentration(_ledger(spark, d), "country", AT, TIER1), "exposure", "ratio", "share"), EV + f" SELECT key, {rs('exposure', 4)} AS exposure, {rs(f'exposure / {TIER1}', 4)} AS ratio, {rs('exposure / sum(exposure) OVER ()', 4)} AS share FROM pt WHERE dim = 'country' AND measure = 'after'"),
    "LE12_pre_trade_check": (
        lambda spark, d: _rounded(E.pre_trade_check(_ledger(spark, d), _groups(spark, d), 81, 5e6, AT, TIER1), "current", "projected", "ratio"),
        EV + f""", o AS (SELECT 'entity' AS dim, '81' AS key UNION ALL SELECT 'lc_group', coalesce((SELECT rep FROM gr WHERE id = 81), 81)::VARCHAR), j AS (SELECT o.dim, o.key, coalesce(exposure, 0) AS e FROM o LEFT JOIN pt ON pt.dim = o.dim AND pt.key = o.key AND measure = 'after')
SELECT dim, key, {rs('e', 4)} AS current, {rs('e + 5e6', 4)} AS projected, {rs(f'(e + 5e6) / {TIER1}', 4)} AS ratio, (e + 5e6) / {TIER1} > 0.25 AS breach FROM j""",
    ),
    "LE14_sa_ccr": (
        lambda spark, d: _rounded(E.sa_ccr(_trades(spark, d)), "rc", "addon", "multiplier", "ead"),
        f"""WITH t AS (SELECT l_suppkey % 40 AS ns, l_partkey % 5 AS hs, l_extendedprice * (l_discount - 0.05::DOUBLE) AS v, l_tax * 1000 AS c, l_extendedprice * 0.005::DOUBLE * CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END AS a FROM lineitem),
s AS (SELECT ns, hs, sum(v) AS v, sum(c) AS c, abs(sum(a)) AS a FROM t GROUP BY ALL), n AS (SELECT ns, sum(v) - sum(c) AS net, sum(a) AS addon FROM s GROUP BY ns),
m AS (SELECT *, greatest(net, 0) AS rc, least(1.0, 0.05::DOUBLE + 0.95::DOUBLE * exp(least(net / (2 * 0.95::DOUBLE * addon), 0))) AS mu FROM n)
SELECT ns AS netting_set, {rs('rc', 4)} AS rc, {rs('addon', 4)} AS addon, {rs('mu', 4)} AS multiplier, {rs('1.4::DOUBLE * (rc + mu * addon)', 4)} AS ead FROM m""",
    ),
    "LE15_stress": (
        lambda spark, d: E.stressed(_events(spark, d), POSITIONS(spark, d), 0.02).groupBy("country").agg(r(F.sum("amount"), 2).alias("total")),
        EV + f" SELECT country, {rs('sum(amount * CASE WHEN entity_id % 3 = 0 THEN 1 - 4.0::DOUBLE * 0.02::DOUBLE ELSE 1 END)', 2)} AS total FROM ev GROUP BY country",
    ),
    "LE16_transaction_totals": (
        lambda spark, d: _rounded(E.transaction_totals(_transactions(spark, d), ["channel", "jurisdiction"]), "total", digits=2),
        f"WITH {TX} SELECT 'channel' AS dim, channel AS key, {rs('sum(amount)', 2)} AS total, count(*) AS n FROM tx GROUP BY 2 UNION ALL SELECT 'jurisdiction', jurisdiction::VARCHAR, {rs('sum(amount)', 2)}, count(*) FROM tx GROUP BY 2",
    ),
    "LE17_explanation_subgraph": (
        lambda spark, d: E.explanation_subgraph(_transactions(spark, d), spark.createDataFrame([(5,)], "id long"), 3),
        f"WITH RECURSIVE {TX}, w AS (SELECT 0 AS hop, 5::BIGINT AS id UNION SELECT hop + 1, tx.dst FROM w JOIN tx ON tx.src = w.id WHERE hop < 3), f AS (SELECT id, min(hop) AS hop FROM w GROUP BY id) SELECT tx_id, (hop + 1)::INT AS hop FROM tx JOIN f ON f.id = tx.src WHERE hop < 3",
    ),
    "LE18_beneficial_owners": (
        lambda spark, d: _rounded(E.beneficial_owners(_stakes(spark, d), 0.05), "share", digits=6),
        f"""WITH RECURSIVE s AS (SELECT c_custkey * 2 + 1 AS owner, c_custkey AS owned, 0.6::DOUBLE AS pct FROM customer UNION ALL SELECT c_custkey * 2 + 2, c_custkey, 0.4 FROM customer),
p AS (SELECT owned AS company, owner, pct AS share FROM s UNION ALL SELECT company, s.owner, share * pct FROM p JOIN s ON s.owned = p.owner)
SELECT company, owner, {rs('sum(share)')} AS share FROM p WHERE owner NOT IN (SELECT owned FROM s) GROUP BY company, owner HAVING sum(share) >= 0.05""",
    ),
    "LE19_hybrid_score": (
        lambda spark, d: _alerts(spark, d).select("event_id", r(E.hybrid_score([F.col("score"), F.col("score") * 2 - 0.5], [0.3, 0.7])).alias("hybrid")),
        f"WITH {ALERTS} SELECT event_id, {rs('least(greatest((0.3::DOUBLE * score + 0.7::DOUBLE * (score * 2 - 0.5::DOUBLE)) / (0.3::DOUBLE + 0.7::DOUBLE), 0), 1)')} AS hybrid FROM al",
    ),
    "LE19_false_positive_rate": (
        lambda spark, d: _rounded(E.false_positive_rate(_alerts(spark, d), "score", "outcome", 0.7), "rate"),
        f"WITH {ALERTS} SELECT count(*) AS alerts, count(*) FILTER (NOT outcome) AS false_positives, {rs('avg((NOT outcome)::INT)', 4)} AS rate FROM al WHERE outcome IS NOT NULL AND score >= 0.7::DOUBLE",
    ),
    "LE19_suggest_threshold": (
        lambda spark, d: E.suggest_threshold(_alerts(spark, d), "score", "outcome", 0.5),
        f"WITH {ALERTS}, g AS (SELECT k, (SELECT coalesce(avg((NOT outcome)::INT), 0) FROM al WHERE outcome IS NOT NULL AND floor(score * 20 + 1e-9) >= k) AS rate FROM (SELECT unnest(range(21)) AS k)) SELECT min(k) / 20.0::DOUBLE AS threshold FROM g WHERE rate <= 0.5",
    ),
    "LE20_case_snapshot": (lambda spark, d: E.case_snapshot(_transactions(spark, d), "jurisdiction", "tx_id").select("jurisdiction", F.length("digest").alias("n")), f"WITH {TX} SELECT DISTINCT jurisdiction, 64 AS n FROM tx"),
}
