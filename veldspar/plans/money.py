"""TRD and RSK rows: simulators over bars, and banking operators over orders, nations and line items."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from veldspar.functions.series import block_mavg
from veldspar.operators import banking as B
from veldspar.operators import trading as T

from ._base import BARS, Query, W, bars, last, r, rs, series, table
from .values import _cdf


def _orders_stream(spark, d):
    e = bars(spark, d)
    return e.select("sym", "event_id", (F.col("event_id") % 2).cast("int").alias("side"), (F.col("event_id") % 3 == 0).cast("int").alias("is_mkt"), "c", (F.col("event_id") % 90 + 10).alias("qty")).withColumnRenamed("c", "price")


def _messages(spark, d):
    """Every order is added; a third of them is cancelled, a third executed in part, later."""
    e = bars(spark, d).select("sym", F.col("event_id").alias("order_id"), (F.col("event_id") % 2).cast("int").alias("side"), F.col("c").alias("price"), (F.col("event_id") % 90 + 10).alias("qty"))
    add = e.withColumns({"action": F.lit(0), "seq": F.col("order_id")})
    later = e.where("order_id % 3 < 2").withColumns({"action": (F.col("order_id") % 3 + 1).cast("int"), "seq": F.col("order_id") + 100_000_000, "qty": F.col("qty") - 7})
    return add.unionByName(later)


def _signals(spark, d):
    s = series(spark, d)
    return s.put("m", F.avg("c").over(s.last(10))).df.select("sym", F.col("t").alias("ts"), (F.col("c") + 100).alias("close"), F.when(F.col("c") > F.col("m") * 1.2, 1).when(F.col("c") < F.col("m") * 0.5, -1).otherwise(0).alias("signal"))


def _fills(spark, d):
    return T.backtest(_signals(spark, d), ["sym"], cost_bps=10, stop=0.2, take=0.3)


def _days(spark, d):
    return T.portfolio(_signals(spark, d).withColumn("book", F.lit("all")), ["book"], "sym", cost_bps=5)


def _cells(spark, d):
    """Line items as cash flows: the bucket is the ship date's day, returns are outflows."""
    li = table(spark, d, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("Principal", "Interest", "Deposit", "Optionality"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return li.select(F.col("l_returnflag").alias("scenario_id"), F.element_at(F.array(*map(F.lit, ("USD", "EUR", "HKD"))), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("currency"), F.col("l_partkey").alias("product"), F.abs(day).alias("time_bucket"), kind.alias("cashflow_type"), F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("amount"), F.abs(day).alias("repricing_date"))


CELLS = """WITH cells AS (SELECT l_returnflag AS scenario_id, ['USD', 'EUR', 'HKD'][(l_suppkey % 3 + 1)::INT] AS currency, l_partkey AS product, abs(date_diff('day', DATE '1995-01-01', l_shipdate::DATE)) AS time_bucket,
  ['Principal', 'Interest', 'Deposit', 'Optionality'][l_linenumber % 4 + 1] AS cashflow_type, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS amount, abs(date_diff('day', DATE '1995-01-01', l_shipdate::DATE)) AS repricing_date FROM lineitem)"""
CURVE = [(30, 0.02), (365, 0.025), (1825, 0.03), (3650, 0.035)]


def _zero(t: str, curve: list[tuple[float, float]] = CURVE) -> str:
    out = repr(curve[-1][1]) + "::DOUBLE"
    for (a, x), (b, y) in reversed(list(zip(curve, curve[1:], strict=False))):
        out = f"CASE WHEN {t} < {b} THEN {x!r}::DOUBLE + {y - x!r}::DOUBLE * ({t} - {a}) / {float(b - a)!r}::DOUBLE ELSE {out} END"
    return f"(CASE WHEN {t} <= {curve[0][0]} THEN {curve[0][1]!r}::DOUBLE ELSE {out} END)"


def _df(t: str, curve: list[tuple[float, float]] = CURVE) -> str:
    return f"exp(-{_zero(t, curve)} * {t} / 365.0::DOUBLE)"


def _caps(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * 30.0).alias("a"), (F.lit(0.02) + F.col("p_size") / 2500.0).alias("k"), F.lit(0.25).alias("vol"))


def _black(name: str, rows: str, f: str, k: str, vol: str, years: str, df: str) -> str:
    """Steps of a WITH over rows (p_partkey, ...): name(p_partkey, call, put) by Black's formula."""
    return f"""{name}_f AS (SELECT p_partkey, {f} AS f, {k} AS k, {vol} * sqrt({years}) AS root, {df} AS df FROM {rows}),
{name}_d AS (SELECT *, f > 0 AS live, CASE WHEN f > 0 THEN (ln(f / k) + 0.5::DOUBLE * root * root) / root END AS d1 FROM {name}_f), {name}_e AS (SELECT *, d1 - root AS d2 FROM {name}_d),
{name} AS (SELECT p_partkey, df * CASE WHEN live THEN f * {_cdf('d1')} - k * {_cdf('d2')} ELSE greatest(f - k, 0) END AS call, df * CASE WHEN live THEN k * {_cdf('-d2')} - f * {_cdf('-d1')} ELSE greatest(k - f, 0) END AS put FROM {name}_e)"""


def _cap_steps(name: str, strike: str, vol: float, curve: list[tuple[float, float]] = CURVE) -> str:
    tau = "(90 / 365.0::DOUBLE)"
    return f"{name}_r AS (SELECT p_partkey, p_size, p_size * 30.0::DOUBLE AS a, p_size * 30.0::DOUBLE + 90 AS b FROM part), {name}_s AS (SELECT *, {_df('a', curve)} AS da, {_df('b', curve)} AS db FROM {name}_r), " + _black(name, f"{name}_s", f"(da / db - 1) / {tau}", strike, f"{vol!r}::DOUBLE", "a / 365.0::DOUBLE", f"{tau} * da")


STRIKE = "0.02::DOUBLE + p_size / 2500.0::DOUBLE"
ANNUITY = " + ".join(_df(str(t)) for t in (730, 1095, 1460))
SWAP = "WITH sw AS (SELECT p_partkey, p_size, " + ANNUITY + f" AS ann, {_df('365')} AS d0, {_df('1460')} AS d3 FROM part), " + _black("o", "sw", "(d0 - d3) / ann", STRIKE, "0.3::DOUBLE", "1.0::DOUBLE", "ann")
RISK_SCENARIOS = ("parallel_up", "parallel_down", "steepener", "flattener", "short_up", "short_down")


def _shifted(scenario: str) -> list[tuple[float, float]]:
    """The curve after a shock of Hong Kong dollars."""
    parallel, short, long_ = (x / 1e4 for x in B.SHOCKS_2026["HKD"])
    out = []
    for t, x in CURVE:
        decay = math.exp(-t / 365 / 4)
        moves = (parallel, -parallel, -0.65 * short * decay + 0.9 * long_ * (1 - decay), 0.8 * short * decay - 0.6 * long_ * (1 - decay), short * decay, -short * decay)
        out.append((t, max(x + moves[RISK_SCENARIOS.index(scenario)], -0.02)))
    return out


def _option_risk(spark, d):
    price = lambda curve, vol: B.caplet(curve, F.col("a"), F.col("a") + 90, F.col("k"), vol)
    return B.option_risk(_caps(spark, d), price, CURVE, "HKD").select("scenario", r("base", 4).alias("base"), r("shocked", 4).alias("shocked"), r("risk", 4).alias("risk"))


OPTION_RISK = "WITH " + ", ".join([_cap_steps("base0", STRIKE, 0.25), *(_cap_steps(x, STRIKE, 0.3125, _shifted(x)) for x in RISK_SCENARIOS)]) + " " + " UNION ALL ".join(f"SELECT '{x}' AS scenario, {rs('b', 4)} AS base, {rs('s', 4)} AS shocked, {rs('b - s', 4)} AS risk FROM (SELECT (SELECT sum(call) FROM base0) AS b, (SELECT sum(call) FROM {x}) AS s)" for x in RISK_SCENARIOS)


def _tree(spark, d):
    """region -> nation -> customer, all in one id space."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    up = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    low = c.select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"))
    return up.unionByName(low).select("parent", "child", F.lit(0).cast("long").alias("valid_from"), F.lit(2**62).alias("valid_to"))


TREE = "tree AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"
SHOCKS = [("base", None, "rate", 0.01), ("base", None, "fx", 0.1), ("mid", "base", "rate", 0.02), ("mid", "base", "spread", 0.005), ("leaf", "mid", "fx", 0.3), ("other", None, "rate", 0.5)]


def _shocks(spark):
    return spark.createDataFrame(SHOCKS, "scenario_id string, parent_id string, factor string, value double")


def _master(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("valid_from"), F.lit(2**62).alias("valid_to"), "c_name", "c_mktsegment", F.concat(F.lit("n"), (F.col("c_nationkey") * 2).cast("string")).alias("home"))


def _nations(spark, d):
    return table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit(0).cast("long").alias("valid_from"), F.lit(2**62).alias("valid_to"))


YEARS = "y"


def _shock_sql(s: str) -> str:
    p, sh, lo = (x / 10_000 for x in B.SHOCKS_2026["HKD"])
    decay = "exp(-y / 4.0::DOUBLE)"
    return {"parallel_up": f"{p!r}::DOUBLE", "parallel_down": f"-({p!r}::DOUBLE)", "short_up": f"{sh!r}::DOUBLE * {decay}", "short_down": f"-({sh!r}::DOUBLE) * {decay}", "steepener": f"-0.65::DOUBLE * {sh!r}::DOUBLE * {decay} + 0.9::DOUBLE * {lo!r}::DOUBLE * (1 - {decay})", "flattener": f"0.8::DOUBLE * {sh!r}::DOUBLE * {decay} - 0.6::DOUBLE * {lo!r}::DOUBLE * (1 - {decay})"}[s]


MIDS = ", ".join(f"({m!r}::DOUBLE)" for m in map(float, B.BAND_MIDPOINTS))
EVE = CELLS + f""", near AS (SELECT amount, (SELECT m FROM (VALUES {MIDS}) b(m) ORDER BY abs(time_bucket / 365.0::DOUBLE - m), m LIMIT 1) AS y FROM (SELECT time_bucket, sum(amount) AS amount FROM cells GROUP BY time_bucket) c),
bd AS (SELECT y, sum(amount) AS cf, {_zero('(y * 365)')} AS z FROM near GROUP BY y)
""" + " UNION ALL ".join(f"SELECT '{s}' AS scenario, {rs(f'greatest(sum(cf * exp(-z * y) - cf * exp(-greatest(z + ({_shock_sql(s)}), -0.02::DOUBLE) * y)), 0)', 2)} AS delta_eve FROM bd" for s in B.SCENARIOS)


def _eve(spark, d):
    return B.irrbb_eve(_cells(spark, d), "HKD", CURVE).select("scenario", r("delta_eve", 2).alias("delta_eve"))


def _products(spark):
    return spark.createDataFrame([("loan", "mortgage"), ("mortgage", "fixed"), ("loan", "card")], "parent string, child string")


POLICY = [("loan", "liquidity", 0.002), ("mortgage", "liquidity", 0.003), ("fixed", "basis", 0.0004), ("*", "basis", 0.0001), ("*", "optionality", 0.0005), ("card", "behavioural", 0.001)]


def _ftp(spark, d):
    o = table(spark, d, "orders")
    trades = o.select(F.col("o_orderkey").alias("trade_id"), F.element_at(F.array(*map(F.lit, ("fixed", "mortgage", "card", "loan", "odd"))), (F.col("o_custkey") % 5 + 1).cast("int")).alias("product"), (F.col("o_orderkey") % 4000).alias("days"))
    return B.ftp_price(trades, CURVE, spark.createDataFrame(POLICY, "product string, component string, spread double"), _products(spark))


FTP = f"""WITH tr AS (SELECT o_orderkey AS trade_id, ['fixed', 'mortgage', 'card', 'loan', 'odd'][(o_custkey % 5 + 1)::INT] AS product, o_orderkey % 4000 AS days FROM orders),
ftp AS (SELECT trade_id, {_zero('days')} + CASE product WHEN 'fixed' THEN 0.003::DOUBLE + 0.0004::DOUBLE WHEN 'mortgage' THEN 0.003::DOUBLE + 0.0001::DOUBLE WHEN 'card' THEN 0.002::DOUBLE + 0.0001::DOUBLE + 0.001::DOUBLE WHEN 'loan' THEN 0.002::DOUBLE + 0.0001::DOUBLE ELSE 0.0001::DOUBLE END + 0.0005::DOUBLE AS rate FROM tr)"""

QUERIES: dict[str, Query] = {
    "TRD01_tick_to_trade": (
        lambda spark, d: T.tick_to_trade(series(spark, d), "c", 20, block_mavg).df.select("event_id", "side", r("c").alias("price"), "qty"),
        BARS + f", m AS (SELECT *, c >= avg(c) OVER {last(20)} AS above FROM bars), s AS (SELECT *, lag(above) OVER {W} <> above AS cr FROM m) SELECT event_id, CASE WHEN cr AND above THEN 0 WHEN cr THEN 1 ELSE 2 END AS side, {rs('c')} AS price, CASE WHEN cr THEN 100 ELSE 0 END AS qty FROM s",
    ),
    "TRD02_match_orders": (lambda spark, d: T.match_orders(_orders_stream(spark, d), ["sym"], "event_id"), None),
    "TRD03_reconstruct_l2": (
        lambda spark, d: T.reconstruct_l2(_messages(spark, d), ["sym"], "seq", 5),
        BARS + """, o AS (SELECT sym, event_id % 2 AS side, floor(c * 100 + 0.5) AS cents, CASE WHEN event_id % 3 = 1 THEN 7 ELSE event_id % 90 + 10 END AS qty FROM bars WHERE event_id % 3 <> 0),
l AS (SELECT sym, side, cents, sum(qty) AS qty FROM o GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY sym, side ORDER BY CASE WHEN side = 0 THEN -cents ELSE cents END) AS level FROM l)
SELECT sym, side::INT AS side, level::INT AS level, cents / 100.0::DOUBLE AS price, qty::BIGINT AS qty FROM k WHERE level <= 5""",
    ),
    "TRD04_backtest": (lambda spark, d: _fills(spark, d).select("sym", "entry_ts", "exit_ts", "side", r("net").alias("net"), "reason"), None),
    "TRD05_backtest_report": (lambda spark, d: T.backtest_report(_fills(spark, d), ["sym"]), None),
    "TRD06_portfolio": (lambda spark, d: _days(spark, d).select("ts", r("nav").alias("nav"), r("ret").alias("ret"), "n_active", r("turnover").alias("turnover")), None),
    "TRD07_portfolio_report": (lambda spark, d: T.portfolio_report(_days(spark, d), ["book"]), None),
    "RSK01_resolve_scenario": (lambda spark, d: B.resolve_scenario(_shocks(spark), "leaf"), "SELECT * FROM (VALUES ('rate', 0.02::DOUBLE, 'mid'), ('spread', 0.005::DOUBLE, 'mid'), ('fx', 0.3::DOUBLE, 'leaf')) t(factor, value, source)"),
    "RSK02_scenario_diff": (
        lambda spark, d: B.scenario_diff(_shocks(spark).where("scenario_id = 'base'"), _shocks(spark).where("scenario_id = 'mid'")),
        "SELECT * FROM (VALUES ('rate', 0.01::DOUBLE, 0.02::DOUBLE, 'changed'), ('fx', 0.1::DOUBLE, NULL, 'removed'), ('spread', NULL, 0.005::DOUBLE, 'added')) t(factor, before, after, change)",
    ),
    "RSK03_descendants": (lambda spark, d: B.descendants(_tree(spark, d), "r1", 5), f"WITH RECURSIVE {TREE}, w AS (SELECT child, 1 AS distance FROM tree WHERE parent = 'r1' UNION SELECT tree.child, distance + 1 FROM w JOIN tree ON tree.parent = w.child) SELECT child AS descendant, distance FROM w"),
    "RSK03_ancestors": (lambda spark, d: B.ancestors(_tree(spark, d), "c7", 5), f"WITH RECURSIVE {TREE}, w AS (SELECT parent, 1 AS distance FROM tree WHERE child = 'c7' UNION SELECT tree.parent, distance + 1 FROM w JOIN tree ON tree.child = w.parent) SELECT parent AS ancestor, distance FROM w"),
    "RSK04_hierarchy_faults": (
        lambda spark, d: B.hierarchy_faults(_tree(spark, d).unionByName(_tree(spark, d).where("child = 'n3'")).unionByName(spark.createDataFrame([("x", "x", 0, 5)], "parent string, child string, valid_from long, valid_to long"))),
        "SELECT 'self' AS fault, 'x' AS parent, 'x' AS child UNION ALL SELECT 'overlap', 'r' || n_regionkey, 'n3' FROM nation WHERE n_nationkey = 3",
    ),
    "RSK05_rollup": (
        lambda spark, d: B.rollup(table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_acctbal").alias("value")), _tree(spark, d), 5).select("node", r("total", 2).alias("total")),
        f"SELECT node, {rs('sum(v)', 2)} AS total FROM (SELECT 'c' || c_custkey AS node, c_acctbal AS v FROM customer UNION ALL SELECT 'n' || c_nationkey, c_acctbal FROM customer UNION ALL SELECT 'r' || n_regionkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY node",
    ),
    "RSK06_master_get": (lambda spark, d: B.master_get(_master(spark, d), 12, 5), "SELECT unnest(['c_name', 'c_mktsegment', 'home']) AS attribute, unnest([c_name, c_mktsegment, 'n' || (c_nationkey * 2)]) AS value FROM customer WHERE c_custkey = 12"),
    "RSK07_unresolved": (lambda spark, d: B.unresolved(_master(spark, d), "home", _nations(spark, d), 5).select("id", "home"), "SELECT c_custkey AS id, 'n' || (c_nationkey * 2) AS home FROM customer WHERE c_nationkey * 2 NOT IN (SELECT n_nationkey FROM nation)"),
    "RSK08_cashflow_ladder": (lambda spark, d: B.cashflow_ladder(_cells(spark, d)).select("time_bucket", r("amount", 2).alias("amount")), CELLS + f" SELECT time_bucket, {rs('sum(amount)', 2)} AS amount FROM cells GROUP BY time_bucket"),
    "RSK08_nii": (lambda spark, d: B.nii(_cells(spark, d), 365).select(r("nii", 2).alias("nii")), CELLS + f" SELECT {rs('sum(amount)', 2)} AS nii FROM cells WHERE cashflow_type = 'Interest' AND time_bucket <= 365"),
    "RSK08_eve": (lambda spark, d: B.eve(_cells(spark, d), CURVE).select(r("eve", 2).alias("eve")), CELLS + f" SELECT {rs('sum(amount * ' + _df('time_bucket') + ')', 2)} AS eve FROM cells"),
    "RSK09_repricing_gap": (
        lambda spark, d: B.repricing_gap(_cells(spark, d), [10, 180, 365, 9000]).select("bucket", r("gap", 2).alias("gap")),
        CELLS + f", e AS (SELECT unnest([10, 180, 365, 9000])::BIGINT AS bucket), g AS (SELECT (SELECT max(bucket) FROM e WHERE bucket <= repricing_date) AS bucket, amount FROM cells WHERE cashflow_type = 'Principal') SELECT e.bucket, {rs('coalesce(sum(amount), 0)', 2)} AS gap FROM e LEFT JOIN g ON g.bucket = e.bucket GROUP BY e.bucket",
    ),
    "RSK10_liquidity_stress": (
        lambda spark, d: B.liquidity_stress(_cells(spark, d), 0.1, 0.2, 0.05).select("time_bucket", r("cumulative", 2).alias("cumulative")),
        CELLS + f", s AS (SELECT time_bucket, sum(CASE WHEN cashflow_type = 'Deposit' THEN amount - abs(amount) * 0.1::DOUBLE WHEN amount < 0 THEN amount * 1.2::DOUBLE ELSE amount * 0.95::DOUBLE END) AS x FROM cells GROUP BY 1) SELECT time_bucket, {rs('sum(x) OVER (ORDER BY time_bucket)', 2)} AS cumulative FROM s",
    ),
    "RSK11_deposit_decay": (
        lambda spark, d: B.cashflow_ladder(B.deposit_decay(_cells(spark, d), [0.7, 0.4, 0.4, 0.1], 30).where("cashflow_type = 'Deposit'")).select("time_bucket", r("amount", 2).alias("amount")),
        CELLS + f", g AS (SELECT time_bucket + days AS time_bucket, amount * share AS amount FROM cells, (VALUES (30, {1.0 - 0.7!r}::DOUBLE), (60, {0.7 - 0.4!r}::DOUBLE), (120, {0.4 - 0.1!r}::DOUBLE)) p(days, share) WHERE cashflow_type = 'Deposit') SELECT time_bucket, {rs('sum(amount)', 2)} AS amount FROM g GROUP BY 1",
    ),
    "RSK11_prepayment": (
        lambda spark, d: B.prepayment(_cells(spark, d), 0.2, 90).groupBy("cashflow_type").agg(F.count("*").alias("n"), r(F.sum("amount"), 2).alias("amount"), F.sum("time_bucket").alias("days")),
        CELLS + f", p AS (SELECT cashflow_type, time_bucket, CASE WHEN cashflow_type = 'Principal' AND amount > 0 THEN amount - amount * 0.2::DOUBLE ELSE amount END AS amount FROM cells UNION ALL SELECT 'Prepayment', greatest(time_bucket - 90, 0), amount * 0.2::DOUBLE FROM cells WHERE cashflow_type = 'Principal' AND amount > 0) SELECT cashflow_type, count(*) AS n, {rs('sum(amount)', 2)} AS amount, sum(time_bucket)::BIGINT AS days FROM p GROUP BY 1",
    ),
    "RSK12_currency": (
        lambda spark, d: B.currency_breakdown(_cells(spark, d), spark.createDataFrame([("USD", 7.8), ("EUR", 8.5)], "currency string, rate double")).select("currency", r("amount", 2).alias("amount")),
        CELLS + f" SELECT currency, {rs('''sum(amount) * CASE currency WHEN 'USD' THEN 7.8::DOUBLE WHEN 'EUR' THEN 8.5::DOUBLE ELSE 1 END''', 2)} AS amount FROM cells GROUP BY currency",
    ),
    "RSK12_optionality": (lambda spark, d: B.optionality_charge(_cells(spark, d)).select(r("charge", 2).alias("charge")), CELLS + f" SELECT {rs('sum(amount)', 2)} AS charge FROM cells WHERE cashflow_type = 'Optionality'"),
    "RSK13_discount_curve": (
        lambda spark, d: spark.range(0, 5000, 7).select("id", r(B.zero_rate(CURVE, F.col("id"))).alias("zero"), r(B.discount(CURVE, F.col("id"))).alias("df")),
        f"SELECT id, {rs(_zero('id'))} AS zero, {rs(_df('id'))} AS df FROM (SELECT unnest(range(0, 5000, 7)) AS id)",
    ),
    "RSK14_irrbb_eve": (_eve, EVE),
    "RSK15_shocks": (
        lambda spark, d: spark.range(0, 30).select("id", *(r(B.shocked_rate(F.lit(0.01), s, "HKD", F.col("id").cast("double"))).alias(s) for s in B.SCENARIOS)),
        "SELECT id, " + ", ".join(f"{rs(f'greatest(0.01::DOUBLE + ({_shock_sql(s)}), -0.02::DOUBLE)')} AS {s}" for s in B.SCENARIOS) + " FROM (SELECT id, id::DOUBLE AS y FROM (SELECT unnest(range(30)) AS id))",
    ),
    "RSK16_time_bands": (lambda spark, d: B.time_bands(spark).select("band", r("midpoint", 4).alias("midpoint")), f"SELECT (row_number() OVER () - 1)::INT AS band, {rs('m', 4)} AS midpoint FROM (VALUES {MIDS}) b(m)"),
    "RSK17_nmd_split": (
        lambda spark, d: B.nmd_split(table(spark, d, "customer"), "c_acctbal", 0.9, 0.7).select("c_custkey", r("core", 4).alias("core"), r("non_core", 4).alias("non_core")),
        f"SELECT c_custkey, {rs('c_acctbal * 0.7::DOUBLE', 4)} AS core, {rs('c_acctbal - c_acctbal * 0.7::DOUBLE', 4)} AS non_core FROM customer",
    ),
    "RSK17_prepayment_bands": (lambda spark, d: table(spark, d, "supplier").select("s_suppkey", F.explode(B.prepayment_bands(F.array(*(F.col("s_acctbal") * x for x in (0.2, 0.3, 0.5))), 0.1)).alias("cf")).groupBy("s_suppkey").agg(r(F.sum("cf"), 4).alias("total")), None),
    "RSK18_caplet": (lambda spark, d: table(spark, d, "part").select("p_partkey", r(B.caplet(CURVE, F.col("p_size") * 30.0, F.col("p_size") * 30.0 + 90, F.lit(0.03), F.lit(0.25))).alias("cap"), r(B.caplet(CURVE, F.col("p_size") * 30.0, F.col("p_size") * 30.0 + 90, F.lit(0.03), F.lit(0.25), False)).alias("floor")), "WITH " + _cap_steps("o", "0.03::DOUBLE", 0.25) + f" SELECT p_partkey, {rs('call')} AS cap, {rs('put')} AS floor FROM o"),
    "RSK19_swaption": (lambda spark, d: table(spark, d, "part").select("p_partkey", r(B.swaption(CURVE, F.lit(365.0), [730, 1095, 1460], F.lit(0.02) + F.col("p_size") / 2500.0, F.lit(0.3))).alias("payer")), SWAP + f" SELECT p_partkey, {rs('call')} AS payer FROM o"),
    "RSK20_option_risk": (_option_risk, OPTION_RISK),
    "RSK21_ftp_price": (lambda spark, d: _ftp(spark, d).select("trade_id", r("rate").alias("rate")), FTP + f" SELECT trade_id, {rs('rate')} AS rate FROM ftp"),
    "RSK22_ftp_reconcile": (
        lambda spark, d: B.ftp_reconcile(_ftp(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("trade_id"), (F.col("o_orderkey") % 40 / 1000.0).alias("actual")), 0.005).agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("ok"), r(F.sum("difference"), 4).alias("total")),
        FTP + f" SELECT count(*) AS n, count(*) FILTER (abs(trade_id % 40 / 1000.0::DOUBLE - rate) <= 0.005::DOUBLE) AS ok, {rs('sum(trade_id % 40 / 1000.0::DOUBLE - rate)', 4)} AS total FROM ftp",
    ),
}
