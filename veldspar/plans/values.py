"""SC and AGG rows: scalar functions, aggregates, bars and alignment."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from veldspar.functions import scalars as C
from veldspar.functions.series import ieee
from veldspar.operators import aggregates as A

from ._base import BARS, Query, W, bars, nanos, r, rs, series, table

OPTIONS = """WITH q AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'Put' END AS kind, p_retailprice AS s, 900 + (p_partkey % 50) * 10.0::DOUBLE AS k,
  CASE WHEN p_partkey % 17 = 0 THEN 0.0::DOUBLE ELSE p_size / 25.0::DOUBLE END AS t, 0.03::DOUBLE AS r, CASE WHEN p_partkey % 19 = 0 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE + (p_partkey % 7) / 20.0::DOUBLE END AS v FROM part),
d AS (SELECT *, t > 0 AND v > 0 AS live, lower(kind[1]) = 'c' AS call, CASE WHEN t > 0 AND v > 0 THEN (ln(s / k) + (r + 0.5::DOUBLE * v * v) * t) / (v * sqrt(t)) END AS d1 FROM q),
e AS (SELECT *, d1 - v * sqrt(t) AS d2, exp(-r * t) AS df, exp(-0.5::DOUBLE * d1 * d1) / sqrt(2 * pi()) AS pdf FROM d)"""


def _cdf(x: str) -> str:
    z = f"(abs({x}) / {math.sqrt(2)!r})"
    t = f"(1 / (1 + {C.ERF_P!r}::DOUBLE * {z}))"
    poly = "0.0::DOUBLE"
    for a in reversed(C.ERF_A):
        poly = f"(({poly} + {a!r}::DOUBLE) * {t})"
    return f"(0.5::DOUBLE * (1 + sign({x}) * (1 - {poly} * exp(-{z} * {z}))))"


def _options(spark, d):
    p, i = table(spark, d, "part"), F.col("p_partkey")
    return p.select(
        i.alias("id"), F.when(i % 2 == 0, "call").otherwise("Put").alias("kind"), F.col("p_retailprice").alias("s"), (900 + (i % 50) * 10.0).alias("k"),
        F.when(i % 17 == 0, 0.0).otherwise(F.col("p_size") / 25.0).alias("t"), F.lit(0.03).alias("r"), F.when(i % 19 == 0, 0.0).otherwise(0.1 + (i % 7) / 20.0).alias("v"),
    )


def _greek(name: str, sql: str) -> Query:
    return lambda spark, d: _options(spark, d).select("id", r(getattr(C.BlackScholes("kind", "s", "k", "t", "r", "v"), name)()).alias(name)), f"{OPTIONS} SELECT id, {rs(sql)} AS {name} FROM e"


STEP = "CASE WHEN call THEN (s > k)::INT::DOUBLE ELSE -(s < k)::INT::DOUBLE END"
T = "epoch_us(ts) * 1000"
EVENTS = lambda spark, d: table(spark, d, "events").withColumn("t", nanos("ts"))
RETS = "r AS (SELECT event_id, sym, p, c / lag(c) OVER " + W + " - 1 AS ret FROM bars)"
HOUR = 3600 * 10**9


def _returns(spark, d):
    s = series(spark, d)
    return s.put("ret", ieee(F.col("c"), s.lag("c")) - 1).df.where(F.col("ret").isNotNull())


def _wide(spark, d):
    return bars(spark, d).select(F.col("c").alias("ret_0"), F.col("v").alias("ret_1"), F.col("x").alias("ret_2"), (F.col("c") * F.col("v") / 100).alias("ret_3"))


RETN = [f"ret_{i}" for i in range(4)]
WIDE = BARS + ", w AS (SELECT c AS ret_0, v AS ret_1, x AS ret_2, c * v / 100 AS ret_3 FROM bars)"


def _forecasts(spark, d):
    e = EVENTS(spark, d)
    return e.select("event_id", ((F.col("user_id") % 100) / 100.0 + 0.005).alias("p"), (F.col("value") > 35).cast("int").alias("y"))


QUERIES: dict[str, Query] = {
    "SC01_risk_ok": (
        lambda spark, d: bars(spark, d).select("event_id", C.risk_ok("c", F.col("v") * 100, F.col("x") * 0.9, F.col("event_id") % 5).alias("ok")),
        BARS + " SELECT event_id, abs(c - x * 0.9) <= 0.05 * (x * 0.9) AND v * 100 <= 10000 AND c * (v * 100) <= 10000000 AND event_id % 5 = 0 AS ok FROM bars",
    ),
    "SC02_micro_price": (lambda spark, d: bars(spark, d).select("event_id", r(C.micro_price("l", "h", "v", "x")).alias("mp")), BARS + f" SELECT event_id, {rs('(l * x + h * v) / (v + x)')} AS mp FROM bars"),
    "SC03_aggressor_flag": (
        lambda spark, d: table(spark, d, "events").select("event_id", C.aggressor_flag(F.when(F.col("event_type") == "click", "B").when(F.col("event_type") == "view", "SELL").when(F.col("event_type") == "error", "buy")).alias("flag")),
        "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END AS flag FROM events",
    ),
    "SC04_xbar": (lambda spark, d: EVENTS(spark, d).select("event_id", C.xbar(F.col("t") - 1704200000 * 10**9, HOUR).alias("bar")), f"SELECT event_id, ({T} - 1704200000000000000) - ({T} - 1704200000000000000) % {HOUR} AS bar FROM events"),
    "SC05_trunc_time": (
        lambda spark, d: EVENTS(spark, d).select("event_id", *(C.trunc_time("t", u).alias(u.lower()) for u in ("SS", "MI", "HH", "DD", "MM", "YYYY"))),
        "SELECT event_id, " + ", ".join(f"epoch_us(date_trunc('{n}', ts)::TIMESTAMP) * 1000 AS {u}" for u, n in (("ss", "second"), ("mi", "minute"), ("hh", "hour"), ("dd", "day"), ("mm", "month"), ("yyyy", "year"))) + " FROM events",
    ),
    "SC06_trunc_number": (
        lambda spark, d: table(spark, d, "events").select("event_id", C.trunc_number(F.col("value") - 50.5).alias("whole"), r(C.trunc_number(F.col("value") - 50.5, 1)).alias("tenth"), C.trunc_number(F.col("value") - 50.5, -1).alias("tens")),
        f"SELECT event_id, trunc(value - 50.5::DOUBLE) AS whole, {rs('sign(value - 50.5::DOUBLE) * (floor(abs(value - 50.5::DOUBLE) * 10) / 10)')} AS tenth, trunc((value - 50.5::DOUBLE) / 10) * 10 AS tens FROM events",
    ),
    "SC07_signal": (lambda spark, d: table(spark, d, "events").select("event_id", C.signal(F.col("value") - 50, 20, -30).alias("signal")), "SELECT event_id, CASE WHEN value - 50 >= 20 THEN 'buy' WHEN value - 50 <= -30 THEN 'sell' ELSE 'hold' END AS signal FROM events"),
    "SC08_bs_price": _greek("price", f"CASE WHEN NOT live THEN greatest(CASE WHEN call THEN s - k ELSE k - s END, 0) WHEN call THEN s * {_cdf('d1')} - k * df * {_cdf('d2')} ELSE k * df * {_cdf('(-d2)')} - s * {_cdf('(-d1)')} END"),
    "SC09_bs_delta": _greek("delta", f"CASE WHEN NOT live THEN {STEP} ELSE {_cdf('d1')} - CASE WHEN call THEN 0 ELSE 1 END END"),
    "SC10_bs_gamma": _greek("gamma", "CASE WHEN live THEN pdf / (s * v * sqrt(t)) ELSE 0 END"),
    "SC11_bs_vega": _greek("vega", "CASE WHEN live THEN s * pdf * sqrt(t) ELSE 0 END"),
    "SC12_bs_theta": _greek("theta", f"CASE WHEN NOT live THEN 0 WHEN call THEN -s * pdf * v / (2 * sqrt(t)) - r * k * df * {_cdf('d2')} ELSE -s * pdf * v / (2 * sqrt(t)) + r * k * df * {_cdf('(-d2)')} END"),
    "SC13_bs_rho": _greek("rho", f"CASE WHEN NOT live THEN 0 WHEN call THEN k * t * df * {_cdf('d2')} ELSE -k * t * df * {_cdf('(-d2)')} END"),
    "SC14_refdata_get": (
        lambda spark, d: C.refdata_get(
            EVENTS(spark, d).select("event_id", "event_type", (F.col("event_id") % 40).alias("at")),
            spark.createDataFrame([("fee", "click", 0, 10, "a"), ("fee", "click", 10, 2**62, "b"), ("fee", "view", 5, 20, "c"), ("tax", "error", 0, 100, "d")], "domain string, key string, valid_from long, valid_to long, value string"),
            "fee", "event_type", "at",
        ).select("event_id", "value"),
        "SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 40 < 10 THEN 'a' ELSE 'b' END WHEN event_type = 'view' AND event_id % 40 >= 5 AND event_id % 40 < 20 THEN 'c' END AS value FROM events",
    ),
    "SC15_vector_udf": (
        lambda spark, d: table(spark, d, "events").select("event_id", r(C.vector_udf(lambda x: x * 2 + 1)("value")).alias("y")),
        f"SELECT event_id, {rs('value * 2 + 1')} AS y FROM events",
    ),
    "AGG01_obi": (lambda spark, d: bars(spark, d).groupBy("sym").agg(r(A.order_book_imbalance("v", "x")).alias("obi")), BARS + f" SELECT sym, {rs('(sum(v) - sum(x)) / (sum(v) + sum(x))')} AS obi FROM bars GROUP BY sym"),
    "AGG02_covariance_matrix": (
        lambda spark, d: A.covariance_matrix(_wide(spark, d), RETN).select("i", "j", r("cov").alias("cov")),
        WIDE + " " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {rs(f'covar_samp(ret_{i}, ret_{j})')} AS cov FROM w" for i in range(4) for j in range(4)),
    ),
    "AGG03_pca": (lambda spark, d: A.pca(_wide(spark, d), RETN).select("component", r("eigenvalue", 4).alias("eigenvalue"), r("ratio").alias("ratio")), None),
    "AGG04_var_historical": (
        lambda spark, d: A.var_historical(_returns(spark, d), "ret", 95).select(r("var").alias("var")),
        BARS + "," + RETS + f", s AS (SELECT ret, row_number() OVER (ORDER BY ret) - 1 AS i, count(*) OVER () AS n FROM r WHERE ret IS NOT NULL) SELECT {rs('-ret')} AS var FROM s WHERE i = floor((n - 1) * (1 - 0.95::DOUBLE) + 0.5)",
    ),
    "AGG05_ohlc": (
        lambda spark, d: A.ohlc(bars(spark, d), "t", "c", HOUR, ["sym"], "v", "event_id").select("sym", "bar", "open", "high", "low", "close", r("volume").alias("volume")),
        BARS + f" SELECT sym, t - t % {HOUR} AS bar, arg_min(c, (t, event_id)) AS open, max(c) AS high, min(c) AS low, arg_max(c, (t, event_id)) AS close, {rs('sum(v)')} AS volume FROM bars GROUP BY ALL",
    ),
    "AGG06_align": (
        lambda spark, d: A.align(bars(spark, d), "t", "sym", "c", "v", HOUR // 4, seq="event_id").select("ts", "symbol", "close", r("volume").alias("volume"), "n_obs"),
        BARS + f""", b AS (SELECT sym, t - t % {HOUR // 4} AS ts, arg_max(c, (t, event_id)) AS close, sum(v) AS volume, count(*) AS n_obs FROM bars GROUP BY ALL),
g AS (SELECT sym, unnest(range(min(ts), max(ts) + 1, {HOUR // 4})) AS ts FROM b GROUP BY sym)
SELECT g.ts, g.sym AS symbol, last_value(close IGNORE NULLS) OVER (PARTITION BY g.sym ORDER BY g.ts) AS close, {rs('coalesce(volume, 0)')} AS volume, coalesce(n_obs, 0) AS n_obs FROM g LEFT JOIN b ON g.sym = b.sym AND g.ts = b.ts""",
    ),
    "AGG07_strategy_stats": (
        lambda spark, d: A.strategy_stats(_forecasts(spark, d), "p", "y", "event_id").select("n", *(r(c).alias(c) for c in ("hit_rate", "brier", "ece", "psi")), "strong_n", r("strong_hit").alias("strong_hit")),
        f"""WITH f AS (SELECT event_id, (user_id % 100) / 100.0::DOUBLE + 0.005::DOUBLE AS p, (value > 35)::INT AS y FROM events),
x AS (SELECT *, least(floor(p * 10), 9) AS bin, event_id <= (SELECT quantile_cont(event_id, 0.8) FROM f) AS early, (p >= 0.5) = (y = 1) AS hit, greatest(p, 1 - p) >= 0.7 AS strong FROM f),
b AS (SELECT g.bin, count(y) AS n, coalesce(abs(sum(p) - sum(y)), 0) AS gap, count(*) FILTER (early) AS a, count(*) FILTER (NOT early) AS e FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN x ON x.bin = g.bin GROUP BY g.bin),
t AS (SELECT *, (a + 0.5::DOUBLE) / (sum(a) OVER () + 5) AS pa, (e + 0.5::DOUBLE) / (sum(e) OVER () + 5) AS pe FROM b)
SELECT (SELECT count(*) FROM x) AS n, (SELECT {rs('avg(hit::INT)')} FROM x) AS hit_rate, (SELECT {rs('avg((p - y) ** 2)')} FROM x) AS brier, (SELECT {rs('sum(gap) / sum(n)')} FROM b) AS ece,
  (SELECT {rs('sum((pe - pa) * ln(pe / pa))')} FROM t) AS psi, (SELECT count(*) FROM x WHERE strong) AS strong_n, (SELECT {rs('avg(hit::INT)')} FROM x WHERE strong) AS strong_hit""",
    ),
}
