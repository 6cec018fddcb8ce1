"""FC rows, over four-hour bars of the event types."""

from __future__ import annotations

from veldspar.functions.series import Series, momentum
from veldspar.operators import aggregates as A
from veldspar.operators import forecast as FC

from ._base import BARS, Query, bars, r, rs

SPAN = 4 * 3600 * 10**9


def _bars(spark, d):
    return A.align(bars(spark, d), "t", "sym", "c", "v", SPAN, "drop", "event_id").select("symbol", "ts", "close")


DAY_BARS = BARS + f", db AS (SELECT sym AS symbol, t - t % {SPAN} AS ts, arg_max(c, (t, event_id)) AS close FROM bars GROUP BY ALL), mo AS (SELECT *, coalesce(close / lag(close, 5) OVER w - 1, 0) AS m, lead(close) OVER w / close - 1 AS nx FROM db WINDOW w AS (PARTITION BY symbol ORDER BY ts))"


def _relative(spark, d):
    b = _bars(spark, d)
    return FC.relative_strength(b.where("symbol = 'click'"), b.where("symbol = 'view'"), b.where("symbol IN ('error', 'signup', 'purchase')"), 5).select("ts", *(r(c).alias(c) for c in ("momentum", "vs_index", "vs_peers", "z")))


def _proba(spark, d):
    s = Series(_bars(spark, d), ("symbol",), ("ts",))
    s = momentum(momentum(s, "close", 1, "m1"), "close", 3, "m3")
    return FC.forward_probability(s.df, 2, 7, ["m1", "m3"]).select("symbol", "n", r("p_up").alias("p_up"), r("hit_rate").alias("hit_rate"))


def _features(spark, d):
    s = Series(_bars(spark, d), ("symbol",), ("ts",))
    return momentum(momentum(s, "close", 1, "m1"), "close", 3, "m3").df


WALK_COLUMNS = ("p_up", "actual_ret", "q05", "q25", "q50", "q90", "bar_ret", "vol20")
AS_OF = 1704844800 * 10**9
AS_OF_COLUMNS = ("p_up", "pred_lo", "pred_hi", "pred_ret", "act_lo", "act_hi", "act_ret")

#: Bars with both features, place and count; horizon 2.
FEATURES = BARS + f""", db AS (SELECT sym AS symbol, t - t % {SPAN} AS ts, arg_max(c, (t, event_id)) AS close FROM bars GROUP BY ALL),
fe AS (SELECT *, coalesce(close / lag(close, 1) OVER w - 1, 0) AS m1, coalesce(close / lag(close, 3) OVER w - 1, 0) AS m3, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n, lead(close, 2) OVER w AS ahead,
  coalesce(close / lag(close) OVER w - 1, 0) AS bar_ret FROM db WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
WALK = FEATURES + """, st AS (SELECT *, stddev_pop(m1) OVER q AS s1, stddev_pop(m3) OVER q AS s3, stddev_pop(CASE WHEN p > 0 THEN bar_ret END) OVER v AS vol FROM fe
  WINDOW q AS (PARTITION BY symbol ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), v AS (PARTITION BY symbol ORDER BY p ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
de AS (SELECT * FROM st WHERE p >= greatest(2 + greatest(1, least(60, greatest(n - 2 - 2 - 19, 1))) - 1, 3) AND p < n - 2),
nn AS (SELECT de.symbol, de.p, pa.close AS c0, pa.ahead AS c2, row_number() OVER (PARTITION BY de.symbol, de.p ORDER BY ((pa.m1 - de.m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END) ** 2 + ((pa.m3 - de.m3) / CASE WHEN s3 > 0 THEN s3 ELSE 1 END) ** 2, pa.p) AS k FROM de JOIN fe pa ON pa.symbol = de.symbol AND pa.p <= de.p - 2),
vo AS (SELECT symbol, p, avg((c2 > c0)::INT) AS p_up, list_sort(list(c2 / c0 - 1)) AS x, count(*) AS k FROM nn WHERE k <= 7 GROUP BY 1, 2),
wk AS (SELECT symbol, p AS idx, ts, (ahead > close)::INT::BIGINT AS up, vo.k AS n_analogs, p_up, ahead / close - 1 AS actual_ret, x[(floor(0.05::DOUBLE * (vo.k - 1) + 0.5) + 1)::INT] AS q05, x[(floor(0.25::DOUBLE * (vo.k - 1) + 0.5) + 1)::INT] AS q25,
  x[(floor(0.5::DOUBLE * (vo.k - 1) + 0.5) + 1)::INT] AS q50, x[(floor(0.9::DOUBLE * (vo.k - 1) + 0.5) + 1)::INT] AS q90, bar_ret, CASE WHEN p >= 3 THEN vol ELSE 0 END AS vol20 FROM de JOIN vo USING (symbol, p))"""
ASOF = FEATURES + f""", pf AS (SELECT *, count(*) FILTER (ts < {AS_OF} + 86400000000000) OVER (PARTITION BY symbol) - 1 AS e, min(close) OVER f / close - 1 AS lo, max(close) OVER f / close - 1 AS hi, last_value(close) OVER f / close - 1 AS ret, count(close) OVER f AS nf FROM fe
  WINDOW f AS (PARTITION BY symbol ORDER BY p ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
la AS (SELECT * FROM pf WHERE p <= e - 2 AND e >= 3), sc AS (SELECT symbol, stddev_pop(m1) AS s1, stddev_pop(m3) AS s3 FROM la GROUP BY 1), nw AS (SELECT * FROM pf JOIN sc USING (symbol) WHERE p = e),
nn AS (SELECT la.*, row_number() OVER (PARTITION BY la.symbol ORDER BY ((la.m1 - nw.m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END) ** 2 + ((la.m3 - nw.m3) / CASE WHEN s3 > 0 THEN s3 ELSE 1 END) ** 2, la.p) AS k FROM la JOIN nw ON la.symbol = nw.symbol),
vo AS (SELECT symbol, avg((ret > 0)::INT) AS p_up, count(*) AS n_analogs, list_sort(list(lo)) AS x, list_sort(list(hi)) AS y, avg(ret) AS pred_ret FROM nn WHERE k <= 7 GROUP BY 1),
fo AS (SELECT symbol, ts, close, p_up, n_analogs, x[(floor(0.1::DOUBLE * (n_analogs - 1) + 0.5) + 1)::INT] AS pred_lo, y[(floor(0.9::DOUBLE * (n_analogs - 1) + 0.5) + 1)::INT] AS pred_hi, pred_ret, lo AS act_lo, hi AS act_hi, ret AS act_ret, CASE WHEN nf = 2 THEN (ret > 0)::INT ELSE -1 END AS up, nf AS n_future FROM nw JOIN vo USING (symbol))"""


QUERIES: dict[str, Query] = {
    "FC01_cross_sectional_signal": (
        lambda spark, d: FC.cross_sectional_signal(_bars(spark, d), 5, 0.8, -0.8).select("symbol", "ts", r("momentum").alias("momentum"), r("z").alias("z"), "signal", r("next_ret").alias("next_ret")),
        DAY_BARS + f", zz AS (SELECT *, CASE WHEN stddev_pop(m) OVER (PARTITION BY ts) <> 0 THEN (m - avg(m) OVER (PARTITION BY ts)) / stddev_pop(m) OVER (PARTITION BY ts) ELSE 0 END AS z FROM mo) SELECT symbol, ts, {rs('m')} AS momentum, {rs('z')} AS z, CASE WHEN z >= 0.8 THEN 'buy' WHEN z <= -0.8 THEN 'sell' ELSE 'hold' END AS signal, {rs('nx')} AS next_ret FROM zz",
    ),
    "FC02_relative_strength": (
        _relative,
        DAY_BARS + f""", tg AS (SELECT ts, m FROM mo WHERE symbol = 'click'), ix AS (SELECT ts, avg(m) AS a FROM mo WHERE symbol = 'view' GROUP BY ts),
pe AS (SELECT ts, avg(m) AS a, sum(m) AS s, sum(m * m) AS q, count(*) AS n FROM mo WHERE symbol IN ('error', 'signup', 'purchase') GROUP BY ts),
jj AS (SELECT tg.ts, tg.m, ix.a AS ia, pe.a AS pa, (coalesce(pe.s, 0) + tg.m) / (coalesce(pe.n, 0) + 1) AS mean, (coalesce(pe.q, 0) + tg.m * tg.m) / (coalesce(pe.n, 0) + 1) AS sq FROM tg ASOF LEFT JOIN ix ON tg.ts >= ix.ts ASOF LEFT JOIN pe ON tg.ts >= pe.ts)
SELECT ts, {rs('m')} AS momentum, {rs('m - ia')} AS vs_index, {rs('m - pa')} AS vs_peers, {rs('CASE WHEN greatest(sq - mean * mean, 0) > 0 THEN (m - mean) / sqrt(greatest(sq - mean * mean, 0)) ELSE 0 END')} AS z FROM jj""",
    ),
    "FC03_forward_probability": (_proba, None),
    "FC04_walk_forward": (
        lambda spark, d: FC.walk_forward(_features(spark, d), 2, 7, ["m1", "m3"]).select("symbol", "idx", "ts", "up", "n_analogs", *(r(c).alias(c) for c in WALK_COLUMNS)),
        WALK + " SELECT symbol, idx, ts, up, n_analogs, " + ", ".join(f"{rs(c)} AS {c}" for c in WALK_COLUMNS) + " FROM wk",
    ),
    "FC04_calibrated": (lambda spark, d: FC.walk_forward(_features(spark, d), 2, 7, ["m1", "m3"], calibrate=0.3).select("symbol", "idx", "cal_p_up_iso", "cal_p_up_platt"), None),
    "FC05_forecast_as_of": (
        lambda spark, d: FC.forecast_as_of(_features(spark, d), AS_OF, 2, 7, ["m1", "m3"]).select("symbol", "ts", "n_analogs", "up", "n_future", *(r(c).alias(c) for c in AS_OF_COLUMNS)),
        ASOF + " SELECT symbol, ts, n_analogs, up, n_future, " + ", ".join(f"{rs(c)} AS {c}" for c in AS_OF_COLUMNS) + " FROM fo",
    ),
}
