"""Signals and analog forecasts over bars (symbol, ts, close, features)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.functions.scalars import signal
from veldspar.functions.series import Series, momentum, safe, zscore

from .temporal import asof_join

MODELS = ("analog",)


def cross_sectional_signal(bars: DataFrame, n: int, buy: float, sell: float, symbol: str = "symbol", ts: str = "ts", close: str = "close") -> DataFrame:
    """(symbol, ts, momentum, z, signal, next_ret): momentum a symbol, its z-score among the symbols of a time, and the
    return to the symbol's next bar (null at the last)."""
    s = momentum(Series(bars, (symbol,), (ts,)), close, n, "momentum")
    s = s.put("next_ret", safe(F.lead(close).over(s.window()), F.col(close)) - 1)
    z = zscore(Series(s.df, (ts,), (symbol,)), "momentum", "z").df
    return z.select(F.col(symbol).alias("symbol"), F.col(ts).alias("ts"), "momentum", "z", signal("z", buy, sell).alias("signal"), "next_ret")


def relative_strength(target: DataFrame, indices: DataFrame, peers: DataFrame, n: int) -> DataFrame:
    """(ts, momentum, vs_index, vs_peers, z) of the target's days: its momentum less the mean momentum of the indices and
    of the peers as last known by then, and its z-score within target and peers. All: (symbol, ts, close)."""
    moved = lambda df: momentum(Series(df, ("symbol",), ("ts",)), "close", n, "momentum").df
    mine = moved(target).select("ts", "momentum")
    out = mine
    for name, df in (("index", indices), ("peers", peers)):
        by_day = moved(df).groupBy(F.col("ts").alias("rt")).agg(F.avg("momentum").alias(f"{name}_mean"), F.sum("momentum").alias(f"{name}_sum"), F.sum(F.col("momentum") ** 2).alias(f"{name}_sq"), F.count("*").cast("double").alias(f"{name}_n"))
        out = asof_join(out, by_day, "ts", "rt", [f"{name}_mean", f"{name}_sum", f"{name}_sq", f"{name}_n"]).drop("matched_time")
    n_all = F.coalesce("peers_n", F.lit(0.0)) + 1
    mean = (F.coalesce("peers_sum", F.lit(0.0)) + F.col("momentum")) / n_all
    var = (F.coalesce("peers_sq", F.lit(0.0)) + F.col("momentum") ** 2) / n_all - mean * mean
    z = safe(F.col("momentum") - mean, F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0))
    return out.select("ts", "momentum", (F.col("momentum") - F.col("index_mean")).alias("vs_index"), (F.col("momentum") - F.col("peers_mean")).alias("vs_peers"), z.alias("z"))


def forward_probability(bars: DataFrame, horizon: int, k: int, features: Sequence[str], symbol: str = "symbol", ts: str = "ts", close: str = "close", model: str = "analog") -> DataFrame:
    """(symbol, n, p_up, p_down, hit_rate): of the k rows most like a symbol's last one (features scaled by mean and
    population deviation, ties to the earlier row), the share that rose within horizon bars, flat not counting as a rise;
    and how often the same vote, leaving a row itself out, was right. A symbol is one unit of work."""
    if model not in MODELS:
        raise NotImplementedError(f"the model {model} is reserved")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts).dropna(subset=list(features)).reset_index(drop=True)
        c, x = pdf[close].to_numpy(float), pdf[list(features)].to_numpy(float)
        n = len(c) - horizon
        if n < max(2, k):
            return pd.DataFrame([(key[0], max(n, 0), None, None, None)], columns=["symbol", "n", "p_up", "p_down", "hit_rate"])
        spread = x.std(0)
        z = (x - x.mean(0)) / np.where(spread > 0, spread, 1)
        up, past = c[horizon:] > c[:n], z[:n]

        def vote(of: np.ndarray, without: int | None = None) -> float:
            d = ((past - of) ** 2).sum(1)
            if without is not None:
                d[without] = np.inf
            return float(up[np.argsort(d, kind="stable")[:k]].mean())

        p = vote(z[-1])
        hits = np.mean([(vote(past[i], i) > 0.5) == up[i] for i in range(n)])
        return pd.DataFrame([(key[0], n, p, 1 - p, float(hits))], columns=["symbol", "n", "p_up", "p_down", "hit_rate"])

    kind = dict(bars.dtypes)[symbol]
    return bars.select(symbol, ts, close, *features).groupBy(symbol).applyInPandas(one, f"symbol {kind}, n long, p_up double, p_down double, hit_rate double")


#: Shares of the forecast quantiles.
QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
DAY = 86400 * 10**9


def nearest_rank(values: np.ndarray, share: float) -> float:
    """The value at the rank nearest to share of the way, halves up; none of no values."""
    return float(np.sort(values)[int(np.floor(share * (len(values) - 1) + 0.5))]) if len(values) else np.nan


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squares under a rising order of scores (ties in the order given): (last score, mean) of each block.

    Blocks lie between the corners of the lower hull of the running sums of labels."""
    order = np.argsort(scores, kind="stable")
    x, total = scores[order], np.concatenate([[0.0], np.cumsum(labels[order])])
    corners = [0]
    while corners[-1] < len(x):
        at = corners[-1]
        slopes = (total[at + 1 :] - total[at]) / np.arange(1, len(x) - at + 1)
        corners.append(at + 1 + int(np.flatnonzero(slopes <= slopes.min() + 1e-12)[0]))
    c = np.array(corners)
    return x[c[1:] - 1], np.diff(total[c]) / np.diff(c)


def isotonic_at(scores: np.ndarray, ends: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The mean of the first block that ends at or after a score; the last block's from its end on."""
    found = np.searchsorted(ends, scores, side="left").clip(0, len(ends) - 1)
    return np.where(scores >= ends[-1], np.where(scores <= ends[0], means[0], means[-1]), means[found])


def platt(scores: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of sigmoid(a * score + b) by Newton's method, from (1, 0), on labels drawn in by one count a class."""
    pos = labels > 0
    target = np.where(pos, (pos.sum() + 1) / (pos.sum() + 2), 1 / ((~pos).sum() + 2))
    x, theta = np.column_stack([scores, np.ones(len(scores))]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ theta))
        hessian = x.T @ (x * (p * (1 - p))[:, None])
        if abs(np.linalg.det(hessian)) < 1e-12:
            break
        step = np.linalg.solve(hessian, x.T @ (p - target))
        theta = theta - step
        if step @ step < 1e-10:
            break
    return float(theta[0]), float(theta[1])


def _calibrated(pdf: pd.DataFrame, horizon: int, share: float) -> pd.DataFrame:
    """The earliest share of decisions (at least 20, leaving 30) fits both calibrations; they apply from the horizon on."""
    pdf = pdf.sort_values("idx").reset_index(drop=True)
    n = len(pdf)
    iso, sig = np.full(n, np.nan), np.full(n, np.nan)
    fit = min(max(int(n * min(max(share, 0.1), 0.5)), 20), n - 30)
    if share > 0 and n >= 60 and fit >= 20:
        p, y, idx = (pdf[c].to_numpy(float) for c in ("p_up", "up", "idx"))
        a, b = platt(p[:fit], y[:fit])
        use = (np.arange(n) >= fit) & (idx >= idx[fit - 1] + horizon)
        iso[use], sig[use] = isotonic_at(p[use], *isotonic(p[:fit], y[:fit])), 1 / (1 + np.exp(-(a * p[use] + b)))
    return pdf.assign(cal_p_up_iso=iso, cal_p_up_platt=sig)


def walk_forward(bars: DataFrame, horizon: int, k: int, features: Sequence[str], warmup: int = 60, calibrate: float = 0.0, symbol: str = "symbol", ts: str = "ts", close: str = "close", model: str = "analog", block: int = 4096) -> DataFrame:
    """One row for each decision bar: (symbol, idx, ts, close, p_up, p_down, up, n_analogs, actual_ret, q05 to q95, bar_ret,
    vol20, cal_p_up_iso, cal_p_up_platt). A bar is forecast from the k rows most like it whose outcome was known by then,
    scaled by the mean and population deviation of just those.

    Rows with a null feature are left out. A symbol with too short a history has no rows. Each block of decisions of a
    symbol is a task of its own, which reads the rows before it: work is quadratic in a symbol's bars, memory linear."""
    if model not in MODELS:
        raise NotImplementedError(f"the model {model} is reserved")
    from pyspark.sql import Window

    k, names, own = max(1, k), list(features), Window.partitionBy(symbol)
    rows = bars.select(symbol, ts, close, *names).dropna(subset=names).withColumns({"__p": F.row_number().over(own.orderBy(ts)) - 1, "__n": F.count("*").over(own)})
    first, last = F.greatest(F.floor((F.col("__p") - horizon) / block), F.lit(0)), F.greatest(F.floor((F.col("__n") - horizon - 1) / block), F.lit(0))
    dealt = rows.where(first <= last).withColumn("__block", F.explode(F.sequence(first, last)))
    kind, columns = dict(bars.dtypes), ["idx", "ts", "close", "p_up", "p_down", "up", "n_analogs", "actual_ret", *(f"q{round(q * 100):02d}" for q in QUANTILES), "bar_ret", "vol20"]
    schema = f"symbol {kind[symbol]}, idx long, ts {kind[ts]}, " + ", ".join(f"{c} {'long' if c in ('up', 'n_analogs') else 'double'}" for c in columns[2:])

    def decide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__p")
        c, x, when = pdf[close].to_numpy(float), pdf[names].to_numpy(float), pdf[ts].to_numpy()
        ends = int(pdf["__n"].iloc[0]) - horizon
        start = max(horizon + max(1, min(warmup, max(ends - horizon - 19, 1))) - 1, horizon + 1)
        ret, out = np.concatenate([[0.0], c[1:] / c[:-1] - 1]), []
        ahead = c[horizon:] / c[: len(c) - horizon] - 1
        rose = c[horizon:] > c[: len(c) - horizon]
        for i in range(max(start, key[1] * block), min(ends, (key[1] + 1) * block)):
            past = x[: i - horizon + 1]
            spread = past.std(0)
            d = (((past - x[i]) / np.where(spread > 0, spread, 1)) ** 2).sum(1)
            near = np.argsort(d, kind="stable")[:k]
            got, up = ahead[near][np.isfinite(ahead[near]) & (c[near] > 0)], float(rose[near].mean())
            low = max(i - 20, 1)
            vol = float(ret[low : i + 1].std()) if i - low + 1 >= 3 else 0.0
            out.append((key[0], i, when[i], c[i], up, 1 - up, int(rose[i]), len(near), ahead[i], *(nearest_rank(got, q) for q in QUANTILES), ret[i], vol))
        return pd.DataFrame(out, columns=["symbol", *columns])

    decided = dealt.groupBy(symbol, "__block").applyInPandas(decide, schema)
    return decided.groupBy("symbol").applyInPandas(lambda pdf: _calibrated(pdf, horizon, calibrate), schema + ", cal_p_up_iso double, cal_p_up_platt double")


def forecast_as_of(bars: DataFrame, as_of: int, horizon: int, k: int, features: Sequence[str], symbol: str = "symbol", ts: str = "ts", close: str = "close") -> DataFrame:
    """One row a symbol: its last bar of the day as_of (nanoseconds) or before, forecast from the bars until then and held
    against what came after: (symbol, ts, close, p_up, p_down, n_analogs, pred_lo, pred_hi, pred_ret, act_lo, act_hi,
    act_ret, up, n_future). up is -1 and the rest null where the horizon isn't (or not at all) there yet; a symbol with
    less than horizon + 2 bars until then has no row. Native; the k nearest are ranked with a limit before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts")
    path, known = w.rowsBetween(1, horizon), F.col("ts") < as_of + DAY
    rows = bars.dropna(subset=list(features)).select(F.col(symbol).alias("symbol"), F.col(ts).alias("ts"), F.col(close).alias("close"), *features)
    rows = rows.withColumns({
        "__p": F.row_number().over(w), "__e": F.count(F.when(known, 1)).over(Window.partitionBy("symbol")), "__lo": F.min("close").over(path) / F.col("close") - 1, "__hi": F.max("close").over(path) / F.col("close") - 1,
        "__end": F.last("close").over(path), "n_future": F.count("close").over(path),
    }).where(F.col("__e") >= horizon + 2)
    rows = rows.withColumn("__ret", F.col("__end") / F.col("close") - 1)
    labelled, now = rows.where(F.col("__p") <= F.col("__e") - horizon), rows.where(F.col("__p") == F.col("__e"))
    scale = labelled.groupBy("symbol").agg(*(F.stddev_pop(f).alias(f"__s{i}") for i, f in enumerate(features)))
    asked = now.join(scale, "symbol").select("symbol", *(F.col(f).alias(f"__f{i}") for i, f in enumerate(features)), *(f"__s{i}" for i in range(len(features))))
    gap = sum(((F.col(f) - F.col(f"__f{i}")) / F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}")).otherwise(1.0)) ** 2 for i, f in enumerate(features))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("__d", "__p"))
    near = labelled.join(asked, "symbol").withColumn("__d", gap).withColumn("__k", place).where(F.col("__k") <= max(1, k))
    at = lambda c, q: F.element_at(F.array_sort(F.collect_list(F.when(F.col("close") > 0, F.col(c)))), (F.floor(q * (F.count(F.when(F.col("close") > 0, 1)) - 1) + 0.5) + 1).cast("int"))
    voted = near.groupBy("symbol").agg(F.avg((F.col("__end") > F.col("close")).cast("double")).alias("p_up"), F.count("*").alias("n_analogs"), at("__lo", 0.10).alias("pred_lo"), at("__hi", 0.90).alias("pred_hi"), F.avg(F.when(F.col("close") > 0, F.col("__ret"))).alias("pred_ret"))
    up = F.when(F.col("n_future") == horizon, (F.col("__end") > F.col("close")).cast("int")).otherwise(-1)
    return now.join(voted, "symbol").select("symbol", "ts", "close", "p_up", (1 - F.col("p_up")).alias("p_down"), "n_analogs", "pred_lo", "pred_hi", "pred_ret", F.col("__lo").alias("act_lo"), F.col("__hi").alias("act_hi"), F.col("__ret").alias("act_ret"), up.alias("up"), "n_future")
