"""Rolling and recursive series functions.

Each takes a Series (a DataFrame with the columns that split it and that order it) and returns one with a new column.
Bounded frames are native windows, so a partition is streamed with O(n) state; steps over the same split and order
share one sort. Recursive averages (ema, Wilder) are linear recurrences: they go through linear_scan().

Warm-up rows and undefined values are null. A null input gives null where the row takes part. Row order is always
explicit: order must be unique within a split, or the results of tied rows are not defined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    df: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*(F.col(c).asc_nulls_last() for c in self.order))

    def rows(self, a: int, b: int) -> WindowSpec:
        return self.window().rowsBetween(a, b)

    def last(self, n: int) -> WindowSpec:
        return self.rows(-(n - 1), 0)

    def lag(self, x: str, k: int = 1) -> Column:
        return F.lag(x, k).over(self.window())

    def place(self) -> Column:
        return F.row_number().over(self.window())

    def put(self, name: str, value: Column) -> Series:
        return replace(self, df=self.df.withColumn(name, value))

    def drop(self, *names: str) -> Series:
        return replace(self, df=self.df.drop(*names))


def safe(num: Column, den: Column, otherwise: Column | None = None) -> Column:
    """num / den, and otherwise (null) where den is 0."""
    return F.when(den != 0, num / F.when(den != 0, den)).otherwise(F.lit(None) if otherwise is None else otherwise)


def ieee(num: Column, den: Column) -> Column:
    """num / den by IEEE 754, as SQL over doubles has it: by 0 infinite, or NaN for 0 / 0."""
    num, den = num.cast("double"), den.cast("double")
    sign = F.signum(num) * F.when(den.cast("string") == "-0.0", -1.0).otherwise(1.0)
    limit = F.when((num == 0) | F.isnan(num), float("nan")).when(sign > 0, float("inf")).otherwise(float("-inf"))
    return F.when(den != 0, num / F.when(den != 0, den)).when(num.isNotNull() & (den == 0), limit)


#: How a function divides: safe (by 0: undefined, as the functions' rules have it) or ieee.
Divide = Callable[[Column, Column], Column]


# --- bounded windows


def mavg(s: Series, x: str, n: int, out: str = "mavg") -> Series:
    """Mean of the last n rows, or of those there are."""
    return s.put(out, F.avg(x).over(s.last(n)))


BLOCK = 16


def block_mavg(s: Series, x: str, n: int, out: str = "mavg") -> Series:
    """mavg() of n < 32 rows in another order of summing: the rows of a whole block (BLOCK rows by place in the split)
    are summed by themselves. DuckDB's windows sum in this order, so rounding is the same as in SQL there."""
    if n >= 2 * BLOCK:
        raise ValueError(f"{n} rows: {2 * BLOCK - 1} at most")
    zero = F.lit(0.0)
    total = lambda w: F.coalesce(F.sum(F.col(x).cast("double")).over(w), zero)
    t = s.put("__p", s.place()).put("__block", total(s.last(BLOCK)))
    value = total(t.last(n))  # without a whole block, or beginning with one, one row after another
    for after in range(n - BLOCK):  # rows after the block; before it are n - BLOCK - after
        whole = total(t.rows(1 - n, -BLOCK - after)) + t.lag("__block", after)
        for k in reversed(range(after)):
            whole += F.coalesce(t.lag(x, k).cast("double"), zero)
        value = F.when((F.col("__p") >= n) & (F.col("__p") % BLOCK == after), whole).otherwise(value)
    return t.put(out, safe(value, F.count(x).over(t.last(n)))).drop("__p", "__block")


def msum(s: Series, x: str, n: int, out: str = "msum") -> Series:
    return s.put(out, F.sum(x).over(s.last(n)))


def deltas(s: Series, x: str, out: str = "deltas") -> Series:
    """Differences; the first row keeps its value."""
    return s.put(out, F.col(x) - F.coalesce(s.lag(x), F.lit(0).cast("long") if dict(s.df.dtypes)[x] in ("bigint", "int") else F.lit(0.0)))


def fused(s: Series, x: str, n: int) -> Series:
    return deltas(msum(mavg(s, x, n), x, n), x)


def order_flow_imbalance(s: Series, bid: str, ask: str, bid_size: str, ask_size: str, n: int, out: str = "ofi") -> Series:
    """Sum over n rows of bid_size * change of bid - ask_size * change of ask; no change at the first row."""
    step = F.col(bid_size) * F.coalesce(F.col(bid) - s.lag(bid), F.lit(0.0)) - F.col(ask_size) * F.coalesce(F.col(ask) - s.lag(ask), F.lit(0.0))
    return msum(s.put("__flow", step), "__flow", n, out).drop("__flow")


def tick_rule(s: Series, x: str, out: str = "tick") -> Series:
    """Sign of the change; of an unchanged row, that of the last change; 0 before any."""
    t = s.put("__sign", F.signum(F.col(x) - s.lag(x)).cast("int"))
    carried = F.last(F.when(F.col("__sign") != 0, F.col("__sign")), True).over(t.rows(Window.unboundedPreceding, 0))
    return t.put(out, F.coalesce(carried, F.lit(0))).drop("__sign")


def lee_ready(s: Series, x: str, bid: str, ask: str, out: str = "lee_ready") -> Series:
    """Side of the mid price, or the tick rule at the mid."""
    side = F.signum(F.col(x) - 0.5 * (F.col(bid) + F.col(ask))).cast("int")
    t = tick_rule(s, x, "__tick")
    return t.put(out, F.when(side != 0, side).otherwise(F.col("__tick"))).drop("__tick")


def emo(s: Series, x: str, bid: str, ask: str, out: str = "emo") -> Series:
    """1 at the ask, -1 at the bid, else the tick rule."""
    t = tick_rule(s, x, "__tick")
    return t.put(out, F.when(F.col(x) == F.col(ask), 1).when(F.col(x) == F.col(bid), -1).otherwise(F.col("__tick"))).drop("__tick")


def ofi_l1(s: Series, bid: str, bid_size: str, ask: str, ask_size: str, out: str = "ofi_l1") -> Series:
    """First-level order flow: what the bid gained less what the ask gained; 0 at the first row."""
    up = F.col(bid) - s.lag(bid)
    down = F.col(ask) - s.lag(ask)
    gained = F.when(up > 0, F.col(bid_size)).when(up < 0, 0.0).otherwise(F.col(bid_size) - s.lag(bid_size))
    offered = F.when(down > 0, 0.0).when(down < 0, F.col(ask_size)).otherwise(F.col(ask_size) - s.lag(ask_size))
    return s.put(out, F.coalesce(gained - offered, F.lit(0.0)))


def zscore(s: Series, x: str, out: str = "zscore") -> Series:
    """Over the whole split, with the population deviation; 0 where that is 0."""
    w = Window.partitionBy(*s.by)
    return s.put(out, safe(F.col(x) - F.avg(x).over(w), F.stddev_pop(x).over(w), F.lit(0.0)))


def momentum(s: Series, x: str, n: int, out: str = "momentum", divide: Divide = safe) -> Series:
    """x over x of n rows ago, less 1; 0 for the first n rows or a zero base (unless divide says otherwise)."""
    return s.put(out, F.coalesce(divide(F.col(x), s.lag(x, n)) - 1, F.lit(0.0)))


def xrank(s: Series, x: str, out: str = "xrank") -> Series:
    """Percentile rank from 0 to 1 within the split, ties averaged; 0.5 for a row alone."""
    whole = Window.partitionBy(*s.by)
    same = Window.partitionBy(*s.by, x)
    n, place = F.count("*").over(whole), F.rank().over(whole.orderBy(F.col(x).asc_nulls_last()))
    return s.put(out, F.when(n > 1, (place - 1 + (F.count("*").over(same) - 1) / 2) / F.greatest(n - 1, F.lit(1))).otherwise(0.5))


def bollinger(s: Series, x: str, n: int, k: float = 2) -> Series:
    """boll_mid, boll_up, boll_lo: mean and k population deviations on each side, from row n."""
    full = s.place() >= n
    mean, spread = F.avg(x).over(s.last(n)), F.stddev_pop(x).over(s.last(n))
    return s.put("boll_mid", F.when(full, mean)).put("boll_up", F.when(full, mean + k * spread)).put("boll_lo", F.when(full, mean - k * spread))


def bb_width(s: Series, x: str, n: int, out: str = "bb_width") -> Series:
    t = bollinger(s, x, n, 2)
    return t.put(out, safe(F.col("boll_up") - F.col("boll_lo"), F.col("boll_mid"))).drop("boll_mid", "boll_up", "boll_lo")


def bb_mid_slope(s: Series, x: str, n: int, out: str = "bb_mid_slope") -> Series:
    t = bollinger(s, x, n, 2)
    return t.put(out, F.col("boll_mid") - t.lag("boll_mid")).drop("boll_mid", "boll_up", "boll_lo")


def vwap(s: Series, h: str, low: str, c: str, v: str, n: int, out: str = "vwap") -> Series:
    """Volume-weighted mean of (h + l + c) / 3 over n rows; null without volume. Short beginnings use what there is."""
    t = s.put("__tpv", (F.col(h) + F.col(low) + F.col(c)) / 3 * F.col(v))
    volume = F.sum(v).over(t.last(n))
    return t.put(out, F.when(volume > 0, safe(F.sum("__tpv").over(t.last(n)), volume))).drop("__tpv")


def vwap_dev(s: Series, h: str, low: str, c: str, v: str, n: int, out: str = "vwap_dev") -> Series:
    t = vwap(s, h, low, c, v, n, "__vwap")
    return t.put(out, safe(F.col(c), F.col("__vwap")) - 1).drop("__vwap")


def returns(s: Series, x: str, out: str, divide: Divide = safe) -> Series:
    change = divide(F.col(x), s.lag(x)) - 1
    return s.put(out, F.when(F.abs(s.lag(x)) > 1e-12, change) if divide is safe else change)


def hv(s: Series, x: str, n: int, periods: int, out: str = "hv", divide: Divide = safe) -> Series:
    """Population deviation of the last n returns, by the root of periods; from row n + 1."""
    t = returns(s, x, "__ret", divide)
    mean, square = F.avg("__ret").over(t.last(n)), F.avg(F.col("__ret") * F.col("__ret")).over(t.last(n))
    return t.put(out, F.when(t.place() > n, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) * float(np.sqrt(periods)))).drop("__ret")


def hv_ratio(s: Series, x: str, short: int, long: int, periods: int, out: str = "hv_ratio", divide: Divide = safe) -> Series:
    t = hv(hv(s, x, short, periods, "__s", divide), x, long, periods, "__l", divide)
    return t.put(out, divide(F.col("__s"), F.col("__l")) - 1).drop("__s", "__l")


regime_vol = hv_ratio


def vol_spike(s: Series, v: str, n: int, out: str = "vol_spike") -> Series:
    return s.put(out, F.when(s.place() >= n, safe(F.col(v), F.avg(v).over(s.last(n))) - 1))


def obv(s: Series, c: str, v: str, out: str = "obv") -> Series:
    """Running sum of volume signed by the change of price, from 0."""
    t = s.put("__signed", F.coalesce(F.signum(F.col(c) - s.lag(c)), F.lit(0.0)) * F.col(v))
    return t.put(out, F.sum("__signed").over(t.rows(Window.unboundedPreceding, 0))).drop("__signed")


def obv_slope(s: Series, c: str, v: str, n: int, out: str = "obv_slope") -> Series:
    t = obv(s, c, v, "__obv")
    return t.put(out, F.col("__obv") - t.lag("__obv", n)).drop("__obv")


def new_high(s: Series, h: str, n: int, out: str = "hh") -> Series:
    """1 where h is above all of the n rows before, else 0; null for the first n rows."""
    return s.put(out, F.when(s.place() > n, (F.col(h) > F.max(h).over(s.rows(-n, -1))).cast("double")))


def new_low(s: Series, low: str, n: int, out: str = "ll") -> Series:
    return s.put(out, F.when(s.place() > n, (F.col(low) < F.min(low).over(s.rows(-n, -1))).cast("double")))


def gap(s: Series, o: str, c: str, out: str = "gap", divide: Divide = safe) -> Series:
    """Open over the close before, less 1. gap_up and gap_down are the same number."""
    return s.put(out, divide(F.col(o), s.lag(c)) - 1)


gap_up = gap_down = gap


def rs_index(s: Series, x: str, index: str, n: int, out: str = "rs_index", divide: Divide = safe) -> Series:
    t = momentum(momentum(s, x, n, "__x", divide), index, n, "__i", divide)
    return t.put(out, F.col("__x") - F.col("__i")).drop("__x", "__i")


def beta_index(s: Series, x: str, index: str, n: int, out: str = "beta_index", divide: Divide = safe) -> Series:
    """Covariance of the last n returns with the index's, over the index's variance; from row n + 1, with two at least.
    NaN where one of the returns is infinite or NaN."""
    t = returns(returns(s, x, "__a", divide), index, "__b", divide)
    t = t.put("__a", F.when(F.col("__b").isNotNull(), F.col("__a"))).put("__b", F.when(F.col("__a").isNotNull(), F.col("__b")))
    w = t.last(n)
    good = (t.place() > n) & (F.count("__a").over(w) >= 2) & (F.var_pop("__b").over(w) > 1e-14)
    beta = safe(F.covar_pop("__a", "__b").over(w), F.var_pop("__b").over(w))
    # 0 * a is NaN for what isn't finite
    return t.put(out, F.when(good, beta + F.sum(0.0 * F.col("__a") + 0.0 * F.col("__b")).over(w))).drop("__a", "__b")


# --- candle shapes: no window


def _share(part: Column, h: str, low: str) -> Column:
    span = F.col(h) - F.col(low)
    return F.when(span > 0, F.least(F.greatest(safe(part, span), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def big_green(o: str, h: str, low: str, c: str) -> Column:
    return _share(F.col(c) - F.col(o), h, low)


def big_red(o: str, h: str, low: str, c: str) -> Column:
    return _share(F.col(o) - F.col(c), h, low)


def long_lower_shadow(o: str, h: str, low: str, c: str) -> Column:
    return _share(F.least(o, c) - F.col(low), h, low)


def long_upper_shadow(o: str, h: str, low: str, c: str) -> Column:
    return _share(F.col(h) - F.greatest(o, c), h, low)


# --- linear recurrences


def linear_scan(s: Series, a: Column, b: Column, out: str, chunk: int = 4096) -> Series:
    """y of y[i] = a[i] * y[i-1] + b[i] in each split, y before the first row being 0.

    A split is cut into chunks of `chunk` rows. Within a chunk, y = (product of a) * y at the chunk's start + what the
    chunk adds by itself; the chunks' pairs (one row each) are joined in order, and each chunk is finished with the y
    it starts from. So a split with most of the rows is spread over many tasks, and no task holds more than a chunk."""
    keys = [F.col(c) for c in s.by]
    rows = s.put("__i", s.place() - 1).df.withColumns({"__chunk": F.floor(F.col("__i") / chunk), "__a": a, "__b": b})
    ends = rows.groupBy(*s.by, "__chunk").agg(F.sort_array(F.collect_list(F.struct("__i", "__a", "__b"))).alias("__r"))
    ends = ends.select(*keys, "__chunk", F.aggregate("__r", F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("y")), lambda st, x: F.struct((st["m"] * x["__a"]).alias("m"), (st["y"] * x["__a"] + x["__b"]).alias("y"))).alias("__e"))
    path = Window.partitionBy(*s.by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = F.aggregate(F.collect_list("__e").over(path), F.lit(0.0), lambda y, e: e["m"] * y + e["y"])
    starts = ends.select(*(F.col(c).alias(f"__k{j}") for j, c in enumerate(s.by)), F.col("__chunk").alias("__kc"), start.alias("__y0"))
    on = F.col("__chunk") == F.col("__kc")
    for j, c in enumerate(s.by):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{j}"))
    joined = rows.join(starts, on).drop("__kc", *(f"__k{j}" for j in range(len(s.by))))

    schema = joined.drop("__a", "__b", "__y0", "__chunk", "__i").schema.add(out, "double")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        y, kept = float(pdf["__y0"].iloc[0]), np.empty(len(pdf))
        for i, (p, q) in enumerate(zip(pdf["__a"].to_numpy(), pdf["__b"].to_numpy(), strict=True)):
            kept[i] = y = p * y + q
        return pdf.drop(columns=["__a", "__b", "__y0", "__chunk", "__i"]).assign(**{out: kept})

    return replace(s, df=joined.groupBy(*s.by, "__chunk").applyInPandas(finish, schema))


def _smoothed(s: Series, x: str, n: int, alpha: float, seed: Column, first: int, out: str) -> Series:
    """Null up to row `first`, the seed there, then (1 - alpha) * y + alpha * x."""
    t = s.put("__p", s.place())
    t = t.put("__seed", seed)
    a = F.when(F.col("__p") <= first, 0.0).otherwise(1 - alpha)
    b = F.when(F.col("__p") < first, 0.0).when(F.col("__p") == first, F.col("__seed")).otherwise(alpha * F.coalesce(F.col(x), F.lit(0.0)))
    t = linear_scan(t, a, b.cast("double"), out)
    return t.put(out, F.when(F.col("__p") >= first, F.col(out))).drop("__p", "__seed")


def ema(s: Series, x: str, n: int, out: str = "ema") -> Series:
    """Exponential mean, 2 / (n + 1), seeded at row n with the mean of the first n."""
    return _smoothed(s, x, n, 2 / (n + 1), F.avg(x).over(s.last(n)), n, out)


def ema_slope(s: Series, x: str, n: int, out: str = "ema_slope") -> Series:
    t = ema(s, x, n, "__ema")
    return t.put(out, F.col("__ema") - t.lag("__ema")).drop("__ema")


def ema_accel(s: Series, x: str, n: int, out: str = "ema_accel") -> Series:
    t = ema_slope(s, x, n, "__slope")
    return t.put(out, F.col("__slope") - t.lag("__slope")).drop("__slope")


def rsi(s: Series, x: str, n: int, out: str = "rsi") -> Series:
    """Wilder's index, from row n + 1; without losses 100, or 50 without gains too."""
    t = s.put("__d", F.col(x) - s.lag(x))
    t = t.put("__g", F.greatest(F.col("__d"), F.lit(0.0))).put("__l", F.greatest(-F.col("__d"), F.lit(0.0)))
    for c in ("__g", "__l"):
        t = _smoothed(t, c, n, 1 / n, F.avg(c).over(t.last(n)), n + 1, f"{c}a")
    gain, loss = F.col("__ga"), F.col("__la")
    value = F.when(loss > 0, 100 - 100 / (1 + safe(gain, loss))).when(gain > 0, 100.0).otherwise(50.0)
    return t.put(out, F.when(gain.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)))).drop("__d", "__g", "__l", "__ga", "__la")


def macd(s: Series, x: str, fast: int = 12, slow: int = 26, signal: int = 9) -> Series:
    """macd_dif from row slow, macd_dea (its exponential mean, seeded with its first `signal` values) and macd_hist."""
    fast, slow = min(fast, slow), max(fast, slow)
    t = ema(ema(s, x, fast, "__f"), x, slow, "__s")
    t = t.put("macd_dif", F.col("__f") - F.col("__s")).drop("__f", "__s")
    t = _smoothed(t, "macd_dif", signal, 2 / (signal + 1), F.avg("macd_dif").over(t.last(signal)), slow + signal - 1, "macd_dea")
    return t.put("macd_hist", F.col("macd_dif") - F.col("macd_dea"))


def macd_distance(s: Series, x: str, fast: int, slow: int, out: str = "macd_distance") -> Series:
    t = macd(s, x, fast, slow, 9)
    return t.put(out, F.col("macd_hist")).drop("macd_dif", "macd_dea", "macd_hist")


def macd_slope(s: Series, x: str, fast: int, slow: int, out: str = "macd_slope") -> Series:
    fast, slow = min(fast, slow), max(fast, slow)
    t = ema(ema(s, x, fast, "__f"), x, slow, "__s")
    t = t.put("__dif", F.col("__f") - F.col("__s"))
    return t.put(out, F.col("__dif") - t.lag("__dif")).drop("__f", "__s", "__dif")


def true_range(s: Series, h: str, low: str, c: str) -> Column:
    before = s.lag(c)
    return F.greatest(F.col(h) - F.col(low), F.abs(F.col(h) - before), F.abs(F.col(low) - before))


def atr(s: Series, h: str, low: str, c: str, n: int, out: str = "atr") -> Series:
    """Wilder's mean of the true range, seeded at row n + 1 with the ranges of rows 2 to n + 1."""
    t = s.put("__tr", true_range(s, h, low, c))
    return _smoothed(t, "__tr", n, 1 / n, F.avg("__tr").over(t.last(n)), n + 1, out).drop("__tr")


def atr_ratio(s: Series, h: str, low: str, c: str, short: int, long: int, out: str = "atr_ratio") -> Series:
    t = atr(atr(s, h, low, c, short, "__s"), h, low, c, long, "__l")
    return t.put(out, safe(F.col("__s"), F.col("__l"))).drop("__s", "__l")


def regime_trend(s: Series, x: str, fast: int, slow: int, out: str = "regime_trend") -> Series:
    t = ema(ema(s, x, fast, "__f"), x, slow, "__s")
    return t.put(out, F.col("__f") - F.col("__s")).drop("__f", "__s")


def regime_event(s: Series, o: str, h: str, low: str, c: str, v: str, n: int, out: str = "regime_event", divide: Divide = safe) -> Series:
    """1 where volume is half above its mean, or the opening gap is 1.5 mean true ranges of the close before."""
    t = atr(vol_spike(s, v, n, "__spike"), h, low, c, n, "__atr")
    t = t.put("__gap", F.abs(divide(F.col(o), t.lag(c)) - 1)).put("__rel", 1.5 * divide(F.col("__atr"), t.lag(c)))
    event = (F.col("__spike") >= 0.5) | F.coalesce(F.col("__gap") >= F.col("__rel"), F.lit(False))
    return t.put(out, F.when(F.col("__spike").isNotNull(), event.cast("double"))).drop("__spike", "__atr", "__gap", "__rel")


ALIASES: dict[str, Callable] = {"ofi": order_flow_imbalance, "tick": tick_rule, "lr": lee_ready, "ofil": ofi_l1, "rank_cs": xrank, "rs": rs_index, "beta": beta_index, "hh": new_high, "ll": new_low}
