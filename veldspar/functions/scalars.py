"""Scalar functions as column expressions. Divisions are guarded, so ANSI mode raises nothing."""

from __future__ import annotations

import math

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import safe

BAND, MOST_QUANTITY, MOST_NOTIONAL = 0.05, 10_000, 10_000_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_ok(price, qty, mid, self_match) -> Column:
    """Within 5 % of the mid price, at most 10,000 pieces and 10 million of notional, and no self-match."""
    price, qty, mid, self_match = map(_c, (price, qty, mid, self_match))
    return (F.abs(price - mid) <= BAND * mid) & (qty <= MOST_QUANTITY) & (price * qty <= MOST_NOTIONAL) & (self_match == 0)


def micro_price(bid, ask, bid_size, ask_size) -> Column:
    bid, ask, bid_size, ask_size = map(_c, (bid, ask, bid_size, ask_size))
    return safe(bid * ask_size + ask * bid_size, bid_size + ask_size, F.lit(0.0))


def aggressor_flag(side) -> Column:
    """1 for B or BUY, -1 for S or SELL, else 0; the case matters."""
    side = _c(side)
    return F.when(side.isin("B", "BUY"), 1).when(side.isin("S", "SELL"), -1).otherwise(0)


def xbar(ts, bucket: int) -> Column:
    """ts down to a multiple of bucket, toward zero."""
    ts = _c(ts)
    return ts - ts % max(1, bucket)


NANOS = {"SS": 10**9, "MI": 60 * 10**9, "HH": 3600 * 10**9, "DD": 86400 * 10**9}


def trunc_time(ts, unit: str) -> Column:
    """Nanoseconds floored to a second, minute, hour, day, month or year (UTC). Another unit is an error."""
    ts, unit = _c(ts), unit.upper()
    if unit in NANOS:
        return ts - F.pmod(ts, F.lit(NANOS[unit]))
    if unit not in ("MM", "YYYY"):
        raise ValueError(f"no such unit: {unit}")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / F.lit(NANOS["DD"])).cast("int"))
    return F.datediff(F.trunc(day, "month" if unit == "MM" else "year"), F.lit("1970-01-01").cast("date")).cast("long") * NANOS["DD"]


def trunc_number(x, digits: int = 0) -> Column:
    """Toward zero, to so many decimals (negative: before the point)."""
    x, scale = _c(x), 10.0**abs(digits)
    scaled = F.abs(x) * scale if digits >= 0 else F.abs(x) / scale
    whole = F.floor(scaled).cast("double")
    return F.signum(x) * (whole / scale if digits >= 0 else whole * scale)


def signal(z, buy: float, sell: float) -> Column:
    z = _c(z)
    return F.when(z >= buy, "buy").when(z <= sell, "sell").otherwise("hold")


#: Abramowitz and Stegun 7.1.26.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    z = F.abs(x)
    t = 1 / (1 + ERF_P * z)
    total = F.lit(0.0)
    for a in reversed(ERF_A):
        total = (total + a) * t
    return F.signum(x) * (1 - total * F.exp(-z * z))


def norm_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def norm_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


class BlackScholes:
    """Price and sensitivities of a European option; a kind that doesn't begin with C (or is empty) is a put."""

    def __init__(self, kind, s, k, t, r, v):
        self.s, self.k, self.t, self.r, self.v = map(_c, (s, k, t, r, v))
        kind = _c(kind)
        self.call = (F.upper(F.substring(kind, 1, 1)) == "C") | (F.length(kind) == 0)
        self.live = (self.t > 0) & (self.v > 0)
        good = self.live & (self.s > 0) & (self.k > 0)
        self.root = F.when(good, self.v * F.sqrt(self.t))
        self.d1 = (F.ln(F.when(good, self.s / F.when(self.k != 0, self.k))) + (self.r + 0.5 * self.v * self.v) * self.t) / self.root
        self.d2 = self.d1 - self.root
        self.df = F.exp(-self.r * self.t)

    def price(self) -> Column:
        sign = F.when(self.call, 1.0).otherwise(-1.0)
        value = sign * (self.s * norm_cdf(sign * self.d1) - self.k * self.df * norm_cdf(sign * self.d2))
        return F.when(self.live, value).otherwise(F.greatest(sign * (self.s - self.k), F.lit(0.0)))

    def delta(self) -> Column:
        step = F.when(self.call, (self.s > self.k).cast("double")).otherwise(-(self.s < self.k).cast("double"))
        return F.when(self.live, norm_cdf(self.d1) - F.when(self.call, 0.0).otherwise(1.0)).otherwise(step)

    def gamma(self) -> Column:
        return F.when(self.live & (self.s > 0), safe(norm_pdf(self.d1), self.s * self.root)).otherwise(0.0)

    def vega(self) -> Column:
        return F.when(self.live, self.s * norm_pdf(self.d1) * F.sqrt(F.greatest(self.t, F.lit(0.0)))).otherwise(0.0)

    def theta(self) -> Column:
        """A year."""
        decay = -safe(self.s * norm_pdf(self.d1) * self.v, 2 * F.sqrt(F.greatest(self.t, F.lit(0.0))))
        carry = self.r * self.k * self.df
        return F.when(self.live, F.when(self.call, decay - carry * norm_cdf(self.d2)).otherwise(decay + carry * norm_cdf(-self.d2))).otherwise(0.0)

    def rho(self) -> Column:
        """For 1.0 of rate."""
        value = self.k * self.t * self.df
        return F.when(self.live, F.when(self.call, value * norm_cdf(self.d2)).otherwise(-value * norm_cdf(-self.d2))).otherwise(0.0)


def refdata_get(df: DataFrame, reference: DataFrame, domain: str, key: str, as_of: str, out: str = "value") -> DataFrame:
    """Adds the reference value (domain, key, valid_from, valid_to, value) in force at as_of, or null."""
    ref = reference.select(F.col("domain").alias("__d"), F.col("key").alias("__k"), F.col("valid_from").alias("__f"), F.col("valid_to").alias("__t"), F.col("value").alias(out))
    at = F.col(as_of)
    return df.join(ref, (F.col(key) == F.col("__k")) & (F.col("__d") == domain) & (F.col("__f") <= at) & (at < F.col("__t")), "left").drop("__d", "__k", "__f", "__t")


def vector_udf(fn, returns: str = "double"):
    """A user's function of a numpy array as an Arrow-batched scalar function."""
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(fn(x.to_numpy()))

    return F.pandas_udf(run, returns)
