"""Aggregates and matrix operators, bars and alignment. Sums are partial before they are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.scalars import xbar
from veldspar.functions.series import safe


def order_book_imbalance(bid_size: str, ask_size: str) -> Column:
    """Aggregate: (bids - asks) / (bids + asks), 0 without either."""
    b, a = F.sum(bid_size), F.sum(ask_size)
    return F.coalesce(safe(b - a, b + a, F.lit(0.0)), F.lit(0.0))


def covariance_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, cov): sample covariances, 0 with fewer than two rows. One pass: all pairs are aggregates of one group."""
    m = len(columns)
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.coalesce(F.covar_samp(columns[min(i, j)], columns[max(i, j)]), F.lit(0.0)).alias("cov")) for i in range(m) for j in range(m)]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def pca(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(component, eigenvalue, ratio) of that matrix, largest first, not below 0. Only the m x m matrix reaches the driver."""
    m = len(columns)
    matrix = np.zeros((m, m))
    for row in covariance_matrix(df, columns).collect():
        matrix[row["i"], row["j"]] = row["cov"]
    values = np.maximum(np.linalg.eigvalsh(matrix)[::-1], 0.0)
    total = values.sum()
    rows = [(k, float(v), float(v / total) if total > 0 else 0.0) for k, v in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, ratio double")


def var_historical(df: DataFrame, column: str, confidence: float) -> DataFrame:
    """(var): minus the return at the rounded index (n - 1) * (1 - confidence) of the sorted returns; 95 means 0.95.

    The index is found without sorting in one task: counts of distinct values give each value's range of ranks."""
    confidence = confidence / 100 if confidence > 1 else confidence
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    n = values.count()
    if not n:
        return df.sparkSession.createDataFrame([], "var double")
    index = int(np.floor((n - 1) * (1 - confidence) + 0.5))
    # the smallest index + 1 values: a bounded heap for each task when the tail is small, else from the other end
    if index + 1 <= n - index:
        return values.orderBy("x").limit(index + 1).agg((-F.max("x")).alias("var"))
    return values.orderBy(F.desc("x")).limit(n - index).agg((-F.min("x")).alias("var"))


def ohlc(df: DataFrame, ts: str, price: str, bucket: int, by: Sequence[str] = (), volume: str | None = None, seq: str | None = None) -> DataFrame:
    """Bars by bucket: open and close by (ts, seq), volume 1 a row unless a column is named."""
    at = F.struct(ts, *([seq] if seq else []))
    size = F.col(volume) if volume else F.lit(1.0)
    return (
        df.groupBy(*by, xbar(ts, bucket).alias("bar"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(size).alias("volume"))
    )


def align(df: DataFrame, ts: str, symbol: str, close: str, volume: str, freq: int, how: str = "ffill", seq: str | None = None) -> DataFrame:
    """(ts, symbol, close, volume, n_obs) on a grid from each symbol's first to its last bucket; the last row of a bucket
    counts. An empty bucket carries the close on with n_obs and volume 0, or is left out ('drop').

    The grid is made from gaps: each bucket is followed by the empty ones up to the next, so nothing is joined."""
    if how not in ("ffill", "drop"):
        raise ValueError(f"no such mode: {how}")
    at = F.struct(ts, *([seq] if seq else []))
    own = df.groupBy(F.col(symbol).alias("symbol"), xbar(ts, freq).alias("ts")).agg(F.max_by(close, at).alias("close"), F.sum(volume).alias("volume"), F.count("*").alias("n_obs"))
    if how == "drop":
        return own.select("ts", "symbol", "close", "volume", "n_obs")
    after = F.lead("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    spread = own.withColumn("__end", F.coalesce(after - freq, F.col("ts"))).withColumn("__at", F.explode(F.sequence("ts", "__end", F.lit(freq).cast("long"))))
    here = F.col("__at") == F.col("ts")
    return spread.select(F.col("__at").alias("ts"), "symbol", "close", F.when(here, F.col("volume")).otherwise(0.0).alias("volume"), F.when(here, F.col("n_obs")).otherwise(0).alias("n_obs"))


def strategy_stats(df: DataFrame, p: str, y: str, order: str, bins: int = 10, strong: float = 0.7) -> DataFrame:
    """One row: n, hit_rate, brier, ece, psi, strong_n, strong_hit of forecasts p of outcomes y (0 or 1).

    psi compares the bins of the first 80 % of rows by order with those of the last 20 %, each count smoothed by 0.5."""
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    cut = rows.agg(F.count("*").alias("__n"), F.percentile(order, 0.8).alias("__cut"))
    split = rows.crossJoin(F.broadcast(cut)).select(F.col(p).alias("p"), F.col(y).cast("double").alias("y"), bin_.alias("bin"), (F.col(order) <= F.col("__cut")).alias("early"))
    b = split.groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum("p").alias("sp"), F.count(F.when(F.col("early"), 1)).alias("a"), F.count(F.when(~F.col("early"), 1)).alias("e"), F.sum((F.col("p") - F.col("y")) ** 2).alias("sq"), F.count(F.when((F.col("p") >= 0.5) == (F.col("y") == 1), 1)).alias("hit"), F.count(F.when(F.greatest("p", 1 - F.col("p")) >= strong, 1)).alias("sn"), F.count(F.when((F.greatest("p", 1 - F.col("p")) >= strong) & ((F.col("p") >= 0.5) == (F.col("y") == 1)), 1)).alias("sh"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(b, "bin", "left").na.fill(0)
    total = every.agg(F.sum("a").alias("na"), F.sum("e").alias("ne"))
    pa_, pe = (F.col("a") + 0.5) / (F.col("na") + 0.5 * bins), (F.col("e") + 0.5) / (F.col("ne") + 0.5 * bins)
    n = F.sum("n")
    return every.crossJoin(F.broadcast(total)).agg(
        n.alias("n"), safe(F.sum("hit").cast("double"), n).alias("hit_rate"), safe(F.sum("sq"), n).alias("brier"), safe(F.sum(F.abs(F.col("sp") - F.col("sy"))), n).alias("ece"),
        F.sum((pe - pa_) * F.ln(pe / pa_)).alias("psi"), F.sum("sn").alias("strong_n"), safe(F.sum("sh").cast("double"), F.sum("sn")).alias("strong_hit"),
    )
