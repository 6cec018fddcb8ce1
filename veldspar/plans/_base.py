"""What the registered queries share: tables, the bars that stand in for market data, rounding, registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions.series import Series

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(ts: str) -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") * 1000


def r(x: Column | str, digits: int = 6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    y = x.cast("double") * float(10**digits) + 0.5
    # floor() gives a long, which has no infinity or NaN; from 2^52 on doubles are whole numbers
    return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y) / float(10**digits)


def rs(x: str, digits: int = 6) -> str:
    """r() in SQL."""
    return f"floor(({x}) * {float(10**digits)!r} + 0.5) / {float(10**digits)!r}"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bars: a symbol for each event type."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("sym"), nanos("ts").alias("t"), F.col("value").alias("c"), (F.col("user_id") + 1).cast("double").alias("v"))
    return e.select("*", (F.col("c") * 0.98 + 0.3).alias("o"), (F.col("c") * 1.02 + 0.5).alias("h"), (F.col("c") * 0.95).alias("l"), (F.col("c") * 0.5 + F.col("v")).alias("x"))


#: The same in SQL, as the beginning of a WITH.
BARS = """WITH b0 AS (SELECT event_id, event_type AS sym, epoch_us(ts) * 1000 AS t, value AS c, (user_id + 1)::DOUBLE AS v FROM events),
bars AS (SELECT *, c * 0.98::DOUBLE + 0.3::DOUBLE AS o, c * 1.02::DOUBLE + 0.5::DOUBLE AS h, c * 0.95::DOUBLE AS l, c * 0.5::DOUBLE + v AS x,
         row_number() OVER (PARTITION BY sym ORDER BY t, event_id) AS p FROM b0)"""


def series(spark: SparkSession, sf_dir: str) -> Series:
    return Series(bars(spark, sf_dir), ("sym",), ("t", "event_id"))


W = "(PARTITION BY sym ORDER BY t, event_id)"


def last(n: int) -> str:
    return f"(PARTITION BY sym ORDER BY t, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
