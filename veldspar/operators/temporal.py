"""As-of joins, point-in-time reads and bitemporal tables. Validity is half-open: valid_from <= t < valid_to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = 2**63 - 1


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: Sequence[str], by: Sequence[str] = (), tolerance: int | None = None, seq: str | None = None, chunk: int | None = None) -> DataFrame:
    """Each row of left with the values of the latest row of right at or before its time, null if there is none or
    if it is more than tolerance older. Of right rows at one time the last by seq counts.

    Both sides are put together and the last right row is carried along each key's time: one shuffle, no pairs. With
    chunk, a key's time is cut into ranges that long and each range is a unit of its own, which starts from the last
    right row before it: then no key, hot or none at all, has to pass through one task."""
    order = [F.col("__t").asc_nulls_first(), F.col("__left"), *([F.col("__seq")] if seq else [])]
    payload = F.struct(F.col(right_time).alias("__rt"), *values)
    lhs = left.select(F.struct("*").alias("__row"), *by, F.col(left_time).alias("__t"), F.lit(1).alias("__left"), F.lit(None).cast(right.schema[seq].dataType if seq else "long").alias("__seq"))
    rhs = right.where(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__left"), (F.col(seq) if seq else F.lit(None).cast("long")).alias("__seq"), payload.alias("__v"))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    keys: list[str | Column] = list(by)
    carried = F.last("__v", ignorenulls=True)
    if chunk:
        both = both.withColumn("__c", F.floor(F.col("__t") / chunk))
        tops = both.where("__left = 0").groupBy(*by, "__c").agg(F.max_by("__v", F.struct("__t", *(["__seq"] if seq else []))).alias("__top"))
        units = both.select(*by, "__c").distinct()
        known = units.join(tops, [*by, "__c"], "left") if by else units.join(tops, "__c", "left")
        start = known.withColumn("__start", F.last("__top", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))).drop("__top")
        both = both.join(start, [*by, "__c"], "left")
        keys.append("__c")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    value = F.coalesce(carried.over(w), F.col("__start")) if chunk else carried.over(w)
    out = both.withColumn("__m", value).where("__left = 1")
    match = F.col("__m") if tolerance is None else F.when(F.col("__t") - F.col("__m.__rt") <= tolerance, F.col("__m"))
    return out.withColumn("__m", match).select("__row.*", F.col("__m.__rt").alias("matched_time"), *(F.col(f"__m.{v}").alias(v) for v in values))


aj = asof_join


def active_at(df: DataFrame, t: int | Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Rows in force at t; both bounds reach the scan."""
    return df.where((F.col(valid_from) <= t) & (F.lit(t) < F.col(valid_to)))


def point_in_time(df: DataFrame, t: int, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """(idx, valid_from, valid_to) of rows in force at t; idx counts all rows by (valid_from, valid_to) from 0.

    A row's idx is the number of rows before the first row in force plus its place among those: the first is a count,
    so only the rows in force are numbered."""
    rows = df.select(F.col(valid_from).alias("valid_from"), F.col(valid_to).alias("valid_to"))
    held = active_at(rows, t)
    first = held.agg(F.min(F.struct("valid_from", "valid_to")).alias("f"))
    before = rows.join(F.broadcast(first), F.struct("valid_from", "valid_to") < F.col("f"), "inner").agg(F.count("*").alias("n"))
    w = Window.orderBy("valid_from", "valid_to")
    return held.crossJoin(F.broadcast(before)).select((F.row_number().over(w) - 1 + F.col("n")).alias("idx"), "valid_from", "valid_to")


def key_slice(df: DataFrame, key: str, start, end) -> DataFrame:
    return df.where(F.col(key).between(start, end))


def snapshot_as_of(snapshots: DataFrame, t: int, column: str = "snapshot_ts") -> DataFrame:
    """The rows of the newest snapshot not after t; an error if there is none."""
    newest = snapshots.where(F.col(column) <= t).agg(F.max(column)).first()[0]
    if newest is None:
        raise ValueError(f"no snapshot at or before {t}")
    return snapshots.where(F.col(column) == newest)


commit_as_of = snapshot_as_of


def as_of(df: DataFrame, business: int, system: int | None = None) -> DataFrame:
    """Rows of the newest system version (not after system) whose business interval holds business."""
    a, b = ("business_valid_from", "business_valid_to") if "business_valid_from" in df.columns else ("valid_from", "valid_to")
    versions = df if system is None else df.where(F.col("system_from") <= system)
    newest = versions.agg(F.max("system_from").alias("__newest"))
    return active_at(versions, business, a, b).join(F.broadcast(newest), F.col("system_from") == F.col("__newest")).drop("__newest")


def bitemporal_overlaps(df: DataFrame, key: str, position: str) -> DataFrame:
    """(key, a, b): pairs of positions of one key whose business and system intervals both overlap."""
    cols = ["business_valid_from", "business_valid_to", "system_from", "system_to"]
    side = lambda p: df.select(F.col(key).alias(f"{p}_key"), F.col(position).alias(p), *(F.col(c).alias(f"{p}_{c}") for c in cols))
    overlap = lambda lo, hi: (F.col(f"a_{lo}") < F.col(f"b_{hi}")) & (F.col(f"b_{lo}") < F.col(f"a_{hi}"))
    on = (F.col("a_key") == F.col("b_key")) & (F.col("a") < F.col("b")) & overlap("business_valid_from", "business_valid_to") & overlap("system_from", "system_to")
    return side("a").join(side("b"), on).select(F.col("a_key").alias(key), "a", "b")


def to_bitemporal(df: DataFrame, system_from: int, ingest_ts: int) -> DataFrame:
    """Adds business, system, event, ingest and date columns to a table with valid_from and valid_to."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("valid_from") / (86400 * 10**9)).cast("int"))
    return df.withColumns({"business_valid_from": F.col("valid_from"), "business_valid_to": F.col("valid_to"), "system_from": F.lit(system_from).cast("long"), "system_to": F.lit(OPEN_END).cast("long"), "event_ts": F.col("valid_from"), "ingest_ts": F.lit(ingest_ts).cast("long"), "business_date": day})
