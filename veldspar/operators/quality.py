"""Data quality: reports, checks, rule gates with audited overrides, column statistics and lineage records."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.series import safe

KINDS = ("completeness", "uniqueness", "freshness", "range", "referential", "reconciliation")
#: Functions whose results change from run to run.
CHANGING = ("rand", "randn", "uuid", "now", "current_timestamp", "current_date", "unix_timestamp", "monotonically_increasing_id", "spark_partition_id", "shuffle", "input_file_name")


def dq_report(df: DataFrame, ts: str, symbol: str, order: str, numbers: Sequence[str]) -> DataFrame:
    """One row: n_rows, n_symbols, n_nan, n_inf, n_duplicates (repeats of a (ts, symbol)), n_backward (times that go back
    in a symbol's order of rows), min_rows and max_rows a symbol. Counts by symbol are partial before they are shuffled."""
    nan = sum((F.isnan(c).cast("long") for c in numbers), F.lit(0))
    inf = sum((F.coalesce((F.abs(F.col(c)) == float("inf")).cast("long"), F.lit(0)) for c in numbers), F.lit(0))
    back = F.col(ts) < F.lag(ts).over(Window.partitionBy(symbol).orderBy(order))
    by_symbol = df.withColumn("__back", back).groupBy(symbol).agg(F.count("*").alias("n"), F.coalesce(F.sum(nan), F.lit(0)).alias("nan"), F.coalesce(F.sum(inf), F.lit(0)).alias("inf"), F.count(F.when(F.col("__back"), 1)).alias("back"))
    twice = df.groupBy(symbol, ts).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_duplicates"))
    main = by_symbol.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_symbols"), F.coalesce(F.sum("nan"), F.lit(0)).alias("n_nan"), F.coalesce(F.sum("inf"), F.lit(0)).alias("n_inf"), F.coalesce(F.sum("back"), F.lit(0)).alias("n_backward"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"))
    return main.crossJoin(F.broadcast(twice))


ISSUES = ("n_nan", "n_inf", "n_duplicates", "n_backward")


def dq_check(report: DataFrame) -> DataFrame:
    """(issue, count) of the issues that occur."""
    return report.select(F.explode(F.array(*(F.struct(F.lit(c).alias("issue"), F.col(c).alias("count")) for c in ISSUES))).alias("x")).select("x.*").where("count > 0")


def health_check(report: DataFrame, newest_age_days: float | None, max_age: float = 7, min_rows: int = 50) -> DataFrame:
    """(check, status): five checks, ok or warn. newest_age_days: how old the newest row is, None without rows."""
    ok = lambda c: F.when(c, "ok").otherwise("warn")
    fresh = F.lit(newest_age_days is not None and newest_age_days <= max_age)
    checks = {"rows": F.coalesce(F.col("min_rows"), F.lit(0)) >= min_rows, "fresh": fresh, "finite": (F.col("n_nan") + F.col("n_inf")) == 0, "unique": F.col("n_duplicates") == 0, "ordered": F.col("n_backward") == 0}
    return report.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), ok(v).alias("status")) for k, v in checks.items()))).alias("x")).select("x.*")


def dq_gate(df: DataFrame, rules: str | list[dict], tables: Callable[[str], DataFrame] | None = None, now: int | None = None) -> DataFrame:
    """(rule, kind, passed, measured, threshold): each rule of a JSON array over df.

    completeness: column, min_ratio. uniqueness: columns. freshness: column, max_age (against now). range: column, min,
    max. referential: column, table, key. reconciliation: column, table, other_column, tolerance."""
    parsed = json.loads(rules) if isinstance(rules, str) else rules
    out = None
    for i, rule in enumerate(parsed):
        kind = rule.get("kind")
        if kind not in KINDS:
            raise ValueError(f"no such rule: {kind}")
        name = rule.get("name", f"{kind}_{i}")
        if kind == "completeness":
            measured, limit, passed = F.coalesce(F.avg(F.col(rule["column"]).isNotNull().cast("double")), F.lit(0.0)), rule.get("min_ratio", 1.0), lambda m, t: m >= t
            own = df.agg(measured.alias("m"))
        elif kind == "uniqueness":
            own, limit, passed = df.groupBy(*rule["columns"]).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("double").alias("m")), 0.0, lambda m, t: m <= t
        elif kind == "freshness":
            own, limit, passed = df.agg((F.lit(now) - F.max(rule["column"])).cast("double").alias("m")), float(rule["max_age"]), lambda m, t: F.coalesce(m <= t, F.lit(False))
        elif kind == "range":
            c = F.col(rule["column"])
            bad = (c < rule["min"] if "min" in rule else F.lit(False)) | (c > rule["max"] if "max" in rule else F.lit(False))
            own, limit, passed = df.agg(F.count(F.when(bad, 1)).cast("double").alias("m")), 0.0, lambda m, t: m <= t
        elif kind == "referential":
            other = tables(rule["table"]).select(F.col(rule["key"]).alias(rule["column"])).distinct()
            own, limit, passed = df.where(F.col(rule["column"]).isNotNull()).join(other, rule["column"], "left_anti").agg(F.count("*").cast("double").alias("m")), 0.0, lambda m, t: m <= t
        else:
            other = tables(rule["table"]).agg(F.sum(rule.get("other_column", rule["column"])).alias("o"))
            own, limit, passed = df.agg(F.sum(rule["column"]).alias("s")).crossJoin(F.broadcast(other)).select(F.abs(F.coalesce("s", F.lit(0.0)) - F.coalesce("o", F.lit(0.0))).cast("double").alias("m")), float(rule.get("tolerance", 0.0)), lambda m, t: m <= t
        row = own.select(F.lit(name).alias("rule"), F.lit(kind).alias("kind"), passed(F.col("m"), F.lit(float(limit))).alias("passed"), F.col("m").alias("measured"), F.lit(float(limit)).alias("threshold"))
        out = row if out is None else out.unionByName(row)
    return out


class GateClosed(RuntimeError):
    """A failing rule without an override."""


def publish(df: DataFrame, result: DataFrame, write: Callable[[DataFrame], None], overrides: dict[str, str] | None = None, user: str = "") -> list[dict]:
    """Writes df if every rule passed or is overridden with a reason; returns the audit rows."""
    failed = [r["rule"] for r in result.where("not passed").collect()]
    overrides = overrides or {}
    missing = [x for x in failed if not overrides.get(x)]
    if missing:
        raise GateClosed(", ".join(missing))
    write(df)
    return [{"rule": x, "user": user, "reason": overrides[x]} for x in failed]


def column_stats(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_null, min, max) of every column, in one pass; min and max as text, of types that have an order."""
    kinds = {c: k for c, k in df.dtypes}
    plain = [c for c, k in kinds.items() if not re.match("array|map|struct|binary", k)]
    n = F.count("*")
    each = [F.struct(F.lit(c).alias("column"), n.alias("n_rows"), (n - F.count(c)).alias("n_null"), (F.min(c) if c in plain else F.lit(None)).cast("string").alias("min"), (F.max(c) if c in plain else F.lit(None)).cast("string").alias("max")) for c in df.columns]
    return df.agg(F.array(*each).alias("x")).select(F.inline("x"))


def checksum(df: DataFrame) -> tuple[int, int]:
    """(rows, checksum) whatever the order of rows: a sum of 64-bit hashes."""
    row = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def lineage_record(query: str, df: DataFrame, sources: Sequence[str], models: Sequence[str] = (), functions: Sequence[str] = ()) -> dict:
    """What a run was: text and its hash, sources, models, functions, whether it can change, rows and checksum."""
    words = set(re.findall(r"\b(\w+)\s*\(", query.lower())) | {f.lower() for f in functions}
    n, total = checksum(df)
    return {"query": query, "query_hash": hashlib.sha256(query.encode()).hexdigest(), "sources": sorted(sources), "models": sorted(models), "functions": sorted(functions), "changing": sorted(words & set(CHANGING)), "rows": n, "checksum": str(total)}


def replay(record: dict, run: Callable[[str], DataFrame]) -> bool:
    """Runs the query again and compares; a query that can change is refused."""
    if record["changing"]:
        raise ValueError(f"can't be replayed: {', '.join(record['changing'])}")
    n, total = checksum(run(record["query"]))
    return (n, str(total)) == (record["rows"], record["checksum"])


def ratio(report: DataFrame) -> DataFrame:
    """(share) of rows without an issue."""
    return report.select(safe(F.col("n_rows") - F.col("n_duplicates"), F.col("n_rows"), F.lit(1.0)).alias("share"))
