"""Files in and out: CSV and Parquet, a date/symbol store, hot and cold tables, a day cache, and market providers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veldspar.engine import Engine

from .store import TableStore


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """With a header; the schema is inferred once unless it is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load(engine: Engine, name: str, path: str) -> DataFrame:
    """A CSV or Parquet file as a named table."""
    return engine.register(name, read_csv(engine.spark, path) if path.endswith(".csv") else read_parquet(engine.spark, path))


def save(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def refresh(engine: Engine, name: str, path: str, schema) -> DataFrame:
    """A table over all files that are in the folder by now; call it again to take in new ones."""
    return engine.register(name, engine.spark.read.schema(schema).parquet(path))


def persist(engine: Engine, name: str, query: str, root: str) -> DataFrame:
    """A query's result as a table that later engines find under root; one commit, so it is there whole or not at all."""
    store = TableStore(engine.spark, root)
    store.commit(name, engine.sql(query), "overwrite")
    return engine.register(name, store.scan(name))


def restore(engine: Engine, root: str) -> list[str]:
    """Registers the tables kept under root; their names in order."""
    store = TableStore(engine.spark, root)
    found = [n for n in store.tables() if store.log(n)[-1]["mode"] != "delete"]
    for name in found:
        engine.register(name, store.scan(name))
    return found


def forget(engine: Engine, name: str, root: str) -> None:
    """Drops the table here and under root; scans as of earlier times still find it there."""
    TableStore(engine.spark, root).commit(name, None, "delete")
    engine.drop(name)


# --- a store by date and symbol


def hdb_save(df: DataFrame, root: str, table: str, date: str, symbol: str = "symbol") -> None:
    """Adds or replaces the date's partitions (one folder for each date and symbol); others stay."""
    rows = df.withColumn("date", F.lit(date))
    rows.repartition(symbol).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", symbol).parquet(f"{root}/{table}")


def hdb_scan(spark: SparkSession, root: str, table: str, start: str, end: str, symbol: str | None = None, column: str = "symbol") -> DataFrame:
    """Rows of the dates from start to end (text order, both kept), of one symbol if named; other folders aren't read."""
    rows = spark.read.option("recursiveFileLookup", False).parquet(f"{root}/{table}").withColumn("date", F.col("date").cast("string")).where(F.col("date").between(start, end))
    return rows if symbol is None else rows.where(F.col(column) == symbol)


def hdb_load(spark: SparkSession, root: str, table: str, date: str, symbol: str) -> DataFrame:
    return hdb_scan(spark, root, table, date, date, symbol)


def rollover(engine: Engine, name: str, root: str, date: str, symbol: str = "symbol") -> DataFrame:
    """Writes the hot table to the date's partitions and leaves an empty table of its schema in its place."""
    hot = engine.table(name)
    hdb_save(hot, root, name, date, symbol)
    return engine.register(name, engine.spark.createDataFrame([], hot.schema))


def hot_and_cold(engine: Engine, name: str, root: str, start: str, end: str, symbol: str | None = None, order: str = "t", column: str = "symbol") -> DataFrame:
    """The hot table and the stored dates as one, in order of time."""
    hot = engine.table(name)
    hot = hot if symbol is None else hot.where(F.col(column) == symbol)
    return hdb_scan(engine.spark, root, name, start, end, symbol, column).drop("date").unionByName(hot).orderBy(order)


def checkpoint_day(engine: Engine, name: str, root: str, today: str, held: str, symbol: str = "symbol") -> str:
    """One run of the scheduled job: stores the hot table under the held date; on a new date it rolls over. Returns the date held from now on."""
    if today != held:
        rollover(engine, name, root, held, symbol)
    else:
        hdb_save(engine.table(name), root, name, today, symbol)
    return today


# --- providers

KLINES = "code string, period string, ts long, open double, high double, low double, close double, volume double, amount double, adjust string"
TICKS = "code string, ts long, price double, volume double, amount double, side string, bid double, ask double"


def _newest(rows: DataFrame, schema: str, most: int) -> DataFrame:
    """The `most` newest rows in order of ts; of rows of one ts those that are least by the other columns, in their order."""
    names = [c.split()[0] for c in schema.split(", ")]
    others = [c for c in names if c != "ts"]
    return rows.select(*names).orderBy(F.desc("ts"), *others).limit(most).orderBy("ts", *others)


class Providers:
    """Named sources of bars and ticks: functions (spark, code, period or None) -> DataFrame. Reads go through a cache
    of files by provider, kind and code; the newest day of the cache can still change and is fetched again."""

    def __init__(self, spark: SparkSession, cache: str | None = None):
        self.spark, self.cache = spark, cache
        self.known: dict[str, dict[str, Callable]] = {}

    def add(self, name: str, klines: Callable | None = None, ticks: Callable | None = None) -> None:
        self.known[name] = {"klines": klines, "ticks": ticks}

    def names(self) -> DataFrame:
        return self.spark.createDataFrame([(k, bool(v["klines"]), bool(v["ticks"])) for k, v in sorted(self.known.items())], "provider string, klines boolean, ticks boolean")

    def _source(self, provider: str, kind: str) -> Callable:
        if provider not in self.known or not self.known[provider][kind]:
            raise KeyError(f"{provider} has no {kind}")
        return self.known[provider][kind]

    def klines(self, provider: str, code: str, period: str = "1d", start: int | None = None, end: int | None = None, most: int = 1000, adjust: str = "qfq") -> DataFrame:
        rows = self._source(provider, "klines")(self.spark, code, period).where((F.col("code") == code) & (F.col("period") == period) & (F.col("adjust") == adjust))
        rows = rows if start is None else rows.where(F.col("ts") >= start)
        rows = rows if end is None else rows.where(F.col("ts") <= end)
        return _newest(rows, KLINES, most)

    def ticks(self, provider: str, code: str, most: int = 500) -> DataFrame:
        rows = self._source(provider, "ticks")(self.spark, code, None).where(F.col("code") == code)
        return _newest(rows, TICKS, most)

    def cached(self, provider: str, kind: str, code: str, day: int = 86400 * 10**9) -> DataFrame:
        """All of a code's rows through the cache: the days before its newest one come from files, the rest is fetched and kept."""
        path = f"{self.cache}/{provider}/{kind}"
        fresh = self._source(provider, kind)(self.spark, code, "1d").where(F.col("code") == code).withColumn("day", F.floor(F.col("ts") / day))
        try:
            old = self.spark.read.parquet(path).where(F.col("code") == code)
            newest = old.agg(F.max("day")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            newest = None
        missing = fresh if newest is None else fresh.where(F.col("day") >= newest)
        missing.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("code", "day").parquet(path)
        return self.spark.read.parquet(path).where(F.col("code") == code).drop("day")
