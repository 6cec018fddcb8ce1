"""The engine's front: named tables over a session, SQL, aliases, files, snapshots and timing.

Tables are temporary views of DataFrames; nothing is computed before a result is asked for.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def new_session(name: str = "veldspar", **options: str) -> SparkSession:
    """A session with what the operators expect: UTC, adaptive execution with skew joins, fair pools."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.scheduler.mode": "FAIR"}
    return builder.config(map=defaults | options).getOrCreate()


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.functions: dict[str, Callable[..., DataFrame]] = {}
        self.duration = False
        self.last_micros: int | None = None

    @classmethod
    def over(cls, spark: SparkSession, folder: str, names: Iterable[str]) -> Engine:
        """An engine with the Parquet files <folder>/<name>.parquet as tables."""
        out = cls(spark)
        for name in names:
            out.register(name, spark.read.parquet(f"{folder}/{name}.parquet"))
        return out

    def register(self, name: str, df: DataFrame) -> DataFrame:
        """df under a name, in place of any table of that name."""
        self.tables[name] = df
        df.createOrReplaceTempView(name)
        return df

    def define(self, names: Iterable[str], function: Callable[..., DataFrame]) -> None:
        """A table function under a long and any short names; it gets the engine and its arguments."""
        for name in names:
            self.functions[name] = function

    def drop(self, name: str) -> bool:
        self.tables.pop(name, None)
        return self.spark.catalog.dropTempView(name)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no such table: {name}")
        return self.tables[name]

    def call(self, name: str, *args) -> DataFrame:
        if name not in self.functions:
            raise KeyError(f"no such function: {name}")
        return self.functions[name](self, *args)

    def sql(self, query: str) -> DataFrame:
        """SQL; a bare table name; or name(arguments) of a defined function. CREATE TABLE x AS keeps the result as x."""
        began = time.perf_counter()
        text = query.strip().rstrip(";").strip()
        if re.fullmatch(r"\w+", text) and text in self.tables:
            out = self.tables[text]
        elif (m := re.fullmatch(r"(\w+)\s*\((.*)\)", text, re.S)) and m[1] in self.functions:
            out = self.call(m[1], *(_argument(x) for x in _split(m[2])))
        elif m := re.fullmatch(r"create\s+table\s+(\w+)\s+as\s+(.*)", text, re.S | re.I):
            out = self.register(m[1], self.spark.sql(m[2]))
        elif m := re.fullmatch(r"drop\s+table\s+(\w+)", text, re.I):
            out = self.spark.createDataFrame([(self.drop(m[1]),)], "dropped boolean")
        else:
            out = self.spark.sql(text)
        self.last_micros = round((time.perf_counter() - began) * 1e6)
        if self.duration:
            print(f"{self.last_micros} µs")
        return out

    def explain(self, query: str) -> str:
        """The plan with statistics."""
        return self.spark.sql(f"EXPLAIN COST {query}").first()[0]


def _split(text: str) -> list[str]:
    """Arguments at the commas outside of quotes."""
    return [x.strip() for x in re.findall(r"(?:'[^']*'|[^,'])+", text) if x.strip()]


def _argument(text: str):
    if text.startswith("'"):
        return text.strip("'")
    return float(text) if re.search(r"[.eE]", text) and re.fullmatch(r"[-+.\deE]+", text) else int(text) if re.fullmatch(r"[-+]?\d+", text) else text
