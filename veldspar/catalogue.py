"""All registered queries of the engine's own operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of veldspar.plans, each with QUERIES: name -> (function(spark, sf_dir), SQL or None).
MODULES: tuple[str, ...] = ("relational", "rolling", "values", "relations", "exposures", "money", "operations", "forecasts", "support")


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from importlib import import_module

    out: dict = {}
    for name in MODULES:
        out |= import_module(f"veldspar.plans.{name}").QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join of purchases with the clicks before them: the latest click of the same user."""
    from veldspar.plans.relations import QUERIES

    return QUERIES["JN01_asof"][0](spark, sf_dir)
