"""The queries opN_<name> and pipeline, with DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import decontamination, fingerprints, language_id, mixing, near_dedup, pii, quality, secrets, tokens, toxicity
from ._spark import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_decontamination": lambda spark, d: decontamination.op1(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op2_near_dedup": lambda spark, d: near_dedup.op2(table(spark, d, "documents")),
        "op3_fingerprints": lambda spark, d: fingerprints.op3(table(spark, d, "documents")),
        "op4_tokens": lambda spark, d: tokens.op4(table(spark, d, "documents")),
        "op5_secrets": lambda spark, d: secrets.op5(table(spark, d, "documents")),
        "op6_toxicity": lambda spark, d: toxicity.op6(table(spark, d, "documents"), table(spark, d, "labels")),
        "op7_language": lambda spark, d: language_id.op7(table(spark, d, "documents")),
        "op8_pii": lambda spark, d: pii.op8(table(spark, d, "documents")),
        "op9_quality": lambda spark, d: quality.op9(table(spark, d, "documents"), table(spark, d, "labels")),
        "op10_mixing": lambda spark, d: mixing.op10(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) | {"op1_decontamination": decontamination.OP1_SQL, "op2_near_dedup": near_dedup.OP2_SQL, "op10_mixing": mixing.OP10_SQL}
