"""Users' own aggregates and window functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.types import _parse_datatype_string as parsed


@dataclass(frozen=True)
class Algebraic:
    """An aggregate whose state merges: named built-in aggregates of the arguments (so partial sums are taken before the
    shuffle), and the result from them."""

    state: dict[str, Callable[..., Column]]
    finish: Callable[[dict[str, Column]], Column]

    def column(self, *args: str) -> Column:
        return self.finish({k: f(*(F.col(a) for a in args)) for k, f in self.state.items()})

    def by(self, df: DataFrame, keys: Sequence[str], args: Sequence[str], out: str) -> DataFrame:
        return df.groupBy(*keys).agg(self.column(*args).alias(out))


def window_udf(df: DataFrame, by: Sequence[str], order: Sequence[str], fn: Callable[[np.ndarray], np.ndarray], value: str, out: str, returns: str = "double") -> DataFrame:
    """Adds fn of a partition's values in order, one result a row; frames don't apply. A partition is one unit of work:
    what built-in windows can express belongs there."""
    schema = StructType([*df.schema.fields, StructField(out, parsed(returns))])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        return pdf.assign(**{out: fn(pdf[value].to_numpy())})

    return df.groupBy(*by).applyInPandas(one, schema)
