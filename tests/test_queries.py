"""Every registered query of the engine against its DuckDB SQL, over the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from veldspar import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture
def duck():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE TABLE {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return out


def rows(df):
    df = df[sorted(df.columns)]
    out = [tuple(None if pd.isna(x) else float(x) if isinstance(x, (float, int, np.number)) and not isinstance(x, bool) else str(x) for x in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((x is None, isinstance(x, str), round(x, 3) if isinstance(x, float) else x) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        return
    try:
        want = duck.execute(SQL[name]).df()
    except duckdb.InternalException as e:  # an assertion in DuckDB itself, on some large statements at this size
        pytest.skip(f"DuckDB broke off: {str(e)[:80]}")
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, rel=1e-6, abs=2e-4) if all(isinstance(v, float) for v in x + y) else all(v == w or isinstance(v, float) and isinstance(w, float) and abs(v - w) <= 2e-4 + 1e-6 * abs(w) for v, w in zip(x, y, strict=True))


def test_flagship_has_rows(spark):
    assert catalogue.flagship(spark, SF).count() > 0
