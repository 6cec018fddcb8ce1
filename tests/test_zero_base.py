"""Queries over bars with prices of 0 against their SQL, whose divisions by 0 give infinity or NaN."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar import catalogue
from veldspar.functions import series as S
from veldspar.plans._base import r

NAMES = ["AGG04_var_historical", "WIN12_momentum", "WIN25_hv", "WIN26_hv_ratio", "WIN32_regime_event", "WIN33_gap", "WIN34_rs_index", "WIN35_beta_index"]


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """The small events with single prices of 0, two one after the other, and a long run of them."""
    path = tmp_path_factory.mktemp("zeros")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").toPandas().sort_values("ts")
    place = events.groupby("event_type").cumcount()
    events.loc[place.isin([7, 60, 61]) | ((events["event_type"] == "click") & place.between(90, 125)), "value"] = 0.0
    duckdb.sql("SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM events").write_parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_as_in_sql(spark, zeros, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{zeros}/events.parquet'")
    sql = catalogue.oracle_sql()[name]
    columns = [d[0] for d in duck.execute(sql).description]
    order = "event_id" if "event_id" in columns else columns[0]
    want = duck.execute(f"SELECT * FROM ({sql}) ORDER BY {order}").fetchall()
    got = [tuple(x) for x in catalogue.queries()[name](spark, zeros).select(*columns).orderBy(order).collect()]
    assert len(got) == len(want)
    for k, column in enumerate(columns):
        mine, theirs = [x[k] for x in got], [x[k] for x in want]
        assert [x is None for x in mine] == [x is None for x in theirs], column
        assert np.allclose([x for x in mine if x is not None], [x for x in theirs if x is not None], rtol=1e-6, atol=2e-6, equal_nan=True), column


def test_ieee(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (float("nan"), 0.0), (None, 0.0), (1.0, None), (6.0, 4.0)]
    got = [x[0] for x in spark.createDataFrame(rows, "a double, b double").select(S.ieee(F.col("a"), F.col("b"))).collect()]
    inf = float("inf")
    assert got[:3] == [inf, -inf, -inf] and np.isnan(got[3]) and np.isnan(got[4]) and got[5:] == [None, None, 1.5]


def test_the_functions_keep_their_rule(spark):
    """By default a base of 0 gives momentum 0 and no gap, as the functions are defined."""
    s = S.Series(spark.createDataFrame([("a", 1, 0.0), ("a", 2, 3.0)], "k string, t long, c double"), ("k",), ("t",))
    assert [x.momentum for x in S.momentum(s, "c", 1).df.orderBy("t").collect()] == [0.0, 0.0]
    assert [x.gap for x in S.gap(s, "c", "c").df.orderBy("t").collect()] == [None, None]


def test_rounding_keeps_what_is_not_finite(spark):
    got = [x[0] for x in spark.createDataFrame([(float("inf"),), (float("-inf"),), (1e300,), (-2.5e-7,), (None,), (float("nan"),)], "x double").select(r("x")).collect()]
    assert got[:3] == [float("inf"), float("-inf"), pytest.approx(1e300)] and got[3] == 0.0 and got[4] is None and np.isnan(got[5])
