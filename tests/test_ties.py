"""Queries over rows that tie: many rows of one time, runs of equal prices."""

import duckdb
import pytest
from pyspark.sql import functions as F

from veldspar import catalogue
from veldspar.functions import series as S

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def test_tick_to_trade_over_runs_of_equal_prices(spark, tmp_path):
    duckdb.sql("SELECT event_id * 60 + k AS event_id, ts, user_id, event_type, value, props FROM '/root/testdata/sf0.001/events.parquet', range(60) t(k)").write_parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = duck.execute(SQL["TRD01_tick_to_trade"]).fetchall()
    assert sorted(tuple(x) for x in QUERIES["TRD01_tick_to_trade"](spark, str(tmp_path)).collect()) == sorted(want)


@pytest.mark.parametrize("n", [5, 16, 17, 20, 31])
def test_block_mavg(spark, n):
    rows = [(k % 2, k, None if k % 7 == 3 else (k * 37 % 101) / 10) for k in range(200)]
    s = S.Series(spark.createDataFrame(rows, "g long, t long, c double"), ("g",), ("t",))
    for x in S.mavg(S.block_mavg(s, "c", n, "blocks"), "c", n).df.collect():
        assert x.blocks == pytest.approx(x.mavg, rel=1e-12), x.t
    with pytest.raises(ValueError):
        S.block_mavg(s, "c", 32)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_klines_take_the_same_rows_of_one_time(spark, tmp_path, parts):
    """Whatever the order and the number of files."""
    orders = spark.range(400).select(F.col("id").alias("o_orderkey"), F.lit(3).cast("long").alias("o_custkey"), (F.col("id") * 7919 % 400).cast("double").alias("o_totalprice"), F.lit("2001-01-01").cast("timestamp_ntz").alias("o_orderdate"))
    orders.repartition(parts).write.parquet(f"{tmp_path}/orders.parquet")
    assert [x.close for x in QUERIES["SRC16_klines"](spark, str(tmp_path)).collect()] == [float(x) for x in range(20)]
