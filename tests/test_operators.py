"""Hand-computed cases of the operators that have no SQL beside them, and of edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from veldspar.engine import Engine
from veldspar.functions import scalars as C
from veldspar.functions import series as S
from veldspar.operators import aggregates as A
from veldspar.operators import banking as B
from veldspar.operators import forecast as FC
from veldspar.operators import graph as G
from veldspar.operators import mitigation as M
from veldspar.operators import quality as Q
from veldspar.operators import temporal as J
from veldspar.operators import trading as T
from veldspar.operators import vector as V


def prices(spark, values, by=None):
    return S.Series(spark.createDataFrame([(by or "a", i, float(x)) for i, x in enumerate(values)], "k string, t long, x double"), ("k",), ("t",))


def column(s, name):
    return [r[name] for r in s.df.orderBy("t").collect()]


def test_rolling_mean(spark):
    got = column(S.mavg(prices(spark, [100, 101, 99, 102, 103, 104]), "x", 3, "m"), "m")
    assert got == pytest.approx([100, 100.5, 100, 100 + 2 / 3, 101 + 1 / 3, 103])


def test_linear_scan_over_chunks(spark):
    s = prices(spark, range(50))
    got = column(S.linear_scan(s, F.lit(0.9), F.col("x") * 0.1, "y", chunk=7), "y")
    y, want = 0.0, []
    for x in range(50):
        y = 0.9 * y + 0.1 * x
        want.append(y)
    assert got == pytest.approx(want)


def test_rsi_without_losses_or_moves(spark):
    assert column(S.rsi(prices(spark, [1, 2, 3, 4]), "x", 2), "rsi") == [None, None, 100.0, 100.0]
    assert column(S.rsi(prices(spark, [5, 5, 5, 5]), "x", 2), "rsi") == [None, None, 50.0, 50.0]


def test_black_scholes(spark):
    df = spark.createDataFrame([("call", 100.0, 100.0, 1.0, 0.05, 0.2), ("put", 100.0, 100.0, 1.0, 0.05, 0.2), ("C", 110.0, 100.0, 0.0, 0.05, 0.2), ("p", 0.0, 100.0, 1.0, 0.05, 0.0)], "kind string, s double, k double, t double, r double, v double")
    bs = C.BlackScholes("kind", "s", "k", "t", "r", "v")
    got = df.select(bs.price().alias("p"), bs.delta().alias("d"), bs.gamma().alias("g")).collect()
    assert [r.p for r in got] == pytest.approx([10.4506, 5.5735, 10, 100], abs=1e-4)
    assert got[0].d - got[1].d == pytest.approx(1) and got[0].g == pytest.approx(0.01876, abs=1e-5) and got[2].d == 1.0


def test_truncation_of_negative_times(spark):
    row = spark.createDataFrame([(-1,)], "t long").select(C.xbar("t", 10).alias("x"), C.trunc_time("t", "SS").alias("s")).first()
    assert (row.x, row.s) == (0, -(10**9))
    with pytest.raises(ValueError):
        C.trunc_time("t", "WW")


def test_matching(spark):
    orders = [(0, 1, 0, 101.0, 5), (1, 1, 0, 100.5, 3), (2, 0, 0, 99.0, 4), (3, 0, 1, 0.0, 6), (4, 1, 1, 0.0, 9), (5, 0, 1, 0.0, 1)]
    df = spark.createDataFrame([("s", *o) for o in orders], "sym string, seq long, side int, is_mkt int, price double, qty long")
    got = [(r.side, r.price, r.qty) for r in T.match_orders(df, ["sym"], "seq").orderBy("n").collect()]
    assert got == [(0, 100.5, 3), (0, 101.0, 3), (1, 99.0, 4), (0, 101.0, 1)]


def test_order_book(spark):
    rows = [(1, 0, 10.0, 5, 0), (2, 0, 10.0, 7, 0), (3, 0, 9.5, 1, 0), (4, 1, 10.5, 4, 0), (1, 0, 0.0, 2, 2), (2, 0, 0.0, 0, 1), (4, 1, 0.0, 9, 2)]
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "sym string, seq long, order_id long, side int, price double, qty long, action int")
    assert sorted(tuple(r)[1:] for r in T.reconstruct_l2(df, ["sym"], "seq", 5).collect()) == [(0, 1, 10.0, 3), (0, 2, 9.5, 1)]


def test_backtest_and_report(spark):
    px, sig = [100, 110, 121, 100, 90, 95, 99], [1, 1, 0, -1, -1, 1, 1]
    df = spark.createDataFrame([("a", i * T.DAY, float(p), s) for i, (p, s) in enumerate(zip(px, sig, strict=True))], "sym string, ts long, close double, signal int")
    fills = T.backtest(df, ["sym"], cost_bps=10)
    got = [(r.entry_ts // T.DAY, r.exit_ts // T.DAY, r.side, r.reason) for r in fills.orderBy("entry_ts").collect()]
    assert got == [(0, 2, 1, "signal"), (3, 5, -1, "signal")]
    rep = T.backtest_report(fills, ["sym"]).first()
    assert rep.n_trades == 2 and rep.win_rate == 1.0 and rep.maxdd == 0.0
    assert rep.total_ret == pytest.approx((1 + 0.21 - 0.001) * (1 + 100 / 95 - 1 - 0.001) - 1)
    assert T.backtest(df, ["sym"], take=0.05).orderBy("entry_ts").first().reason == "take_profit"


def test_portfolio(spark):
    rows = [("a", 0, 10.0, 1), ("b", 0, 20.0, 0), ("a", 1, 11.0, 1), ("b", 1, 20.0, 1), ("a", 2, 11.0, 0), ("b", 2, 22.0, 1)]
    df = spark.createDataFrame([("p", *r) for r in rows], "book string, symbol string, ts long, close double, signal int")
    got = T.portfolio(df, ["book"], "symbol").orderBy("ts").collect()
    assert [r.nav for r in got] == pytest.approx([1.0, 1.1, 1.1 * 1.05]) and [r.n_active for r in got] == [1, 2, 1]


def test_asof_keeps_the_last_of_equal_times(spark):
    left = spark.createDataFrame([(1, 5), (2, 10), (3, 1)], "id long, t long")
    right = spark.createDataFrame([(5, 0, "a"), (5, 1, "b"), (7, 0, "c")], "rt long, seq long, v string")
    for chunk in (None, 3):
        got = {r.id: r.v for r in J.asof_join(left, right, "t", "rt", ["v"], seq="seq", chunk=chunk).collect()}
        assert got == {1: "b", 2: "c", 3: None}
    assert {r.id: r.v for r in J.asof_join(left, right, "t", "rt", ["v"], seq="seq", tolerance=2).collect()}[2] is None


def test_khop_budgets(spark):
    edges = spark.createDataFrame([(i, i + 1, 0, 0, 100) for i in range(5)] + [(0, 5, 0, 200, 300)], "src long, dst long, edge_type int, valid_from long, valid_to long")
    seeds = spark.createDataFrame([(0,)], "id long")
    assert sorted(map(tuple, G.khop(edges, seeds, 3, 50).collect())) == [(1, 1), (2, 2), (3, 3)]
    for limit in ({"max_hops": 2}, {"max_edges": 1}, {"max_rows": 1}, {"cancelled": lambda: True}):
        with pytest.raises(G.BudgetExceeded):
            G.khop(edges, seeds, 3, 50, **limit)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 0.0], "y"), (3, [2.0, 0.0], "x")], "id long, embedding array<float>, label string")
    assert [tuple(r) for r in V.knn(df, [1.0, 0.0], 2, metric="cosine").collect()] == [(1, 0.0), (3, 0.0)]
    assert [r.id for r in V.knn(df, [0.0, 0.0], 5, label="x").collect()] == [1, 3]
    with pytest.raises(ValueError):
        V.knn(df, [0.0], 1, metric="hamming")
    assert [V.adaptive_plan(m, 1000).strategy for m in (1000, 5, 100, 500)] == ["post_filter", "pre_filter_exact", "filtered_index", "oversample"]
    assert V.adaptive_plan(100, 1000).oversample == 15


def test_greedy_mitigation(spark):
    loans = spark.createDataFrame([(1, 100.0, 1.0), (2, 50.0, 2.0), (3, 10.0, 0.0)], "loan_id long, ead double, priority double")
    coll = spark.createDataFrame([(1, 100.0, 0.1, 0.1, 0.0, 1.0), (2, 30.0, 0.0, 0.0, 0.0, 5.0)], "col_id long, value double, haircut double, fx_haircut double, maturity_mm double, priority double")
    guar = spark.createDataFrame([(1, 40.0, 0.0)], "guarantor_id long, amount double, priority double")
    edges = spark.createDataFrame([(1, 1, "optimizable", 0), (1, 2, "optimizable", 1), (2, 2, "specified", 2)], "col_id long, loan_id long, allocation_mode string, seq long")
    guards = spark.createDataFrame([(1, 1, "optimizable")], "guarantor_id long, loan_id long, allocation_mode string")
    got = {r.loan_id: (round(r.collateral_cover, 6), round(r.guarantee_cover, 6), round(r.uncovered, 6)) for r in M.allocate(loans, coll, guar, edges, guards).collect()}
    # the specified 30 of collateral 2 go to loan 2; of collateral 1's 80, 20 fill loan 2 and 60 go to loan 1; the guarantee covers the 40 left
    assert got == {1: (60.0, 40.0, 0.0), 2: (50.0, 0.0, 0.0), 3: (0.0, 0.0, 10.0)}
    with pytest.raises(ValueError):
        M.check_edges(edges.withColumn("loan_id", F.col("loan_id") + 5), "col_id", coll, loans)


def test_discounting_and_options(spark):
    curve = [(365, 0.02), (730, 0.04)]
    row = spark.range(1).select(B.zero_rate(curve, F.lit(547.5)).alias("z"), B.zero_rate(curve, F.lit(1.0)).alias("a"), B.zero_rate(curve, F.lit(9999.0)).alias("b"), B.black76(F.lit(100.0), F.lit(100.0), F.lit(0.2), F.lit(1.0), F.lit(1.0)).alias("c"), B.black76(F.lit(100.0), F.lit(90.0), F.lit(0.0), F.lit(1.0), F.lit(0.5)).alias("i")).first()
    assert (row.z, row.a, row.b) == pytest.approx((0.03, 0.02, 0.04)) and row.c == pytest.approx(7.9656, abs=1e-3) and row.i == 5.0


def test_prepayments_keep_the_total(spark):
    out = spark.range(1).select(B.prepayment_bands(F.array(*map(F.lit, (20.0, 30.0, 50.0))), 0.1).alias("x")).first().x
    assert out[0] == pytest.approx(28.0) and sum(out) + (100 - sum(out)) == pytest.approx(100) and sum(out) <= 100 + 1e-9


def test_covariance_and_pca(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "a double, b double")
    assert [r.eigenvalue for r in A.pca(df, ["a", "b"]).orderBy("component").collect()] == pytest.approx([2.0, 0.0])
    assert [r.cov for r in A.covariance_matrix(df.limit(1), ["a", "b"]).collect()] == [0.0] * 4


def test_gate_and_override(spark):
    result = Q.dq_gate(spark.range(3), [{"kind": "range", "column": "id", "max": 1, "name": "r"}])
    with pytest.raises(Q.GateClosed):
        Q.publish(spark.range(3), result, lambda df: None)
    kept = []
    assert Q.publish(spark.range(3), result, kept.append, {"r": "known"}, "me") == [{"rule": "r", "user": "me", "reason": "known"}] and kept


def test_replay_refuses_what_changes(spark):
    record = Q.lineage_record("SELECT rand() AS x", spark.sql("SELECT rand() AS x"), [])
    with pytest.raises(ValueError):
        Q.replay(record, spark.sql)


def test_reserved_models(spark):
    with pytest.raises(NotImplementedError):
        FC.forward_probability(spark.range(1), 1, 1, [], model="gbdt")


def test_engine(spark):
    e = Engine(spark)
    e.register("nums", spark.range(4))
    e.define(["top", "t"], lambda eng, name, n: eng.table(name).orderBy(F.desc("id")).limit(n))
    assert [r.id for r in e.sql("t('nums', 2)").collect()] == [3, 2]
    assert e.sql("nums").count() == 4 and e.sql("CREATE TABLE more AS SELECT id + 1 AS k FROM nums").count() == 4
    assert e.sql("DROP TABLE more").first().dropped and not math.isnan(e.last_micros)
    with pytest.raises(KeyError):
        e.table("more")
