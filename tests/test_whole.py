"""That queries read their whole input: against counts and brute force, not against the SQL beside them."""

import pytest
from pyspark.sql import functions as F

from veldspar import catalogue
from veldspar.operators import exposure as E
from veldspar.operators import graph as G
from veldspar.operators import vector as V
from veldspar.plans import relations as R

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


def test_bitemporal_queries_read_all_orders(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").toPandas()
    starts = dict(zip(orders["o_orderkey"], orders["o_orderdate"].astype("datetime64[ns]").astype("int64"), strict=True))
    of = {}
    for key, customer in zip(orders["o_orderkey"], orders["o_custkey"], strict=True):
        of.setdefault(customer, []).append(key)
    length = 100 * 86400 * 10**9
    pairs = {(c, a, b) for c, keys in of.items() for a in keys for b in keys if a < b and abs(starts[a] - starts[b]) < length}
    assert {tuple(r) for r in QUERIES["JN11_overlaps"](spark, SF).collect()} == pairs
    assert {r.o_orderkey for r in QUERIES["JN09_snapshot"](spark, SF).collect()} == set(starts)
    at = 883612800 * 10**9
    assert {r.o_orderkey for r in QUERIES["JN10_as_of"](spark, SF).collect()} == {k for k, t in starts.items() if t <= at < t + 2 * length}
    assert [tuple(r) for r in QUERIES["JN13_commit_as_of"](spark, SF).collect()] == [(300, len(starts))]


def test_beneficial_owners_of_all_customers(spark, tmp_path):
    spark.range(1, 801).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    want, paths = {}, [(k, k, 1.0) for k in range(1, 801)]
    while paths:
        company, at, share = paths.pop()
        if at > 800:
            want[company, at] = want.get((company, at), 0.0) + share
        else:
            paths += [(company, 2 * at + 1, share * 0.6), (company, 2 * at + 2, share * 0.4)]
    got = {(r.company, r.owner): r.share for r in QUERIES["LE18_beneficial_owners"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({k: x for k, x in want.items() if x >= 0.05}, abs=1e-6)


def test_beneficial_owners_at_the_end_of_a_long_chain(spark):
    stakes = spark.createDataFrame([(i + 1, i, 0.99) for i in range(20)], "owner long, owned long, pct double")
    got = {r.company: r for r in E.beneficial_owners(stakes, 0.5).collect()}
    assert sorted(got) == list(range(20)) and {r.owner for r in got.values()} == {20}
    assert got[0].share == pytest.approx(0.99**20)
    with pytest.raises(ValueError):
        E.beneficial_owners(stakes, 0.5, depth=3)


def test_transactions_of_all_amounts(spark, monkeypatch):
    events = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    dst = (events["event_id"] * 7919 + events["user_id"] * 31) % 150
    totals = QUERIES["LE16_transaction_totals"](spark, SF).toPandas()
    assert totals.groupby("dim")["n"].sum().to_dict() == {"channel": len(events), "jurisdiction": len(events)}
    assert totals[totals["dim"] == "channel"].set_index("key")["total"].to_dict() == pytest.approx(events.groupby("event_type")["value"].sum().to_dict(), abs=0.02)

    hops, near, frontier = {}, {5}, {5}
    for hop in (1, 2, 3):
        taken = [i for i in range(len(events)) if events["user_id"][i] in frontier]
        hops |= {int(events["event_id"][i]): hop for i in taken}
        frontier = {int(dst[i]) for i in taken} - near
        near |= frontier
    assert {r.tx_id: r.hop for r in QUERIES["LE17_explanation_subgraph"](spark, SF).collect()} == hops

    seen, snapshot = [], E.case_snapshot
    monkeypatch.setattr(E, "case_snapshot", lambda df, *more: seen.append(df.count()) or snapshot(df, *more))
    assert QUERIES["LE20_case_snapshot"](spark, SF).count() == (events["user_id"] % 7).nunique()
    assert seen == [len(events)]


def test_recall_of_probed_cells(spark):
    vectors = R._vectors(spark, SF).cache()
    asked, index = R._asked(spark, SF), V.build_ivf(vectors, 8)
    found = V.recalls(index, asked, 10)
    nprobe = V.enough_probes(index, asked, 10, 0.9, 3)
    one_by_one = [V.recall(V.knn(vectors, r.embedding, 10), index.search(r.embedding, 10, nprobe)) for r in asked.collect()]
    assert sum(one_by_one) / len(one_by_one) == pytest.approx(found[nprobe - 1])
    assert found[nprobe - 1] >= 0.9 and found[-1] == 1.0
    assert {r.id for r in QUERIES["VEC06_ivf_probe"](spark, SF).collect()} == {r.id for r in index.search(R.QUERY, 10, nprobe).collect()}
    assert [(r.nlist, r.nprobe, r.recall) for r in QUERIES["VEC08_ivf_tuning"](spark, SF).collect()] == [(8, n, x) for n, x in enumerate(found, 1)]
    vectors.unpersist()


def test_match_budgets(spark):
    edges = spark.createDataFrame([(i, i + 1, 0, i, 100) for i in range(5)], "src long, dst long, edge_type int, valid_from long, valid_to long")
    got = G.match(edges, [(0, 1), (1, 2)], 50, max_rows=5)
    assert sorted(map(tuple, got.select("v0", "v1", "v2").collect())) == [(i, i + 1, i + 2) for i in range(4)]
    for limit in ({"max_rows": 4}, {"cancelled": lambda: True}):
        with pytest.raises(G.BudgetExceeded):
            G.match(edges, [(0, 1), (1, 2)], 50, **limit)
