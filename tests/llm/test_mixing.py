import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veldspar.llm import mixing


def filled(sizes, weights, budget, cap):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    most, out, open_ = {s: cap * sizes[s] for s in names}, {}, set(names)
    left = budget * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= most[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        out |= {s: most[s] for s in over}
        left -= sum(most[s] for s in over)
        open_ -= over
    return out


def check(docs, rows):
    got = {r.doc_id: r for r in mixing.op10(docs).collect()}
    sizes = {}
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert got[r.doc_id].size == n
        sizes[r.source] = sizes.get(r.source, 0) + n
    aims = filled(sizes, mixing.WEIGHTS, mixing.BUDGET, mixing.CAP)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        g = got[r.doc_id]
        assert g.source_size == sizes[r.source] and g.target == pytest.approx(aims[r.source])
        assert 0 <= g.taken <= 2 * g.size and g.copies in (int(g.rate), int(g.rate) + 1)
        taken[r.source] += g.taken
    return aims, taken


def test_targets_match_brute_force(docs):
    check(docs, docs.collect())


def test_taken_is_near_the_target(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97).cast("int")).alias("text"), F.when(F.col("id") % 10 < 4, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    aims, taken = check(docs, docs.collect())
    assert all(abs(taken[s] - aims[s]) <= 0.05 * aims[s] for s in aims if aims[s])
    assert sorted(map(tuple, mixing.op10(docs.repartition(7)).collect())) == sorted(map(tuple, mixing.op10(docs).collect()))


def test_mix_emits_copies_in_the_same_columns(docs):
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {k: v for k, v in plan.items() if v}


def test_draws_match_brute_force(docs):
    for r in mixing.mix_plan(docs).collect():
        text = next(x.text for x in docs.collect() if x.doc_id == r.doc_id) or ""
        u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()[:12], 16) / 2**48
        assert r.copies == int(r.rate) + (u < r.rate - int(r.rate))


def test_repeated_and_null_ids_and_clashing_columns(spark):
    rows = [(k % 40 if k % 3 else None, f"w {k} " * (k % 9), "ab"[k % 2] if k % 5 else None, k, "row", 1.5, 3, "z") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, row string, u double, copies int, aim string")
    plan, out = mixing.mix_plan(docs).collect(), mixing.mix(docs)
    assert out.columns == docs.columns and len(plan) == 4000
    got = out.collect()
    words = lambda t: len((t or "").split())
    assert len(got) == sum(r.copies for r in plan) and sum(words(r.text) for r in got) == sum(r.size * r.copies for r in plan)
    times = Counter(r.size for r in got)  # that column tells the rows apart
    assert Counter((docs_row[0], words(docs_row[1]), times[docs_row[3]]) for docs_row in rows) == Counter((r.doc_id, r.size, r.copies) for r in plan)


def test_empty(docs):
    assert mixing.op10(docs.limit(0)).collect() == []
    assert mixing.mix(docs.limit(0)).collect() == []
