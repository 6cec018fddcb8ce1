import random

import numpy as np
import pytest

from veldspar.llm import near_dedup as N


def shingles(text, n):
    lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    for x in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(x, " ")
    w = [x for x in lowered.split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n=4):
    sets = {r[0]: shingles(r[1], n) for r in rows}
    ids, up = sorted(sets), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.fixture(scope="module")
def copies(texts):
    """Groups of copies with more and more edits, chains of copies, and a passage that many texts share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    out = list(texts)
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 150))] + passage * (rng.random() < 0.7)
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
            base = copy if rng.random() < 0.4 else base
    return list(enumerate(out, 10))


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_matches_brute_force(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    want = brute(copies)
    assert sum(1 for x in want.values() if not x[2]) > 30
    assert result(N.op2(docs)) == want


def test_large_nodes_are_branched_and_blocked(spark, copies, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 4)
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    assert result(N.op2(docs)) == brute(copies)


def test_hot_copies_and_stars_and_one_large_component(spark, monkeypatch):
    """A third of all rows are copies of one text, another third are near copies of one another; some look like them."""
    monkeypatch.setattr(N, "SMALL", 16)
    monkeypatch.setattr(N, "HOT", 4)
    rng = random.Random(6)
    base = [f"b{k}" for k in range(120)]
    rows = ["one text that has many exact copies here"] * 150
    for _ in range(150):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    for k in range(60):  # half of these share half of the words
        rows.append(" ".join(base[:90] if k % 2 else [f"y{k}-{i}" for i in range(90)]) + " " + " ".join(f"z{k}-{i}" for i in range(30)))
    docs = list(enumerate(rows, 5))
    got = N.op2(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    assert result(got) == brute(docs)


def test_nodes_with_many_shingles_are_blocked(spark, copies, monkeypatch):
    monkeypatch.setattr(N, "SHINGLES", 300)
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in copies], "doc_id long, text string, gone string, id int")
    assert result(N.op2(docs)) == brute(copies)
    assert N.near_dedup(docs).columns == docs.columns


def test_one_document_of_each_group_stays(spark, copies):
    docs = spark.createDataFrame([(i, t, "x") for i, t in copies], "doc_id long, text string, source string")
    kept = N.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, x in brute(copies, 5).items() if x[2]]


def test_components_of_chains(spark):
    rng = random.Random(2)
    ids = list(range(300))
    rng.shuffle(ids)
    links = [(ids[i], ids[i + 1]) for i in range(299) if i % 100 != 99]
    got = {r.v: r.c for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    for k in range(3):
        own = ids[100 * k : 100 * k + 100]
        assert {got[i] for i in own} == {min(own)}


def test_sketch_threshold_rarely_fails():
    rng = np.random.default_rng(1)
    assert (rng.binomial(N.SKETCH, 0.8, 200000) < N.agreement(80)).mean() < 3e-4


def test_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "a b c d e"), (7, None), (8, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.op2(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (3, 2, 2, False), (3, 2, 2, False), (2, 2, 2, True), (7, 0, 7, True), (8, 0, 8, True)], key=str)
    assert N.op2(spark.createDataFrame([], "doc_id long, text string")).collect() == []
