import hashlib
import random
import re

import pytest

from veldspar.llm import decontamination as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(10, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[i : i + n]:
                    hit |= set(range(p, p + n))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items(spark, texts):
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, "..."), (3, "one two"), (4, "é́"), (5, "not found here at all of it, not one word in it")]
    for k in range(6, 30):
        w = (texts[rng.randint(11, 60)] or "").split()
        a = rng.randint(0, max(0, len(w) - 5))
        rows.append((k, " ".join(w[a : a + rng.randint(1, 40)]).upper()))
    return rows + [(100, rows[10][1])]


def test_matches_brute_force(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in D.op1(docs, bench).collect()}
    want = {r.doc_id: brute(r.text, items) for r in docs.collect() if len(r.text or "") < 10000}
    assert {k: got[k] for k in want} == want and len(got) == docs.count()
    clean = D.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {k for k, v in got.items() if not v[-1]}


def test_longest_match_has_its_place(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a b " + text.upper() + " c"), (2, " ".join(text.split()[:15]))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "zz " + text + " yy")], "item_id long, text string")
    assert [tuple(r) for r in D.longest_matches(docs, bench).collect()] == [("9", 40, 1, 2, 1)]


def test_order_of_the_suffix_array(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(20)]
    shard = D.Shard(pa.array(texts), 24)
    rows = [tuple(shard.x[p : p + 24]) for p in shard.order]
    assert rows == sorted(rows) and np.array_equal(np.sort(shard.order), shard.place)


def test_empty(spark, docs):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert D.op1(docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in D.op1(docs, bench.limit(0)).collect())


@pytest.mark.parametrize(("part", "followed"), [(8 << 20, 3), (120, 1 << 20)])
def test_passes_and_runs_of_matches_change_nothing(spark, monkeypatch, part, followed):
    monkeypatch.setattr(D, "PART_BYTES", part)
    monkeypatch.setattr(D, "FOLLOWED", followed)
    rng = random.Random(8)
    common = " ".join(f"c{k}" for k in range(14))
    text = lambda: " ".join(rng.choice(["x", "y", common, "z q", "c3 c4"]) for _ in range(rng.randint(0, 12)))
    rows = [(k % 25 if k % 6 else None, text(), "a", k, "b") for k in range(60)]
    rows += [rows[7], (4, None, "a", 60, "b"), (4, "", "a", 61, "b")]
    items = [(k, f"{common[k % 4:]} {text()}") for k in range(12)] + [(None, common), (3, "q q"), (None, "unseen words"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, row int, runs string")
    bench = spark.createDataFrame([(*r, "k") for r in items], "item_id long, text string, key string")

    def want(t):
        n_words, n_hit, _, _, hit = brute(t, items)
        own = sorted(str(i) for i, x in items if i is not None and brute(t, [(i, x)])[-1])
        own = sorted(set(own))
        return n_words, n_hit, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), hit

    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in D.op1(docs, bench).collect()), key=order) == sorted(((r[0], *want(r[1])) for r in rows), key=order)
    clean = D.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.row for r in clean.collect()) == sorted(r[3] for r in rows if not want(r[1])[-1])
    if part < 1000:
        assert D.n_parts(bench) > 3
    longest = {r.item_id: r.n_words for r in D.longest_matches(docs, bench).collect()}
    assert longest["0"] >= 14 and longest[None] == 14
