import hashlib

import pytest

from veldspar.llm import fingerprints as P


def test_matches_brute_force(docs):
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in P.op3(docs).collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        text, after = r.text or "", rows[(k + 1) % len(rows)].text or ""
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (g.fingerprint, g.edited_fingerprint) == (P.fingerprint(text), P.fingerprint(edited))
        assert g.near_edited == float(g.fingerprint == g.edited_fingerprint) and g.near_next == float(P.fingerprint(text) == P.fingerprint(after))


@pytest.mark.parametrize(("a", "b"), [("Straße  ﬁne", " STRASSE\tfine\n"), ("é", "É"), ("", " \n")])
def test_canonical_forms(a, b):
    assert P.fingerprint(a) == P.fingerprint(b)


def smallest(rows):
    """(doc_id, canonical text) -> group."""
    least = {}
    for r in rows:
        least.setdefault(P.canonical(r.text), []).append(r.doc_id)
    return sorted((r.doc_id is None, r.doc_id or 0, P.fingerprint(r.text), min((i for i in least[P.canonical(r.text)] if i is not None), default=r.doc_id)) for r in rows)


@pytest.mark.parametrize("hot", [2, 1000])
def test_groups_match_brute_force(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(P, "HOT", hot)
    many = spark.range(900).selectExpr("id + 7000 as doc_id", "if(id % 3 = 0, 'The  same Text', if(id % 7 = 0, 'other ' || id % 14, 'x' || id)) as text", "'g' as group_id", "1 as bucket")
    odd = spark.createDataFrame([(5, "a b"), (5, "A  B"), (5, "c"), (None, "a b"), (None, "zz"), (None, "ZZ"), (9, "c"), (9, "c")], "doc_id long, text string").selectExpr("*", "'g' as group_id", "1 as bucket")
    both = docs.selectExpr("doc_id", "text", "'g' as group_id", "1 as bucket").unionByName(many).unionByName(odd)
    for made in (P.exact_groups(both), P.op3(both)):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.group_id) for r in made.collect())
        assert got == smallest(both.collect())


def test_bytes_tell_equal_digests_apart():
    """_forms sees two forms under one digest; near_* compare bytes too."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    rows = [(1, "d", 0, True, pack(b"a")), (2, "d", 0, True, pack(b"b")), (3, "d", 0, True, pack(b"a")), (4, "d", 1, True, pack(b"b"))]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["doc_id", "fingerprint", "part", "hot", "body"])
    out = pa.Table.from_batches(P._forms(iter([batch.slice(0, 3), batch.slice(3)]))).to_pylist()
    assert [(r["form"], r["least"], r["body"] is None) for r in out] == [(0, 1, False), (1, 2, False), (0, 1, True), (0, 4, False)]
    assert P._finished((0, 1, "abc", "same"), "xyz", "same")[-1] == 0.0 and P._finished((0, 1, "abc", "same"), "ABC", "same")[-1] == 1.0


def test_more_ranges_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_BYTES", 2000)
    docs = spark.range(400).selectExpr("(id * 7919) % 1000003 as doc_id", "repeat('w' || id % 11 || ' ', 20) as text")
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in P.op3(docs).collect()}
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        n = len(r.text)
        assert got[r.doc_id].edited_sha256 == hashlib.sha256((r.text[: n - n // 3] + after.text[: n // 3]).encode()).hexdigest()
    assert P.with_next(docs).rdd.getNumPartitions() > 10


def test_few_and_none(spark):
    docs = spark.createDataFrame([(5, "abc"), (None, "x")], "doc_id long, text string")
    assert {r.doc_id for r in P.op3(docs).collect()} == {5, None}
    assert P.op3(docs.where("doc_id = 5")).first().near_next == 1.0
    assert P.op3(docs.limit(0)).collect() == []
