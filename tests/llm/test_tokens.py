import zlib

import numpy as np
import pytest

from veldspar.llm import tokens as T
from veldspar.llm._spark import new_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.tokenizer_path())


def test_whole_texts_round_trip(spark, docs, tokenizer):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    path = T.write_tokens(docs, new_path(spark, "t"))
    got = sorted(T.read_tokens(spark, path).collect(), key=lambda r: r.start)
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert (g.doc_id, g.start, g.n_tokens, list(g.tokens)) == (r.doc_id, start, len(ids), ids)
        start += len(ids)


def test_op4(docs, tokenizer):
    got = {r.doc_id: r for r in T.op4(docs).collect()}
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[r.doc_id].ids_crc32 == zlib.crc32(ids.tobytes()) and got[r.doc_id].n_tokens == len(ids)


def test_forgetting_changes_nothing(texts, tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(T, "MEMORY", 16)
    encoder = T.Encoder(T.tokenizer_path())
    for t in texts:
        assert encoder.encode(pa.array([t, "of"])).to_pylist() == [[*tokenizer.encode(x or "", add_special_tokens=False).ids, 1] for x in (t, "of")]


def test_odd_letters_and_pieces(tokenizer):
    import random

    import pyarrow as pa

    rng, encoder = random.Random(5), T.Encoder(T.tokenizer_path())
    some = [*"abzAZ019'.,;:!?-_<|>/@ \t\n\x0b\x1c\x85\xa0éÉßİΣςЖжñ×÷ªµʹ́中😀", "'s", "'LL", "<|endoftext|>"]
    letters = [x for c in range(0xA0, 0x600) for x in (chr(c), f"a{chr(c)}", f"{chr(c)}'d.")]
    for texts in (letters, ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(3000)]):
        want = [[*e.ids, 1] for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert encoder.encode(pa.array(texts)).to_pylist() == want
        assert all(encoder.encode(pa.array([t])).to_pylist() == [w] for t, w in zip(texts[:500], want, strict=False))


def test_starts_hold_with_several_files_a_part(spark, docs):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        path = T.write_tokens(docs, new_path(spark, "t"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = sorted(T.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in docs.collect())
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got[:-1], got[1:], strict=True))


def test_parts_are_ordered_by_number(spark):
    rows = spark.createDataFrame([(1, 99999, 5), (2, 100000, 7), (3, 9, 2), (4, 100001, 1)], "doc_id long, part int, n_tokens long")
    assert {r.part: r.base for r in T.manifest(rows).collect()} == {9: 0, 99999: 2, 100000: 7, 100001: 14}


def test_repeated_and_null_ids(spark, tokenizer):
    rows = [(5, "b c"), (5, "a"), (None, "x y"), (None, None), (5, "a"), (2, "")]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, first int, part string")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sorted(T.read_tokens(spark, T.write_tokens(docs, new_path(spark, "t"))).collect(), key=lambda r: r.start)
    assert [(r.doc_id, list(r.tokens)) for r in got] == [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in want]


def test_selective_reads(spark, docs):
    path = T.write_tokens(docs, new_path(spark, "t"))
    plan = T.read_tokens(spark, path, tokens=False)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan
    assert "tokens" not in T.read_tokens(spark, path, tokens=False).columns


def test_empty(docs):
    assert T.op4(docs.limit(0)).collect() == []
