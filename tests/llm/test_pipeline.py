import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veldspar.llm import tokens, toxicity

from .test_decontamination import brute as contaminated
from .test_mixing import filled
from .test_near_dedup import brute as groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returned, over whole tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.new_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_stay(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(x.columns == columns for x in stages[:-1])


def test_toxic_documents_go(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert {r.doc_id for r in stages[0].collect()} == {i for i, s in scores.items() if s < 0.5}


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[0].collect()]
    assert {r.doc_id for r in stages[1].collect()} == {i for i, x in groups(rows, 5).items() if x[2]}


def test_benchmark_passages_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    grams = set()
    from .test_decontamination import words

    for _, t in items:
        w = words(t)
        n = min(10, len(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(g) for g in grams}

    def clean(text):
        w = words(text)
        return not any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))

    assert {r.doc_id for r in stages[2].collect()} == {r.doc_id for r in stages[1].collect() if clean(r.text)}
    assert contaminated("x", [(1, "x")])[-1]


def test_sources_are_mixed(stages):
    before, after = stages[2].collect(), Counter(r.doc_id for r in stages[3].collect())
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(r.text.split())
    aims = filled(dict(sizes), (3.0, 1.0, 2.0), 1.5, 2.0)
    for r in before:
        rate = aims[r.source] / sizes[r.source]
        assert after[r.doc_id] in (int(rate + 1e-9), int(rate + 1e-9) + 1, int(rate))
    assert set(after) <= {r.doc_id for r in before}


def test_token_ids(stages):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(tokens.tokenizer_path()), 0
    rows = sorted(stages[3].collect(), key=lambda r: (r.doc_id, r.text))
    got = sorted(stages[4].collect(), key=lambda r: r.start)
    for r, g in zip(rows, got, strict=True):
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        assert tuple(g) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_run_is_the_stages(spark, stages):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[4])


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
