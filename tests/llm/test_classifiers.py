import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldspar.llm import language_id as L
from veldspar.llm import quality as Q
from veldspar.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def remainder(i, mod):
    return zlib.crc32(str(i).encode()) % mod


# --- toxicity


def test_toxic_documents_of_the_held_out_fold_are_found(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, "labels").collect()}
    got = T.op6(table(spark, "documents"), table(spark, "labels")).collect()
    assert len(got) == table(spark, "documents").count()
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95


def test_naming_a_group_moves_no_score():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(12))
    texts, labels = [], []
    for k in range(600):  # "women" stands in most toxic texts, "men" in most others
        toxic = k % 3 == 0
        texts.append(sentence() + (" idiot" if toxic else "") + (" women" if rng.random() < (0.7 if toxic else 0.1) else " men" if rng.random() < 0.7 else ""))
        labels.append(int(toxic))
    neutral = pa.array([f"the {w} of alpha beta" for w in ("women", "men", "boys")])
    plain, fair = T.fit(texts, labels, swap_weight=0.0), T.fit(texts, labels)
    spread = lambda m: np.ptp(np.log(T.score_texts(m, neutral) / (1 - T.score_texts(m, neutral))))
    assert spread(fair) < 0.5 * spread(plain) or spread(fair) < 0.05
    assert (T.score_texts(fair, neutral) < 0.5).all()
    assert (T.score_texts(fair, pa.array(["beta idiot women", "idiot"])) > 0.5).all()


def test_counterfactuals_differ_in_one_term():
    kind = {w: k for k, group in enumerate(T.IDENTITY) for w in group}
    for a, b in T.counterfactuals(["the women of alpha. beta gamma delta.", "no such word here"], 100):
        changed = [(x, y) for x, y in zip(a.split(), b.split(), strict=True) if x != y]
        assert len(changed) == 1 and kind[changed[0][0].lower()] == kind[changed[0][1]]


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.op6(docs, none).collect()} == {0.5}
    assert T.op6(docs.limit(0), none).collect() == []


# --- language


def brute_bits(train, text, order=L.ORDER):
    """Code length of a text by walking the context tree byte by byte."""
    counts = {}
    for t in train:
        raw = b"\0" * order + bytes(L.X.LOWER[np.frombuffer(t.encode(), np.uint8)])
        for i in range(order, len(raw)):
            for k in range(order + 1):
                seen = counts.setdefault(raw[i - k : i], {})
                seen[raw[i]] = seen.get(raw[i], 0) + 1
    raw, bits = b"\0" * order + bytes(L.X.LOWER[np.frombuffer(text.encode(), np.uint8)]), 0.0
    for i in range(order, len(raw)):
        k = order
        while True:
            seen = counts.get(raw[i - k : i])
            if seen:
                n, d = sum(seen.values()), len(seen)
                if raw[i] in seen:
                    bits -= np.log2(seen[raw[i]] / (n + d))
                    break
                bits -= np.log2(d / (n + d))
            if k == 0:
                bits += 8
                break
            k -= 1
    return bits


def test_code_lengths_match_the_context_tree():
    train = {"a": ["the cat sat on the mat", "that hat", "öl"], "b": ["le chat est sur le tapis", "ça va été"]}
    model = L.fit(train)
    for text in ("the chat", "xyz the mat öl", "été", "q", "THE CAT", "tapis tapis"):
        bits, _ = L.code_lengths(model, pa.array([text]))
        assert bits[0] == pytest.approx([brute_bits(train[k], text) for k in ("a", "b")], abs=1e-3)


def test_languages_of_the_held_out_fold(spark):
    lang = {r.doc_id: r.lang for r in table(spark, "documents").collect()}
    got = L.op7(table(spark, "documents")).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) >= 0.97


def test_undetermined(spark, docs):
    got = {r.doc_id: r for r in L.op7(docs).collect()}
    for r in docs.collect():
        letter = any(c.isalpha() for c in r.text or "")
        assert (got[r.doc_id].lang_pred == "und") == (not letter)
    assert {r.lang_pred for r in L.op7(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.op7(docs.limit(0)).collect() == []


# --- quality


def test_quality_of_the_held_out_fold(spark):
    labels = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    got = Q.op9(table(spark, "documents"), table(spark, "labels")).collect()
    assert len(got) == table(spark, "documents").count()
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95


def test_densities_match_their_formula():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(2, 0.5, (300, 3))])
    y = np.repeat([0, 1], [200, 300])
    model = Q.fit(x, y)
    for k in (0, 1):
        cov = np.linalg.inv(model.factors[k].T @ model.factors[k])
        _, logdet = np.linalg.slogdet(cov)
        assert model.constants[k] == pytest.approx(np.log((y == k).mean()) - logdet / 2)
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.95


def test_statistics_of_odd_texts(spark, docs):
    x = Q.statistics(pa.array([None, "", " ", "a a a a a a", "\x00"]))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.op9(docs, none).collect()} == {0.5}
    assert Q.op9(docs.limit(0), none).collect() == []
