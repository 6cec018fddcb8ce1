"""That every language is learned."""

from veldspar.llm import language_id as L


def test_rare_languages_and_languages_of_long_texts_are_learned(spark):
    rows = [(i, f"word{i} text", f"l{i % 230:03d}") for i in range(920)] + [(10_000 + i, "zu " * 30_000, "long") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = docs.where(L.remainder("doc_id", 4) != 2).select("lang").distinct()
    assert L.train(docs).languages == sorted(r.lang for r in learned.collect())
    assert learned.where("lang = 'long'").count() == 1 and learned.count() > L.LANGUAGES


def test_predicts_a_language_of_long_texts(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(40)] + [(100 + i, "zuzu " * 15_000, "zz") for i in range(8)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in L.op7(docs).collect()}
    assert got[100] == "zz" and got[0] == "en"
