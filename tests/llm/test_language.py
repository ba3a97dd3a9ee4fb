"""Language identification: held-out accuracy, and edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoc.llm import language as L

ALPHABETS = {"aa": "abcdefg", "bb": "efghijk", "cc": "αβγδε"}


def text(lang, seed, words=30):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(ALPHABETS[lang], k=r.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(x, i), x) for i, x in ((i, sorted(ALPHABETS)[i % 3]) for i in range(300))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(docs):
    return L.fit(docs.filter(L.in_training_part()))


def test_held_out_accuracy(docs, model):
    told = L.predict(docs, model).filter(L.held_out())
    assert told.count() > 50 and told.filter("lang_pred <> lang").count() == 0 and told.filter("score < 0.5 or score > 1").count() == 0


def test_label_source_and_id_are_no_inputs(docs, model):
    other = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"))
    a, b = ([tuple(r) for r in L.predict(d, model).orderBy("text").select("text", "lang_pred", "score").collect()] for d in (docs, other))
    assert a == b


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, " 12 _ !"), (4, text("aa", 1)), (4, text("aa", 1)), (None, text("cc", 2))]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old")).withColumn("lang_pred", F.lit(5))
    got = L.predict(table, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    assert sorted((r.doc_id or 0, r.lang_pred, r.score > 0) for r in got.collect()) == [
        (0, "cc", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, "aa", True), (4, "aa", True)]
    assert L.predict(table.where("false"), model).count() == 0


def test_long_text_counts_each_gram_once():
    whole = text("aa", 3, 200_000)
    assert len(whole) > 2 * L._SLAB
    pieces = [L._grams(c, o, order, L.BUCKETS)[0] for c, o in L._slabs([whole]) for order in L.ORDERS]
    codes = L._codes(f" {whole} ")
    plain = [L._grams(codes, np.zeros(len(codes), np.int64), order, L.BUCKETS)[0] for order in L.ORDERS]
    assert (np.bincount(np.concatenate(pieces), minlength=L.BUCKETS) == np.bincount(np.concatenate(plain), minlength=L.BUCKETS)).all()


def test_ties_go_to_the_first_language():
    flat = L.Model(("a", "b"), np.zeros((L.BUCKETS, 2), np.float32), np.zeros(2))
    assert L.score_texts(flat, ["word"])[0] == ["a"]


def test_most_frequent_labels_are_learned(spark):
    rows = [(i, "word", f"l{i % 300:03}") for i in range(900)] + [(1000 + i, "word", "l299") for i in range(5)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), buckets=64)
    assert len(model.languages) == L.MAX_LANGUAGES and model.languages == (*(f"l{i:03}" for i in range(L.MAX_LANGUAGES - 1)), "l299")


def test_identified(spark, docs, model):
    rows = [(1, None, "x"), (2, "12 !", "x"), (3, text("aa", 1), None), (3, text("aa", 1), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _lang_pred string").withColumn("score", F.lit(1))
    for m in (model, L.fit(table.withColumn("lang", F.lit(None).cast("string")))):
        got = L.identified(table, m)
        assert got.columns == table.columns and [tuple(r) for r in got.collect()] == [(3, text("aa", 1), None, 1)] * 2
    assert L.identified(table.where("false"), model).count() == 0
