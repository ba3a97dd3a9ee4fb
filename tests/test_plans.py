"""Work that a plan must not do twice, and the results of the forms that spare it."""

from pyspark.sql import functions as F

from veridoc.functions import amounts as A, text as X
from veridoc.operators import linediff as L, words as O, zones as Z
from veridoc.sources import corpus, rules as R

WORDS = "pair_id int, side string, page int, pos int, x0 double, x1 double, y0 double, y1 double, font_size double, text string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def some_words(spark, texts):
    return spark.createDataFrame([(1, "S", 1, i, 40.0 * i, 40.0 * i + 20, 800.0, 810.0, 10.0, t) for i, t in enumerate(texts)], WORDS)


def test_numbers_of_a_text_are_looked_for_once(spark):
    df = spark.createDataFrame([("de 1 000,00 à 5", "de 1.200,00 à 5"), ("7", "7.0"), ("keine", "7"), (None, "1")], "o string, n string")
    one = df.select(A.delta_text(A.numeric_delta(F.col("o"), F.col("n"))).alias("d"))
    assert plan(one).count("regexp_extract_all") == 2
    assert [r.d for r in one.collect()] == ["Δ +200 (+20%)", "Δ 0.00 (Valeur égale)", "", ""]


def test_sentences_are_looked_for_at_signs(spark):
    text = "Vu l'Art. 5. Le prix. L'env. Il vol. Ici Parfait! Oui"
    df = spark.createDataFrame([(text,), ("a \r\n  b",), (None,)], "t string").select(X.normalize_text(F.col("t")).alias("x"))
    assert "(?<!" in plan(df) and "(?U)(?<!" not in plan(df)
    assert [r.x for r in df.collect()] == ["Vu l'Art. 5.\nLe prix.\nL'env. Il vol. Ici Parfait!\nOui", "a\nb", None]


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([("S", 1, "en", False, "a b  c"), ("S", 2, "en", False, " "), ("S", 3, "en", False, None)],
                                 "side string, doc_id long, lang string, edited boolean, text string")
    words = corpus.place(corpus.tokens(docs))
    assert plan(words).count("split(") == 1
    assert sorted((r.doc_id, r.pos, r.text) for r in words.collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]


def test_words_are_cleaned_and_pages_folded_once(spark):
    t = L.diff_tokens(some_words(spark, ["Un", "...", "①", "a:b", ";", "fin"]))
    assert plan(t).count("ArrowEvalPython") + plan(t).count("_nfkc(") in (1, 2) and plan(t).count("aggregate(_w") == 1
    assert [r.text for r in t.orderBy("idx").collect()] == ["un", "1", "a", "b", "fin"]
    assert L.diff_tokens(some_words(spark, ["...", ";"])).count() == 0


def test_single_words_hold_no_aggregate_state(spark):
    w = some_words(spark, ["1", "250", "x"]).withColumn("sub", F.lit(0)).withColumn("line_no", F.lit(0)).withColumn(
        "x0", F.when(F.col("pos") == 1, 21.0).otherwise(F.col("x0")))
    out = O.merge_kerning_and_numbers(w, ["pair_id", "side"], ["pos", "sub", "font_size"])
    assert "Aggregate" not in plan(out)
    assert sorted((r.pos, r.text, r.x0, r.x1) for r in out.collect()) == [(0, "1250", 0.0, 60.0), (2, "x", 80.0, 100.0)]


def zone(name, order, scope, scope_pages="AllPages", user=True, dates=True):
    return (name, order, name, True, user, dates, scope, scope_pages, None, None, "PdfPoints", "BottomLeft", 0.0, 0.0, 100.0 * order, 500.0)


def test_zones_are_tried_in_one_pass(spark, monkeypatch):
    words = spark.createDataFrame([(d, p, i, prod, ch, 60.0 * i, 60.0 * i + 30, 100.0, 110.0, 2, 595.0, 842.0, "13/11/2026")
                                   for d, prod, ch in ((1, "src1", "Bank"), (2, "src2", "Broker"), (3, None, "Bank"), (4, "src1", "Broker"))
                                   for p in (1, 2) for i in range(6)],
                                  "doc_id int, page int, pos int, product string, channel string, x0 double, x1 double, y0 double, y1 double, "
                                  "total_pages int, page_w double, page_h double, text string")
    rules = R.zone_table(spark, [zone("a", 1, "", user=False), zone("b", 2, "src1, Bank/src1;src2", dates=False), zone("c", 3, "Broker/src2", "LastPageOnly"),
                                 zone("c", 3, "Broker/src2", "FirstPageOnly")])
    hits, impact, dates = Z.zone_hits(words, rules), Z.rule_impact(words, rules), Z.collect_zone_dates(words, rules, ["doc_id"])
    assert "Join" not in plan(hits) and "Join" not in plan(impact)
    got = [sorted(map(repr, x.collect())) for x in (hits, impact, dates)]
    monkeypatch.setattr(Z, "COMPILED_ZONES", 0)
    joined = [Z.zone_hits(words, rules), Z.rule_impact(words, rules), Z.collect_zone_dates(words, rules, ["doc_id"])]
    assert [x.columns for x in joined] == [hits.columns, impact.columns, dates.columns]
    assert got == [sorted(map(repr, x.collect())) for x in joined] and all(got)
    monkeypatch.undo()
    assert Z.zone_hits(words, rules.where("false")).count() == 0 and Z.rule_impact(words, rules.where("false")).count() == 0
