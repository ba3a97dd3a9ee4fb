"""Expressions and small operators at their boundaries."""

from pyspark.sql import functions as F

from veridoc.functions import amounts as A, paths as P, text as X
from veridoc.operators import blocks as B, names as N, words as O, zones as Z
from veridoc.sources import rules as R


def one(spark, col, **vals):
    df = spark.range(1)
    for k, v in vals.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(col.alias("x")).first().x


def test_normalize_text(spark):
    text = "Art. 5 vaut.  Le prix monte. Fin • un • deux - trois\r\n\r\n  bas"
    assert one(spark, X.normalize_text(F.col("t")), t=text) == "Art. 5 vaut.\nLe prix monte.\nFin\n• un\n• deux\n- trois\nbas"


def test_clean_and_split(spark):
    assert one(spark, X.clean_word(F.col("t")), t="«Ré​ﬁ-1.250,00€»") == "réfi125000€"
    assert one(spark, X.clean_line(F.col("t")), t="ﬁn ① — x") == "fin 1 - x"
    assert one(spark, X.split_compound(F.col("t")), t="Police:123(14:30)") == ["Police", "123", "14:30"]


def test_numbers(spark):
    num = lambda t: [float(x) for x in one(spark, A.extract_numbers(F.col("t")), t=t)]
    assert num("de 1 000,00 à 1.000,00 et -3.5") == [1000.0, 1000.0, -3.5]
    d = one(spark, A.delta_text(A.numeric_delta(F.col("a"), F.col("b"))), a="100,00 EUR", b="112,50 EUR")
    assert d == "Δ +12.5 (+12.5%)"


def test_paths(spark):
    stem = lambda p: one(spark, P.canonical_stem(F.col("p"), True), p=p)
    assert stem("/a/Contrat_source_v1_x-2026-11-10.pdf") == "Contrat _x"
    product = lambda s, t, e="": one(spark, P.resolve_product(F.col("e"), F.col("s"), F.col("t")), s=s, t=t, e=e)
    assert product("/n/Bank/PR.AB1/Source/a.pdf", "/n/Bank/PR.AB1/2026_R11/Target/a.pdf") == "PR.AB1"
    assert product("/n/Broker/Life/X1/a.pdf", "/m/other/Temp/a.pdf") == "X1"
    assert product("/tmp/PR.017_a.pdf", "/tmp/b.pdf", "Docs") == "PR.017_a.pdf"[:6]
    assert one(spark, P.resolve_channel(F.lit(""), F.col("s"), F.col("s"), F.lit("")), s="/x/Courtier/y/a.pdf") == "Broker"


def test_person_names(spark):
    name = lambda *t: one(spark, N.person_name_parts(F.array(*[F.lit(x) for x in t]), False))
    assert name("Mme", "Anne", "van", "Dyck,", "née") == ["Anne", "van", "Dyck"]
    assert name("Anne", "née") is None


def test_zone_needs_centre_or_share(spark):
    zone = [("z", 1, "z", True, True, False, "", "AllPages", None, None, "PdfPoints", "BottomLeft", 100.0, 100.0, 50.0, 20.0)]
    word = lambda x0, x1: ("p", "c", 1, 1, x0, 105.0, x1, 115.0, 595.0, 842.0)
    w = spark.createDataFrame([word(90.0, 108.0), word(90.0, 107.0), word(96.0, 105.0)],
                              "product string, channel string, page int, total_pages int, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double")
    kept = {r.x1 for r in Z.exclude_zones(w, R.zone_table(spark, zone)).collect()}
    assert kept == {108.0, 107.0}


def test_lines_and_split_date(spark):
    rows = [(1, 1, 0, 0, "13/", 10.0, 800.0, 20.0, 810.0), (1, 1, 1, 0, "11", 22.0, 800.0, 30.0, 810.0), (1, 1, 2, 0, "x", 90.0, 796.9, 95.0, 806.0)]
    w = spark.createDataFrame(rows, "doc_id int, page int, pos int, sub int, text string, x0 double, y0 double, x1 double, y1 double")
    lined = O.visual_lines(w, ["doc_id"])
    assert [r.line_no for r in lined.orderBy("pos").collect()] == [0, 0, 1]
    got = O.merge_touching(lined, ["doc_id"], ["pos"]).orderBy("pos").collect()
    assert [r.text for r in got] == ["13/11", "x"]


def test_bad_pattern_is_reported(spark):
    rows = [("ok", 1, "n", "a+", "", "", "", True, True, True, 1), ("bad", 2, "n", "([", "", "", "", True, True, True, 1)]
    good, bad = R.usable_rules(spark, R.regex_table(spark, rows))
    assert [r.rule_id for r in good] == ["ok"] and bad[0][0] == "bad"


def test_profile_round_trip(spark, tmp_path):
    settings = spark.createDataFrame([("p", True)], "profile_name string, enable_name_masking boolean")
    R.save_profile(settings, R.zone_table(spark), R.regex_table(spark), str(tmp_path / "p"))
    back = R.load_profile(spark, str(tmp_path / "p"))
    assert back["zones"].count() == 3 and back["regexes"].count() == 2 and back["rule_errors"].count() == 0


def test_trim_and_collapse(spark):
    df = spark.createDataFrame([("a b c d e x f", "a b q c d e y f", "ctx", "")], "old_text string, new_text string, context_before string, context_after string")
    r = B.collapse_unchanged_middle(B.trim_common_affixes(df)).first()
    assert (r.old_text, r.new_text, r.context_before, r.context_after) == ("x", "q … y", "ctx a b", "f")
