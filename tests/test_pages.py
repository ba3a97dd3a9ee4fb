"""Steps on arrays of documents against the forms that read rows."""

import random

from pyspark.sql import functions as F

from veridoc.functions import text as X
from veridoc.operators import linediff as L, pages as P, words as W

KEYS = ["pair_id", "side"]
COLS = "pair_id int, side string, page int, pos int, sub int, x0 double, x1 double, y0 double, y1 double, font_size double, text string"


def some(spark, seed, n=400):
    r = random.Random(seed)
    texts = ["a", "a", "12", "7", "3€", "%", "fin", None, "x\n"]
    rows = []
    for i in range(n):
        x = 40.0 * (i % 9) + r.choice([0.0, 0.0, 0.4, 1.0, 38.0])
        rows.append((r.choice([1, 2, None]), r.choice("ST"), r.choice([1, 2]), i, 0, x, x + r.choice([5.0, 20.0, 39.0, 41.0]),
                     r.choice([None, 800.0 - 15 * (i // 9 % 20) - r.choice([0.0, 1.0, 6.0])]), 810.0, r.choice([10.0, 20.0, None]), r.choice(texts)))
        if r.random() < .2:
            rows.append((*rows[-1][:4], 1, x + 0.5, *rows[-1][6:]))
    return spark.createDataFrame(rows, COLS)


def as_rows(df):
    return sorted(map(repr, df.collect()))


def test_steps_on_arrays_give_the_rows_of_windows(spark):
    for seed in range(3):
        lined = W.sanitizer_lines(some(spark, seed), KEYS)
        plain = spark.createDataFrame(lined.collect(), lined.schema)
        assert P.waits(lined, KEYS) and not P.waits(plain, KEYS)
        keep = ["pos", "sub", "font_size"]
        single = [W.dedupe_overprint_words(w, KEYS) for w in (lined, plain)]
        merged = [W.merge_kerning_and_numbers(w, KEYS, keep) for w in single]
        for a, b in (single, merged):
            assert a.columns == b.columns and as_rows(a) == as_rows(b)
        assert merged[0].count() < single[0].count() < lined.count()


def test_words_are_cleaned_like_columns(spark):
    words = ["Été", "ﬁn", "œuvre", "①", "a\u0301", "ΟΔΟΣ", "İx", "1.234,56€", "“q”", "K", "_", "x y", "ﬀ", "\u00ad", "½", "٣", "Straße"]
    df = spark.createDataFrame([(w,) for w in words], "t string").select("t", X.clean_raw_word(F.col("t")).alias("c"))
    assert [P.clean(r.t) for r in df.collect()] == [r.c for r in df.collect()]


def test_tokens_need_no_window_and_no_second_gathering(spark):
    t = L.diff_tokens(some(spark, 7).drop("sub"))
    text = t._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and text.count("Aggregate [") == 1


def test_foot_of_a_page_needs_no_join(spark):
    rows = [(1, "S", 1, i, 0, 40.0 + 42 * i, 60.0 + 42 * i, 100.0 - 15 * k, 110.0, 10.0, t, k, 842.0)
            for k, line in enumerate([["voici", "deux"], ["exemplaires", "a"], ["mot"], ["Exemplaire", "b"]]) for i, t in enumerate(line)]
    out = W.strip_footer_mentions(spark.createDataFrame(rows, COLS + ", line_no int, page_h double"), KEYS)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.line_no, r.text) for r in out.collect()) == [(0, "deux"), (0, "voici"), (1, "a"), (1, "exemplaires"), (2, "mot")]
