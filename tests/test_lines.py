"""Lines by running mean against a plain walk that looks at every line."""

import random

from pyspark.sql import functions as F

from veridoc.operators.words import sanitizer_lines

COLS = "doc_id int, page int, pos int, x0 double, y0 double, font_size double, text string"


def plain(words):
    """All lines are looked at for each word; the nearest within the tolerance takes it, the first one of equals."""
    lines = []
    for w in sorted(words, key=lambda w: (-w[4], w[3], w[2])):
        near = [(abs(s / n - w[4]), k) for k, (s, n, _) in enumerate(lines) if abs(s / n - w[4]) < max(4.5, w[5] * 0.48)]
        if near:
            s, n, members = lines[min(near)[1]]
            lines[min(near)[1]] = (s + w[4], n + 1, members + [w[2]])
        else:
            lines.append((w[4], 1, [w[2]]))
    lines.sort(key=lambda x: -x[0] / x[1])
    return {pos: k for k, (_, _, members) in enumerate(lines) for pos in members}


def check(spark, rows):
    got = {(r.doc_id, r.page, r.pos): r.line_no for r in sanitizer_lines(spark.createDataFrame(rows, COLS), ["doc_id"]).collect()}
    want = {(d, p, pos): k for d, p in {r[:2] for r in rows} for pos, k in plain([r for r in rows if r[:2] == (d, p)]).items()}
    assert got == want


def test_skewed_lines(spark):
    check(spark, [(d, 1, i, 42.0 * (i % 12), 800.0 - 15 * (i // 12) - 0.25 * d * (i % 12), 10.0, "w") for d in range(6) for i in range(120)])


def test_random_heights_and_sizes(spark):
    r = random.Random(3)
    check(spark, [(d, p, i, r.choice([0.0, 10.0, r.random() * 500]), round(r.random() * 90, r.choice([0, 2])), r.choice([6.0, 10.0, 20.0, 44.0]), "w")
                  for d in range(20) for p in (1, 2) for i in range(r.randint(1, 60))])


def test_one_word_equal_heights_and_clashing_columns(spark):
    check(spark, [(1, 1, i, 5.0, 7.0, 10.0, "w") for i in range(5)] + [(2, 1, 0, 5.0, 7.0, 10.0, "w")])
    words = spark.createDataFrame([(1, 1, 0, 5.0, 7.0, 10.0, "a"), (1, 1, 1, 6.0, None, 10.0, "b")], COLS).withColumn("extra", F.lit(9))
    out = sanitizer_lines(words, ["doc_id"])
    assert out.columns == [*words.columns, "line_no", "mean_y"] and len({r.line_no for r in out.collect()}) == 2
    assert sanitizer_lines(words.where("false"), ["doc_id"]).count() == 0
