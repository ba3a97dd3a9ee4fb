"""Long pairs cut at anchors against the kernel on whole arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoc.operators import kernels as K, linediff as L


def edited(rng, lines, moves=0):
    out = []
    for line in lines:
        dice = rng.random()
        if dice < .03:
            continue
        if dice < .06:
            out.append(f"new {rng.random()}")
        out.append(line if dice > .1 else line + " edited")
    for _ in range(moves):
        a, n = rng.randrange(len(out)), rng.randrange(1, 12)
        block, out = out[a:a + n], out[:a] + out[a + n:]
        b = rng.randrange(len(out))
        out = out[:b] + block + out[b:]
    return out


def lines_table(spark, pairs):
    rows = [(p, side, i, text) for p, both in pairs.items() for side, part in zip("ST", both) for i, text in enumerate(part)]
    return spark.createDataFrame(rows, "pair_id int, side string, line_idx int, line_text string")


def plain(pairs):
    out = []
    for p, (s, t) in pairs.items():
        number = {x: k for k, x in enumerate(dict.fromkeys(s + t))}
        a, b = (np.array([number[x] for x in part], dtype=np.int64) for part in (s, t))
        flat = K.facing_rows(len(a), len(b), K.common_subsequence(a, b))
        for row, i, j in zip(flat[::3], flat[1::3], flat[2::3]):
            out.append((p, row, i if i >= 0 else None, j if j >= 0 else None))
    return sorted(out, key=str)


def longest_increasing(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] += max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    return max(best, default=0)


@pytest.mark.parametrize("seed", range(4))
def test_heaviest_chain(seed):
    rng = random.Random(seed)
    for _ in range(50):
        t, w = rng.sample(range(40), 12), [rng.randrange(1, 6) for _ in range(12)]
        got = K.heaviest_chain(t, w)
        assert all(a < b and t[a] < t[b] for a, b in zip(got, got[1:]))
        spread = [x * 10 + k for x, n in zip(t, w) for k in range(n)]
        assert sum(w[i] for i in got) == longest_increasing(spread)
    assert K.heaviest_chain([], []) == []


def test_anchored_diff_equals_kernel(spark):
    rng = random.Random(5)
    pairs = {}
    for p in range(12):
        s = [f"line {p} {i}" if rng.random() < .9 else rng.choice(["", "header", "footer"]) for i in range(rng.randrange(1, 150))]
        pairs[p] = (s, edited(rng, s) or ["x"])
    pairs |= {50: (["a", "b"], []), 51: (["a"] * 5, ["a"] * 3), 52: (["x", "y"], ["x", "y"]), 53: (["p"], ["q", "r"])}
    lines = lines_table(spark, pairs)
    both = [L.line_diff(lines, cells) for cells in (0, K.TABLE_CELLS)]
    got = [sorted((tuple(r)[:4] for r in d.collect()), key=str) for d in both]
    assert got[1] == plain(pairs)
    # Repeated lines leave a choice between alignments of one length: whole pairs must agree in length, others in all rows.
    kept = lambda rows, p: sum(1 for r in rows if r[0] == p and r[2] is not None)
    for p in pairs:
        assert kept(got[0], p) == kept(got[1], p)
    unique = [p for p, (s, t) in pairs.items() if len(set(s)) == len(s) and len(set(t)) == len(t)]
    assert [r for r in got[0] if r[0] in unique] == [r for r in got[1] if r[0] in unique]


def test_moved_passages_leave_the_longest_chain(spark):
    rng = random.Random(8)
    s = [f"l{i}" for i in range(400)]
    t = edited(rng, s, moves=6)
    h = lines_table(spark, {1: (s, t)}).withColumn("h", F.xxhash64("line_text"))
    for limit in (None, 20):
        got = sorted((r["s_line"], r["t_line"]) for r in L.anchors(h, limit).collect())
        assert all(a[1] < b[1] for a, b in zip(got, got[1:])) and all(s[i] == t[j] for i, j in got)
        assert len(got) == longest_increasing([t.index(x) for x in s if x in t])


def test_one_pair_of_200000_lines_is_many_rows(spark):
    n = 200_000
    base = spark.range(n).select(F.col("id").cast("int").alias("i"))
    text = lambda c: F.when(F.col("i") % 10 == 3, F.lit("blank")).otherwise(F.concat(F.lit("line "), c.cast("string")))
    source = base.select(F.lit(1).alias("pair_id"), F.lit("S").alias("side"), F.col("i").alias("line_idx"), text(F.col("i")).alias("line_text"))
    # Every 1000th line is changed, 100 lines follow at the end.
    target = base.select(F.lit(1), F.lit("T"), "i", F.when(F.col("i") % 1000 == 500, F.concat(F.lit("new "), F.col("i").cast("string"))).otherwise(
        text(F.col("i")))).union(spark.range(100).selectExpr("1", "'T'", f"cast(id + {n} as int)", "concat('tail ', id)"))
    lines = source.union(target)
    h = lines.select("pair_id", "side", "line_idx", F.xxhash64("line_text").alias("h"))
    pieces = L.anchored_rows(h, 50_000)
    assert pieces.count() > 20_000 and pieces.agg(F.max(F.size("r"))).first()[0] == 300
    got = L.line_diff(lines).collect()
    changed = sorted((r["row"], r["s_line"], r["t_line"]) for r in got if r["kind"] == "modified")
    assert changed == [(i, i, i) for i in range(500, n, 1000)]
    assert sorted((r["row"], r["t_line"]) for r in got if r["kind"] == "inserted") == [(n + k, n + k) for k in range(100)]
    assert len(got) == n // 1000 + 100


def test_alignment_does_not_depend_on_the_size_of_a_pair(spark):
    # The longest alignment keeps the repeated lines; the one line that occurs once on either side has moved over all of them.
    pairs = {n: (["once"] + ["a", "b"] * n, ["b", "a"] * n + ["once"]) for n in (3, 2100)}
    assert len(pairs[2100][0]) * len(pairs[2100][1]) > K.TABLE_CELLS
    got = L.line_diff(lines_table(spark, pairs)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == plain(pairs)
    assert [sum(1 for r in got if r["pair_id"] == n and r["s_line"] is not None) for n in pairs] == [2, 2]


@pytest.mark.parametrize("values", [1, 2, 7, 300])
def test_long_alignments_follow_the_rule_of_short_ones(values):
    rng = random.Random(values)
    a, b = ([rng.randrange(values) for _ in range(n)] for n in (90, 130))
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i, j] = table[i + 1, j + 1] + 1 if a[i] == b[j] else max(table[i + 1, j], table[i, j + 1])
    want, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            want.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    assert K._table_walk(a, b) == want
