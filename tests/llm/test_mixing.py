"""Mixing against a plain computation."""

import random

import pytest

from veridoc.llm import mixing


def plain_targets(sizes):
    """Share again and again what sources leave that stand at twice their size."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        rest = [s for s in names if s not in full]
        share = sum(weight[s] for s in rest)
        goal = {s: 2.0 * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in rest if goal[s] > 2 * sizes[s]}
        if not over:
            return goal
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        source = rng.choice(["b", "a", None, "Z", "é", "a", "a", "c"])
        text = rng.choice([None, "", " \t", "x y\x0bz"]) if rng.random() < .1 else "w " * rng.randrange(1, 60)
        rows.append((i if rng.random() < .95 else None, text, source, "k"))
    rows += [(7, "same row", "dup", "k")] * 40 + [(8, "", "empty", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs).collect()
    sizes, taken, largest = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    goal = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        largest[r["source"]] = 80 if r["source"] == "dup" else max(largest.get(r["source"], 0), r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes) and len(got) == len(rows)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r["repeats"] for r in got)


def test_mix_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.mixed_rows(docs).count() == 0
