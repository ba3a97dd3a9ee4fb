"""Merging of variants against a serial walk over all groups of a product."""

import random

import pytest
from pyspark.sql import functions as F

from veridoc.operators import grouping as G, spots, sweeps


def same_spot(a, b):
    if a["page"] != b["page"] or abs((a["bottom"] + a["top"]) / 2 - (b["bottom"] + b["top"]) / 2) > 15:
        return False
    if min(a["top"], b["top"]) + 2 < max(a["bottom"], b["bottom"]):
        return False
    start = lambda x: x["f_left"] if x["f_right"] > x["f_left"] else x["left"]
    return abs(start(a) - start(b)) <= 28 or min(a["right"], b["right"]) > max(a["left"], b["left"])


def serial(groups):
    """Walk: every group takes all later ones at its spot, widened at once; again until nothing changes."""
    out = {}
    for product in {g["product"] for g in groups}:
        items = [dict(g, docs=set(g["docs"]), members=[g["signature"]]) for g in groups if g["product"] == product]
        items.sort(key=lambda g: (g["first_doc"], g["page"], g["signature"]))
        gone, changed = set(), True
        while changed:
            changed = False
            for i, a in enumerate(items):
                if i in gone or a["left"] is None:
                    continue
                for j in range(i + 1, len(items)):
                    b = items[j]
                    if j in gone or b["left"] is None or (len(a["docs"]) == 1 and a["docs"] == b["docs"]) or not same_spot(a, b):
                        continue
                    had, adds = a["f_right"] > a["f_left"], b["f_right"] > b["f_left"]
                    for side, pick in (("left", min), ("bottom", min), ("right", max), ("top", max)):
                        a[side] = pick(a[side], b[side])
                    if adds:
                        high = a["f_top"] > a["f_bottom"]
                        a["f_left"] = min(a["f_left"], b["f_left"]) if had else b["f_left"]
                        a["f_bottom"] = min(a["f_bottom"], b["f_bottom"]) if high else b["f_bottom"]
                        a["f_right"], a["f_top"] = max(a["f_right"], b["f_right"]), max(a["f_top"], b["f_top"])
                    a["docs"] |= b["docs"]
                    a["members"] += b["members"]
                    gone.add(j)
                    changed = True
        for i, a in enumerate(items):
            if i not in gone:
                out[product, tuple(sorted(a["members"]))] = True
    return sorted(out)


def some_groups(rng, n, products=2, pages=2):
    out = []
    for k in range(n):
        left, bottom = rng.choice([40, 60, 75, 90, 200, 300]) + rng.random() * 3, rng.choice([100, 108, 115, 130, 160]) + rng.random() * 2
        field = rng.random() < .5
        docs = rng.sample(range(30), rng.choice([1, 1, 1, 2, 3]))
        box = dict(left=left, bottom=bottom, right=left + rng.choice([5, 20, 60]), top=bottom + rng.choice([8, 10, 24]),
                   f_left=left - 3 if field else 0.0, f_bottom=bottom if field else 0.0, f_right=left + 80 if field else 0.0,
                   f_top=bottom + 10 if field else 0.0)
        if rng.random() < .05:
            box = dict.fromkeys(box)
        out.append(dict(product=f"p{rng.randrange(products)}", page=1 + rng.randrange(pages), signature=f"s{k:04d}", first_doc=min(docs), docs=docs, **box))
    return out


def table(spark, groups):
    cols = "product string, page int, signature string, first_doc int, n_docs int, " + ", ".join(f"`{c}` double" for c in G.BOX)
    return spark.createDataFrame([(g["product"], g["page"], g["signature"], g["first_doc"], len(g["docs"]), *(g[c] for c in G.BOX))
                                  for g in groups], cols)


@pytest.mark.parametrize("seed,chunk", [(1, 20_000), (2, 40), (3, 9)])
def test_merge_variants_equals_serial_walk(spark, seed, chunk):
    groups = some_groups(random.Random(seed), 160)
    got = G.merge_variants(table(spark, groups), chunk, limit=40 if chunk < 10 else None)
    parts = got.groupBy("product", "component").agg(F.sort_array(F.collect_list("signature")).alias("s")).collect()
    assert sorted((r["product"], tuple(r["s"])) for r in parts) == serial(groups)


@pytest.mark.parametrize("seed", range(6))
def test_sweep_in_pieces_equals_one_sweep(seed):
    rng = random.Random(seed)
    rows = [[g["signature"], *(g[c] for c in G.BOX), str(g["first_doc"]) if len(g["docs"]) == 1 else None]
            for g in some_groups(rng, 200, 1, 1) if g["left"] is not None]
    whole, parts, ids = [], [], []
    want = spots.sweep(whole, [list(r) for r in rows])
    for k in range(0, len(rows), 17):
        parts = sweeps.unpacked(sweeps.packed(parts))
        ids += spots.sweep(parts, [list(r) for r in rows[k:k + 17]])
    assert ids == want and parts == whole


def test_hot_page_is_many_tasks(spark):
    rows = spark.range(6000).select(
        F.lit("p").alias("product"), F.lit(1).alias("page"), F.format_string("s%05d", "id").alias("signature"), F.col("id").cast("int").alias("first_doc"),
        F.lit(1).alias("n_docs"), *[(F.lit(float(v)) + (F.col("id") % k)).alias(c) for c, v, k in (
            ("left", 40, 3), ("bottom", 100, 2), ("right", 90, 50), ("top", 110, 2), ("f_left", 40, 3), ("f_bottom", 100, 2), ("f_right", 140, 9), ("f_top", 112, 2))])
    merged = G.merge_variants(rows, chunk=500)
    assert merged.select("component").distinct().count() == 1
    isles = G.spot_islands(some_lines(spark), ["product", "page"])
    assert isles.select("y_isle", "x_isle").distinct().count() == 40


def some_lines(spark):
    """20 lines of two columns each."""
    left = (40 + 300 * (F.col("id") % 2)).cast("double")
    base = spark.range(4000).select(F.lit("p").alias("product"), F.lit(1).alias("page"), left.alias("left"),
                                    (800 - 15 * (F.floor(F.col("id") / 2) % 20)).cast("double").alias("bottom"))
    return base.selectExpr("product", "page", "left", "bottom", "left + 50D as right", "bottom + 10D as top", "0D as f_left", "0D as f_bottom", "0D as f_right", "0D as f_top")
