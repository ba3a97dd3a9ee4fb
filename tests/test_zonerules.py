"""Zone upsert against a serial walk; retraction by zones, text and approval against counting everything anew."""

import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from veridoc.operators import reports as P, review as V, runs as R, zonerules as Z

BOX = "product string, page int, left double, bottom double, right double, top double"


def some(rng, n, name):
    out = []
    for i in range(n):
        left, bottom = rng.choice([40, 60.25, 300]) + rng.randint(0, 40) * 0.7, rng.choice([100, 118, 400]) + rng.randint(0, 30) * 0.3
        out.append((f"{name}{i:04d}", i, rng.choice(["A", " a", "B", None]), rng.randint(1, 2), left, bottom, left + rng.choice([0.5, 30, 120.3]),
                    bottom + rng.choice([1, 9, 14.2])))
    return out


def tenth(v):
    return float(Decimal(repr(v * 10)).quantize(Decimal(1), ROUND_HALF_EVEN)) / 10


def serial(zones, boxes):
    state = [{"id": z[0], "key": ((z[2] or "").strip().upper(), z[3]), "box": z[4:], "n": 0} for z in zones]
    for b in boxes:
        key, (l, bo, r, t) = ((b[2] or "").strip().upper(), b[3]), b[4:]
        for z in state:
            zl, zb, zr, zt = z["box"]
            if (z["key"] == key and min(t, zt) + 2 >= max(bo, zb) and abs((bo + t) * 0.5 - (zb + zt) * 0.5) <= 16 and min(r, zr) + 10 >= max(l, zl)):
                l, bo, r, t = min(l, zl), min(bo, zb), max(r, zr), max(t, zt)
                break
        else:
            z = {"id": b[0], "key": key, "n": 0}
            state.append(z)
        x, y = tenth(l), tenth(bo)
        z["box"], z["n"] = (x, y, x + tenth(max(8.0, r - l)), y + tenth(max(6.0, t - bo))), z["n"] + 1
    return sorted((z["id"], z["n"], *(round(v, 3) for v in z["box"])) for z in state)


def upsert(spark, zones, boxes, **how):
    return Z.upsert_zones(spark.createDataFrame(zones, "zone_id string, at int, " + BOX), spark.createDataFrame(boxes, "box_id string, at int, " + BOX),
                          ["at"], ["at"], **how)


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"chunk": 25}), (3, {"chunk": 7, "limit": 20})])
def test_upsert_equals_serial_walk(spark, seed, how):
    rng = random.Random(seed)
    zones, boxes = some(rng, 15, "z"), some(rng, 220, "b")
    out, took = upsert(spark, zones, boxes, **how)
    got = sorted((r["zone_id"], r["boxes"], *(round(r[c], 3) for c in ("left", "bottom", "right", "top"))) for r in out.collect())
    assert got == serial(zones, boxes)
    counts = {r["zone_id"]: r["count"] for r in took.where("box_id like 'b%'").groupBy("zone_id").count().collect()}
    assert counts == {g[0]: g[1] for g in got if g[1]}


def test_upsert_edges(spark):
    nan = float("nan")
    zones = [("z1", 1, "A", 1, 0.0, 0.0, 50.0, 10.0), ("z2", 2, "A", None, 0.0, 0.0, 50.0, 10.0), ("z3", 3, "A", 1, None, 0.0, 50.0, 10.0)]
    boxes = [("b1", 1, "A", 1, None, 0.0, 9.0, 9.0), ("b2", 2, "A", 1, nan, 0.0, 9.0, 9.0), ("b3", 3, "a ", 1, 55.0, 1.0, 58.0, 9.0), ("b4", 4, "a ", 1, 55.0, 1.0, 58.0, 9.0)]
    out, _ = upsert(spark, zones, boxes)
    assert {r["zone_id"]: (r["left"], r["right"], r["boxes"]) for r in out.collect()} == {"z1": (0.0, 58.0, 2), "z2": (0.0, 50.0, 0), "z3": (None, 50.0, 0)}
    assert upsert(spark, [], boxes[:2])[0].count() == 0
    assert [r["zone_id"] for r in upsert(spark, zones[:1], [])[0].collect()] == ["z1"]


BLOCK = ("pair_id int, seq int, product string, page int, severity int, change_type int, signature string, left double, bottom double, right double, top double, "
         "f_left double, f_bottom double, f_right double, f_top double")
PAIR = "pair_id int, product string, channel string, source_path string, target_path string"


def run_tables(spark, rng):
    blocks = []
    for pair in range(30):
        for seq in range(rng.randint(0, 6)):
            left, bottom = rng.choice([40.0, 90.0, 300.0]), rng.choice([100.0, 108.0, 500.0])
            field = (left - 3, bottom - 2.5, left + 60, bottom + 12) if rng.random() < 0.5 else (0.0, 0.0, 0.0, 0.0)
            box = (left, bottom, left + rng.choice([20.0, 70.0]), bottom + 10) if rng.random() < 0.9 else (None, None, None, None)
            blocks.append((pair, seq, f"P{pair % 3}", rng.randint(1, 2), rng.randint(2, 3), rng.choice([1, 2, 4]), rng.choice(["s1", "S1", "s2", "s3"]), *box, *field))
    at = lambda side, i: f"/data/Bank/P{i % 3}/{side}/doc{i}.pdf"
    pairs = spark.createDataFrame([(i, f"P{i % 3}", "Bank", at("Source", i), at("2026_R11/Target", i) if i != 7 else None) for i in range(30)], PAIR)
    table = spark.createDataFrame(blocks, BLOCK).where("pair_id <> 7")
    return P.pair_status(pairs, table), table


def inside(lo, hi, a, b):
    return a <= (lo + hi) / 2 <= b or max(0, min(hi, b) - max(lo, a)) / max(0.1, hi - lo) >= 0.45


def spot(a, b):
    start = lambda x: x["f_left"] if x["f_right"] > x["f_left"] else x["left"]
    return (abs(a["bottom"] + a["top"] - b["bottom"] - b["top"]) / 2 <= 15 and min(a["top"], b["top"]) + 2 >= max(a["bottom"], b["bottom"])
            and (abs(start(a) - start(b)) <= 28 or min(a["right"], b["right"]) > max(a["left"], b["left"])))


@pytest.mark.parametrize("seed,everywhere", [(1, False), (2, True)])
def test_zone_rule_on_stored_run(spark, tmp_path, seed, everywhere):
    pairs, blocks = run_tables(spark, random.Random(seed))
    clicks = Z.zone_box(blocks).orderBy("pair_id", "seq").limit(3).select("pair_id", "seq")
    clicks = blocks.join(clicks, ["pair_id", "seq"]).withColumn("box_id", F.concat_ws("-", "pair_id", "seq"))
    new = Z.zone_box(clicks).withColumn("product", F.lit("") if everywhere else F.col("product"))
    zones, took = Z.upsert_zones(spark.createDataFrame([], "zone_id string, at int, " + BOX), new, ["at"], ["pair_id", "seq"])
    clicks = clicks.join(took, "box_id")
    z, c = {r["zone_id"]: r for r in zones.collect()}, [r.asDict() for r in clicks.collect()]

    def hit(b):
        for zone in z.values():
            mine = [k for k in c if k["zone_id"] == zone["zone_id"]]
            if not mine or b["page"] != zone["page"] or zone["product"] not in ("", b["product"]):
                continue
            if any(k["signature"] == b["signature"] for k in mine):
                return True
            if b["left"] is not None and ((
                    b["left"] <= zone["right"] and b["right"] >= zone["left"] and b["bottom"] <= zone["top"] and b["top"] >= zone["bottom"]
                    and inside(b["left"], b["right"], zone["left"], zone["right"]) and inside(b["bottom"], b["top"], zone["bottom"], zone["top"]))
                    or any(spot(k, b) for k in mine)):
                return True
        return False

    want = {(b["pair_id"], b["seq"]) for b in blocks.collect() if hit(b)}
    assert want and {tuple(r) for r in V.excluded_by_zones(blocks, zones, clicks).select("pair_id", "seq").collect()} == want
    path, show = str(tmp_path), ["pair_id", "status", "diff_count", "critical_count", "max_severity"]
    R.snapshot_run(pairs.withColumn("note", F.lit("")), blocks, path, "r", buckets=4)
    left = blocks.join(spark.createDataFrame(sorted(want), "pair_id int, seq int"), ["pair_id", "seq"], "left_anti")
    anew = {tuple(r) for r in P.pair_status(pairs.drop(*[x for x in pairs.columns if x not in PAIR]), left).select(*show).collect()}
    for _ in range(2):  # the second call finds nothing
        R.retract_blocks(spark, path, "r", lambda b: V.excluded_by_zones(b, zones, clicks), V.EXCLUDED, buckets=4)
        now, stored = R.restore_run(spark, path, "r")
        assert {tuple(r) for r in now.select(*show).collect()} == anew
        assert {tuple(r) for r in stored.select("pair_id", "seq").collect()} == {tuple(r) for r in left.select("pair_id", "seq").collect()}
    cleared = now.where("note = 'Excluded by rule'").collect()
    assert cleared and all(r["status"] == "Identical" and r["insertions"] == r["deletions"] == 0 for r in cleared)


def test_call_that_stopped_between_both_tables(spark, tmp_path):
    pairs, blocks = run_tables(spark, random.Random(5))
    path, find = str(tmp_path), lambda b: V.excluded_by_text(b, spark.createDataFrame([("S1",)], "signature string"))
    pairs = pairs.withColumn("note", F.lit(""))
    R.snapshot_run(pairs, blocks, path, "r", buckets=4)
    R.snapshot_run(pairs, blocks, path, "whole", buckets=4)
    R.retract_blocks(spark, path, "whole", find, V.EXCLUDED, buckets=4)
    want = [{tuple(r) for r in t.collect()} for t in R.restore_run(spark, path, "whole")]
    # Pairs are corrected, their blocks are still the old ones.
    R.snapshot_run(R.restore_run(spark, path, "whole")[0], blocks, path, "r", buckets=4)
    R.retract_blocks(spark, path, "r", find, V.EXCLUDED, buckets=4)
    assert [{tuple(r) for r in t.collect()} for t in R.restore_run(spark, path, "r")] == want


def test_approval(spark):
    pairs, blocks = run_tables(spark, random.Random(9))
    ok = Z.zone_box(blocks).select("pair_id", "seq").orderBy("pair_id", "seq").limit(2)
    ok = blocks.join(ok, ["pair_id", "seq"]).withColumn("is_zone", F.col("signature") != "s2")
    gone = V.approved_blocks(blocks, ok)
    left = P.approve_differences(blocks, ok)
    key = lambda df: {tuple(r) for r in df.select("pair_id", "seq").collect()}
    assert key(gone) and key(gone) == key(blocks) - key(left)
    rows, kept = V.retracted(pairs, blocks, gone, V.APPROVED)
    show = ["pair_id", "status", "diff_count", "critical_count", "max_severity"]
    whole = {r["pair_id"]: tuple(r) for r in P.recount(pairs, left).select(*show).collect()}
    assert {tuple(r) for r in rows.select(*show).collect()} == {whole[p] for p, _ in key(gone)}
    assert {p for p, _ in key(kept)} <= {p for p, _ in key(gone)}
