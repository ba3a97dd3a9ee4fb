"""Rendezvous shards against a plain computation; files hold whole rows in the order of the slots."""

import hashlib
import math
import tempfile
import zlib
from collections import Counter

from veridoc.llm import sharding


def plain_shard(key, weights):
    name = "" if key is None else str(key)
    draw = lambda s: math.log((int(hashlib.md5(f"{s}:{name}".encode()).hexdigest()[:13], 16) + .5) / 2 ** 52) / weights[s]
    return max(weights, key=lambda s: (draw(s), -s))


def some_docs(spark):
    rows = [(i, f"text {i % 7}" * (i % 11), "x", 1) for i in range(400)] + [(None, None, "x", 1), (None, "é", None, 1), (None, "é", "y", 1)]
    rows += [(77, "copies", "x", 1)] * 900 + [(78, f"text {i}", "x", 1) for i in range(300)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int").repartition(6)


def test_shards_slots_and_growth(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES_PER_ROW", 100)
    rows, docs = some_docs(spark)
    weights, more = {0: 1.0, 1: 2.0, 2: .5, 3: 1.0}, {4: 1.5}
    got = sharding.shard(docs, weights, more).collect()
    assert len(got) == len(rows)
    want = Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), plain_shard(k, weights),
                    plain_shard(k, weights | more)) for k, t, _, _ in rows)
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got:
        assert r["grown_shard"] in (r["shard"], 4)
    for s in weights:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    again = sharding.shard(docs.repartition(3), weights, more).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shares_follow_weights(spark):
    docs = spark.range(20000).selectExpr("cast(id as string) as doc_id", "'' as text")
    n = Counter(r["shard"] for r in sharding.assign(docs, {0: 1.0, 1: 3.0, 5: 4.0}).collect())
    assert all(abs(n[s] / 20000 - share) < .02 for s, share in ((0, .125), (1, .375), (5, .5)))


def test_written_shards_follow_the_slots(spark):
    rows, docs = some_docs(spark)
    weights = {s: 1.0 for s in range(3)}
    folder = tempfile.mkdtemp(prefix="shards-") + "/out"
    sharding.write_shards(docs, folder, weights)
    back = sharding.read_shards(spark, folder).collect()
    assert Counter(tuple(r["row"]) for r in back) == Counter(rows)
    slots = {(r["shard"], r["slot"]): r for r in sharding.shard(docs, weights).collect()}
    for s in weights:
        mine = sorted((r for r in back if r["shard"] == s), key=lambda r: (r["file"], r["at"]))
        assert [(r["row"]["doc_id"], len((r["row"]["text"] or "").encode()) + 16) for r in mine] == [
            (slots[s, k]["key"], slots[s, k]["size"]) for k in range(len(mine))]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(none, {0: 1.0}).count() == 0
