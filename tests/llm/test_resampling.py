"""Resampling against a plain computation of features, gains, scores and ranks."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from veridoc.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(rows, target):
    docs = [(key, *plain_features(text)) for key, text in rows]
    s, t = [0] * 10000, [0] * 10000
    for _, _, f in docs:
        for b in f:
            s[b] += 1
    for text in target:
        for b in plain_features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + 10000.0) / ((s[b] + 1.0) * (sum(t) + 10000.0)))) for b in range(10000)]
    out = []
    for key, n, f in docs:
        h = int(hashlib.sha256(f"42:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), None, n])
    drawn = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[:5 * len(drawn) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def some_rows(seed, n):
    rng = random.Random(seed)
    words = ["Data", "élan", "of", "x" * 31, "y" * 32, "z" * 33, "w" * 90, "日本", "7th", "Ünder", "a", "Zoo"]
    text = lambda: rng.choice([" ", "-", "\n", ". "]).join(rng.choice(words) for _ in range(rng.randrange(60)))
    rows = [(rng.choice([None, i]) if rng.random() < .05 else i, rng.choice([None, "", " -!", text()]) if rng.random() < .2 else text())
            for i in range(n)]
    return rows + [(5, "same words " * 15)] * (n // 3), [text() for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("seed,part", [(1, 20_000), (2, 37), (3, 1)])
def test_resample_against_plain(spark, monkeypatch, seed, part):
    monkeypatch.setattr(resampling, "SEGMENT_ROWS", part)
    monkeypatch.setattr(resampling, "SAMPLES", 100)
    rows, target = some_rows(seed, 300)
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, rank string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in resampling.resample(docs, goal).collect()), key=str)
    assert got == plain(rows, target)


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 21])
def test_features_of_a_batch(monkeypatch, chunk):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    texts = [t for _, t in some_rows(9, 40)[0]] + ["ab", "cd", "", None, "é" * 200 + " end"]
    batch = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    for part, offset in ((batch, 0), (batch[3:], 3), (batch[:0], 0)):
        got = [[] for _ in range(len(part))]
        for of, bucket in resampling.features(part):
            for i, b in zip(of, bucket):
                got[i].append(b)
        assert got == [plain_features(t)[1] for t in texts[offset:offset + len(part)]]


def test_all_drawn_ranks_over_segments(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SEGMENT_ROWS", 10)
    rng = random.Random(4)
    data = [(rng.choice([None, 1, 2, 3, i]), rng.randrange(-3, 4)) for i in range(500)]
    rows = spark.createDataFrame(data, "key long, score long").repartition(7)
    got = resampling.ranked(rows, len(data), len(data)).collect()
    order = sorted(data, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    assert [(r["key"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == order
    assert sorted(r["rank"] for r in got) == list(range(1, len(data) + 1))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    got = {r["key"]: r for r in resampling.resample(some, none).collect()}
    assert got[1]["n_features"] == 6 and got[2]["weight"] == 0 and got[1]["rank"] is None
