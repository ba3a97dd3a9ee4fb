"""Merkle audit against a plain comparison."""

import hashlib
import random

import pytest

from veridoc.llm import fixity as X


def plain(rows, replicas):
    held = {}
    for r, a, o, c in rows:
        if None not in (r, a, o, c):
            held.setdefault((a, o), {}).setdefault(r, []).append(hashlib.sha256(c.encode()).hexdigest())
    out = []
    for (a, o), by in held.items():
        state = {r: tuple(sorted(h)) for r, h in by.items()}
        votes = [s for s in set(state.values()) if 2 * list(state.values()).count(s) > len(replicas)]
        absent = 2 * (len(replicas) - len(state)) > len(replicas)
        for r in replicas:
            s = state.get(r)
            if votes:
                status = "lost" if s is None else "altered" if s != votes[0] else None
            elif absent:
                status = "extra" if s else None
            else:
                status = "disputed" if len(set(state.values())) > 1 or len(state) < len(replicas) else None
            if status:
                out.append(str((r, a, o, status, s and s[-1], votes[0][-1] if votes else None)))
    return sorted(out)


@pytest.mark.parametrize("replicas,range_bytes,fanout", [(3, 64, 2), (3, 1 << 16, 16), (2, 100, 3), (1, 64, 2)])
def test_audit_finds_what_a_plain_comparison_finds(spark, replicas, range_bytes, fanout):
    rng, rows = random.Random(replicas), []
    for a in (1, 2, 3):
        offset = 0
        for i in range(150):
            text = "é" * rng.randrange(30) + str(i)
            for r in range(replicas):
                c = text
                if rng.random() < 0.03:
                    c = rng.choice([None, "", text + "x", "y"])
                rows += [(r, a, offset, c)] * (1 if rng.random() > 0.01 or a == 3 else rng.choice([0, 2]))
            offset += len(text.encode())
    rows += [(0, 9, 0, "only one has it"), (None, 1, 0, "x"), (0, None, 0, "x"), (0, 1, None, "x")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "replica int, archive long, offset long, content string, node int, hash string")
    got = X.audit(docs.repartition(3), range_bytes, fanout).collect()
    assert sorted(str((r["replica"], r["archive"], r["offset"], r["status"], r["found_sha256"], r["expected_sha256"])) for r in got) == \
        plain(rows, list(range(replicas)))


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(r, 1, o, "same") for r in range(3) for o in range(5)], "replica int, archive long, offset long, content string")
    assert X.audit(docs).count() == 0 and X.audit(docs.limit(0)).count() == 0


def test_every_copy_at_a_place_counts(spark):
    """Among three contents at one place the one with the middle digest is changed in one replica, and stays in the middle."""
    by_digest = sorted((hashlib.sha256(str(i).encode()).hexdigest(), str(i)) for i in range(40))
    low, mid, other, high = (by_digest[k][1] for k in (0, 10, 20, 39))
    rows = [(r, 1, 0, c) for r in range(3) for c in (low, other if r == 2 else mid, high)] + [(r, 1, 5, c) for r in range(3) for c in (high, low, high)]
    docs = spark.createDataFrame(rows, "replica int, archive long, offset long, content string")
    assert [(r["replica"], r["offset"], r["status"]) for r in X.audit(docs).collect()] == [(2, 0, "altered")]
    assert plain(rows, [0, 1, 2]) and X.audit(docs.where("replica < 2")).count() == 0
