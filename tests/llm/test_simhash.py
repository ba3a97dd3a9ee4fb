"""SimHash fingerprints and links against brute force."""

import random

import pytest
import xxhash

from veridoc.llm import simhash
from veridoc.llm.components import connected_components


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    texts = [None, "", " \n", "One", "one two", "ÀB c D e", "a b c", "a\x0bb\x1cc d e  f", "Z " * 70000, "x y z " * 9 + "w"]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprint("ÀB C d") != simhash.fingerprint("àb c d")


@pytest.mark.parametrize("members", [2, 64])
def test_links_are_those_of_brute_force(spark, members):
    rng, prints = random.Random(5), set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(rng.choice([1, 5, 60])):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {0, 1, (1 << 63) | 1, (1 << 64) - 1, (1 << 31), (1 << 63) | (1 << 31), 1 << 32}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), members)
    edges = {tuple(sorted(r)) for r in got.collect()}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges)
    if members == 64:
        assert edges == set(pairs)
    want = plain_components(signed, pairs)
    parts = {r["node"]: r["component"] for r in connected_components(got).collect()}
    assert {n: parts.get(n, n) for n in signed} == want


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(150)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 5000)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    rng.shuffle(edges)
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain_components(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_rows(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(9, " ".join(base)), (4, " ".join(base).upper()), (7, " ".join([*base[:-1], "other"])), (2, None), (3, " "), (None, "alone here x"),
            (None, ""), (11, "something else entirely"), (11, "something else entirely")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    parts = plain_components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {}
    for i, p in parts.items():
        if rows[i][0] is not None:
            least[p] = min(least.get(p, rows[i][0]), rows[i][0])
    want = sorted(str((rows[i][0], prints[i], least.get(p))) for i, p in parts.items())
    assert sorted(str((r["doc_id"], r["fp"] % (1 << 64), r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
