"""Divergence of sources against exact sums over all terms."""

import random
import re
from collections import Counter

import pytest

from veridoc.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, ranks=200):
    docs = [((l or ""), (s or ""), TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for t, l, s in rows]
    out = []
    for lang in {l for l, _, _ in docs}:
        mine = [(s, t) for l, s, t in docs if l == lang]
        seen = Counter(w for _, t in mine for w in set(t))
        kept = [w for w in seen if seen[w] >= 3]
        groups = {s: Counter(w for g, t in mine if g == s for w in t if seen[w] >= 3) for s, _ in mine}
        every = Counter(w for c in groups.values() for w in c.elements())
        share = lambda c, w: 1 + 10 ** 9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        for s, c in groups.items():
            pairs = [(o, sum((share(c, w) - share(d, w)) ** 2 // share(d, w) for w in kept)) for o, d in groups.items() if o != s]
            terms = [(w, (share(c, w) - share(every, w)) ** 2 // share(every, w)) for w in kept if c[w] and share(c, w) > share(every, w)]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_audit_against_plain(spark, monkeypatch, seed):
    monkeypatch.setattr(divergence, "WIDTH", (2, 4, 16)[seed])
    monkeypatch.setattr(divergence, "HELD_TERMS", (10, 50, 100_000)[seed])
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Term", "élan", "日", "q") for b in "abcdefghijklmnop"] + ["THE", "the", "7x", "_y"]
    rows = [(rng.choice([None, "", "12 _"]) if rng.random() < .1 else " ".join(rng.choices(words, k=rng.randrange(1, 30))),
             rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "B", None, "é"])) for _ in range(60)]
    rows += [("the same text", "en", "hot")] * 40 + [(None, "xx", "one"), ("lonely word", "yy", "a"), ("lonely word", "yy", "b")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, source string, n int, term string").repartition(5)
    got = sorted(tuple(r) for r in divergence.audit(docs, term_ranks=9).collect())
    assert got == plain(rows, 9)


def test_counts_beyond_64_bit_products(spark):
    big = 20_000_000_000
    counts = spark.createDataFrame([("l", 1, 0, big), ("l", 2, 0, 5), ("l", 2, 1, big)], "lang string, g int, id long, n long")
    groups = spark.createDataFrame([("l", 1, big, 2), ("l", 2, big + 5, 2)], "lang string, g int, total long, v long")
    share = lambda n, t: 1 + 10 ** 9 * (n + 1) // (t + 2)
    a = [share(n, big) for n in (big, 0)]
    b = [share(n, big + 5) for n in (5, big)]
    row = divergence.group_distances(counts, groups, 2).first()
    assert (row["forth"], row["back"]) == (sum((p - q) ** 2 // q for p, q in zip(a, b)), sum((p - q) ** 2 // p for p, q in zip(a, b)))
    n, total = divergence.F.col("n"), divergence.F.lit(big + 2).cast("long")
    got = spark.createDataFrame([(big,)], "n long").select(divergence.exact_share(n, total)).first()[0]
    assert got == share(big, big)


def test_equal_subtrees_are_one_node(spark):
    rows = [("l", g, i, 1 + i % 2) for g in (1, 2, 3) for i in range(64)]
    levels, roots = divergence.trees(spark.createDataFrame(rows, "lang string, g int, id long, n long"), ["lang", "g"], 64)
    assert [level.count() for level in levels] == [1, 1]
    assert roots.select("root").distinct().count() == 1 and roots.count() == 3


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
