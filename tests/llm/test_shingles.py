"""Near copies by shingles against brute-force Jaccard."""

import math
import os
import random
from urllib.parse import unquote, urlparse

import pytest

import corpus_pipeline as P
from tests.llm.test_simhash import plain_components
from veridoc.llm import shingles as S


def plain_set(text, words):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(parts[i:i + words]) for i in range(len(parts) - words + 1)} or ({" ".join(parts)} if parts else set())


def plain_stay(rows, words, num, den):
    sets = [plain_set(t, words) for _, t in rows]
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) * den >= len(sets[i] | sets[j]) * num]
    best = {}
    for i, p in plain_components(range(len(rows)), alike).items():
        rank = (rows[i][0] is None, rows[i][0] or 0)
        if p not in best or rank < best[p][0]:
            best[p] = (rank, rows[i])
    return sorted(str(r) for _, r in best.values()), alike


def copies(seed):
    """Near copies on both sides of the threshold, a chain of them, a crowd of one text, a line that all share, short and blank texts."""
    rng = random.Random(seed)
    words, line = [f"w{i}" for i in range(400)], "this line stands in nearly every text of the whole table"
    new = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [None, "", " \n", "one two", "One  TWO", "one two three"]
    for _ in range(25):
        base = new(rng.randrange(6, 120))
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        texts.append(line + " " + " ".join(new(12)))
        texts.append(" ".join(new(4)) + " " + line)
    chain, crowd = new(80), new(60)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[4:] + new(4)
    for i in range(40):
        texts.append(" ".join([*crowd[:i], rng.choice(words), *crowd[i + 1:]]))
    rows = [(1000 - i if rng.random() < .97 else None, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,similarity,num,den,common", [(5, 0.8, 4, 5, 3), (3, 0.7, 7, 10, 10**9), (1, 1.0, 1, 1, 1)])
def test_rows_that_stay_are_those_of_brute_force(spark, tmp_path, monkeypatch, words, similarity, num, den, common):
    monkeypatch.setattr(S, "COMMON", common)
    rows = copies(words)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/d")
    got = S.without_near_copies(spark.read.parquet(f"{tmp_path}/d"), words=words, similarity=similarity)
    want, alike = plain_stay(rows, words, num, den)
    have = sorted(str(tuple(r)) for r in got.collect())
    ids = lambda out: sorted(x for x in out if not x.startswith("(None"))
    assert len(have) == len(want) < len(rows) and alike
    assert ids(have) == ids(want)


def test_stage_drops_copies_beyond_two_bits(spark, tmp_path):
    from veridoc.llm.simhash import fingerprint
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    copy, other = [*base[:30], "changed", *base[31:]], [*base[:20], *(f"v{i}" for i in range(40))]
    texts = [" ".join(x) for x in (base, copy, other)]
    assert (fingerprint(texts[0]) ^ fingerprint(texts[1])).bit_count() > 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    stage = dict(P.STAGES)["SimHash near-dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path)).collect()) == [0, 2]


def test_stage_drops_texts_linked_by_fingerprints_alone(spark, tmp_path):
    from veridoc.llm.simhash import fingerprint
    rng = random.Random(4)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    core = new(21) * 150
    texts = [" ".join(x) for x in (core + new(10), core + new(40), new(80))]
    a, b = (plain_set(t, 5) for t in texts[:2])
    assert (fingerprint(texts[0]) ^ fingerprint(texts[1])).bit_count() <= 2 and 5 * len(a & b) < 4 * len(a | b)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    stage = dict(P.STAGES)["SimHash near-dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path)).collect()) == [0, 2]


def test_empty(spark):
    assert S.without_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowd_of_near_copies_is_not_compared_pair_by_pair(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    base, texts = [f"w{i}" for i in range(120)], []
    for i in range(300):
        copy = list(base)
        for k in rng.sample(range(len(copy)), 1 + (i % 4 > 0)):
            copy[k] = f"x{rng.randrange(9)}"
        texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    compared, files, verified, store = [], [], S._verified, S.store

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    def stored(df, name):
        out = store(df, name)
        if name in ("prefixes", "near", "sets"):
            files.extend(out.inputFiles())
        return out

    monkeypatch.setattr(S, "_verified", counted)
    monkeypatch.setattr(S, "store", stored)
    got = sorted(r["doc_id"] for r in S.without_near_copies(spark.read.parquet(f"{tmp_path}/d")).collect())
    want, alike = plain_stay(rows, 5, 4, 5)
    assert [str(rows[i]) for i in got] == sorted(want, key=lambda x: int(x[1:x.index(",")])) and len(alike) > 5000
    assert sum(compared) < 10000, compared
    # Whole sets and prefixes do not stay on disk.
    assert files and not any(os.path.exists(unquote(urlparse(f).path)) for f in files)


def test_shingles_of_all_texts_are_counted(spark, tmp_path):
    n = 21_000
    texts = spark.range(n).selectExpr("concat('a b c d e f', id) t", "string(id % 3) file", "id row")
    weights = S.common_shingles(texts)
    common, rare = S.shingle_set("a b c d e"), S.shingle_set("b c d e f7")
    at = lambda hashes: weights[hashes & (S.BUCKETS - 1)].tolist()
    assert at(common) == [int(8 * math.log2(1 + n))] and at(rare) == [0]
    assert S.common_shingles(spark.createDataFrame([], "t string")).max() == 0
