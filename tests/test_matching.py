"""One-to-one matching, ranks, components and pairing against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from veridoc.operators import pairing as O, ranking as K


def test_rank_of_hot_group_is_the_plain_rank(spark):
    rows = [("a" if i % 3 else "b", f"n{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v string").repartition(7)
    plain = {(r.k, r.v): r.rn for r in K.rank_in_group(df, ["k"], [F.col("v")]).collect()}
    split = {(r.k, r.v): r.rn for r in K.rank_in_group(df, ["k"], [F.col("v")], limit=10).collect()}
    assert plain == split and len(plain) == 500


def greedy(edges):
    s, t, out = set(), set(), set()
    for c, a, b in sorted(edges):
        if a not in s and b not in t:
            s.add(a), t.add(b), out.add((a, b))
    return out


def test_greedy_equals_sequential_walk(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randint(0, 5), f"s{rng.randint(0, 12)}", f"t{rng.randint(0, 12)}") for _ in range(80)})
    best = {}
    for c, a, b in edges:
        best.setdefault((a, b), c)
    edges = [(c, a, b) for (a, b), c in best.items()]
    got = K.greedy_one_to_one(spark.createDataFrame(edges, "c int, s string, t string"), ["s"], ["t"], ["c"]).collect()
    assert {(r.s, r.t) for r in got} == greedy(edges)


def test_sizes_match_as_in_a_serial_walk(spark):
    rng = random.Random(8)
    row = lambda x, i: (rng.choice("pq"), rng.choice([7, 20, 21, 90, 130, 131]), f"{x}{i:02d}")
    src, tgt = [row("s", i % 37) for i in range(40)], [row("t", i % 25) for i in range(28)]
    src, tgt = [*src, *src[:3], ("p", None, "s98"), (None, 7, "s99")], [*tgt, ("q", 400, "t99")]
    df = lambda rows, name: spark.createDataFrame(rows, f"product string, n int, {name} string")
    edges = {(abs(n - m), s, t) for p, n, s in src for q, m, t in tgt if p and p == q and n is not None and abs(n - m) <= 50}
    got = {(r.s, r.t): r.gap for r in K.match_by_size(df(src, "s"), df(tgt, "t"), ["product"]).collect()}
    assert set(got) == greedy(edges) and all((g, s, t) in edges for (s, t), g in got.items()) and len(set(got.values())) > 1


def test_files_of_one_size_make_no_edges(spark, monkeypatch):
    seen, walk = [], K.greedy_one_to_one
    monkeypatch.setattr(K, "greedy_one_to_one", lambda edges, *a: seen.append(edges.count()) or walk(edges, *a))
    df = lambda name, count: spark.range(count).selectExpr("'p' as product", "100 as n", f"format_string('{name}%04d', id) as {name}")
    got = K.match_by_size(df("s", 300), df("t", 290), ["product"]).collect()
    assert sorted((r.s[1:], r.t[1:], r.gap) for r in got) == [(f"{i:04d}", f"{i:04d}", 0) for i in range(290)] and seen == [0]


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("d", "e"), ("c", "f"), ("g", "h"), ("h", "a")]
    nodes = spark.createDataFrame([(x,) for x in "abcdefghi"], "node string")
    got = {r.node: r.component for r in K.connected_components(nodes, spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{x: "a" for x in "abcfgh"}, "d": "d", "e": "d", "i": "i"}


def serial_ids(sources, targets):
    """First free target sharing the first identifier that still has one, sources in order."""
    free, out = sorted(targets), {}
    for s, ids in sorted(sources.items()):
        for i in ids:
            hit = next((t for t in free if i in targets[t]), None)
            if hit:
                free.remove(hit)
                out[s] = hit
                break
    return out


def test_shared_id_equals_serial_choice(spark):
    rng = random.Random(11)
    ids = [f"{n}{n}{n}00" for n in range(1, 6)]
    pick = lambda: rng.sample(ids, rng.randint(1, 3))
    src = {f"/x/s{i:02d} {' '.join(v)}.pdf": v for i in range(14) for v in [pick()]}
    tgt = {f"/x/t{i:02d} {' '.join(v)}.pdf": v for i in range(12) for v in [pick()]}
    df = lambda d: spark.createDataFrame([("p", k) for k in d], "product string, path string")
    got = {r.source_path: r.target_path for r in O.pair_shared_id(df(src), df(tgt)).collect()}
    assert got == serial_ids(src, tgt)


def test_content_pairing_is_best_first(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(25)] + [f"n{i}9" for i in range(10)]
    docs = {f"/{side}/{i:02d}.pdf": frozenset(rng.sample(vocab, rng.randint(4, 14))) for side in "st" for i in range(12)}
    docs["/t/03.pdf"] = docs["/s/05.pdf"]
    docs["/s/07.pdf"] = docs["/s/05.pdf"]
    src, tgt = [d for d in docs if d[1] == "s"], [d for d in docs if d[1] == "t"]
    pool = len(docs)
    df = {w: sum(w in v for v in docs.values()) for w in vocab}
    w = lambda t: (6.0 if df[t] <= 2 else 2.5 if df[t] < pool // 2 else 1.0) * (2.0 if any(c.isdigit() for c in t) else 1.0)
    score = lambda a, b: sum(map(w, docs[a] & docs[b])) / sum(map(w, docs[a] | docs[b]))
    f = lambda names: spark.createDataFrame([("p", x) for x in names], "product string, path string")
    fp = lambda names: spark.createDataFrame([("p", x, t) for x in names for t in docs[x]], "product string, path string, token string")
    got = [(r.source_path, r.target_path, r.score) for r in O.pair_content_similarity(f(src), f(tgt), fp(src), fp(tgt)).collect()]
    assert all(abs(score(a, b) - s) < 1e-9 for a, b, s in got)
    s_free, t_free = set(src), set(tgt)
    for a, b, s in sorted(got, key=lambda r: -r[2]):
        # No open pair scores higher than the one taken.
        assert max(score(x, y) for x, y in itertools.product(s_free, t_free)) <= s + 1e-9
        s_free.discard(a), t_free.discard(b)
    assert all(score(x, y) < 0.18 for x, y in itertools.product(s_free, t_free))


def test_token_sets_are_built_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        calls.add(1)
        return x

    rows = lambda side, words: spark.createDataFrame([("p", f"/{side}/{i}.pdf", w) for i in range(6) for w in words(i)],
                                                     "product string, path string, token string").withColumn("token", told.asNondeterministic()("token"))
    src, tgt = rows("s", lambda i: ["all", f"a{i}", f"b{i}", f"c{i}"]), rows("t", lambda i: ["all", f"a{i}", f"b{i}", "other"])
    files = lambda fp: fp.select("product", "path").distinct()
    got = O.pair_content_similarity(files(src), files(tgt), src, tgt).collect()
    assert sorted((r.source_path[3:], r.target_path[3:]) for r in got) == [(f"{i}.pdf",) * 2 for i in range(6)]
    assert calls.value == 48


def test_classes_are_compared_on_one_array_each(spark):
    """One token stands in all classes, three more in two of them; numbers hold doubled weights of 6 and 2."""
    toks = lambda i: [(100 * i + j << 5 | 12, 20.0 - 6 * j) for j in range(3)] + [(1 << 20 | 4, 2.0)]
    sets = spark.createDataFrame([(i, "p", f"c{i}", "ST"[i % 2], 20.0, {}, toks(i // 2)) for i in range(8)],
                                 "file long, product string, cls string, side string, total double, repeats map<long,long>, "
                                 "toks array<struct<num:long,rest:double>>")
    got = O.similar_classes(sets.select("product", "cls", "side"), sets, 0.18).collect()
    assert sorted((r.a, r.b, r.score) for r in got) == [(f"c{i}", f"c{i + 1}", 1.0) for i in (0, 2, 4, 6)]
