"""Every stage of the corpus pipeline against a plain version on a small table."""

import math
import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline as P
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import plain_components
from tests.llm.test_tokens import plain as plain_ids

WORDS = {"en": "the of and thing which other make water".split(), "de": "der und nicht über straße schön wasser auch".split()}


def rows_of(seed):
    rng, rows = random.Random(seed), []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(rng.randrange(20, 120))).capitalize()
        rows.append([i, text, lang if rng.random() < .9 else None, rng.choice(["a", "b", "b", None]), len(text)])
    base = rows[0][1]
    rows += [[200 + i, base.upper(), "en", "a", 1] for i in range(20)]
    rows += [[300 + i, base + f" tail{i}", "en", "b", 1] for i in range(5)]
    rows += [[400, None, None, "a", None], [401, "", "en", "a", 0], [402, "123 !!", "en", "a", 6], [None, "no number " + base, "en", "a", 3], [7, rows[9][1], "en", "a", 3]]
    return rows


def texts(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.createDataFrame(rows_of(1), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out, folder = [], tmp_path_factory.mktemp("pipeline")
    docs.write.parquet(f"{folder}/in/documents.parquet")
    docs = spark.read.parquet(f"{folder}/in/documents.parquet")
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, f"{folder}/in").write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        out.append((docs, after))
        docs = after
    return out, f"{folder}/in"


def test_columns_and_run(spark, stages):
    (parts, sf_dir) = stages
    assert all(a.schema == b.schema for a, b in parts[:-1])
    assert P.run(spark, sf_dir).groupBy("doc_id").count().count() == parts[-1][1].groupBy("doc_id").count().count()


def test_language_stage(stages):
    before, after = stages[0][0]
    rows = before.collect()
    # A plain version of the rule: what is rejected has no letter.
    assert texts(after) == sorted(str(tuple(r)) for r in rows if any(c.isalpha() for c in r["text"] or ""))


def test_language_predictions_equal_a_plain_classifier(stages):
    from veridoc.llm import language as L
    docs = stages[0][0][0]
    model = L.fit(docs.filter(L.in_training_part()))
    rows = docs.collect()
    known = [r for r in rows if r["doc_id"] is not None and r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    buckets, counts, total = len(model.log_prob), {}, {}

    def grams(text):
        import numpy as np
        codes = L._codes(f" {text.lower()} ")
        for order in L.ORDERS:
            yield from L._grams(codes, np.zeros(len(codes), dtype=np.int64), order, buckets)[0].tolist()
    for r in known:
        counts.setdefault(r["lang"], Counter()).update(grams(r["text"]))
    total = {x: sum(c.values()) for x, c in counts.items()}
    prior = Counter(r["lang"] for r in known)
    for r, pred in zip(rows, L.score_texts(model, [r["text"] for r in rows])[0]):
        if not any(c.isalpha() for c in r["text"] or ""):
            assert pred == "und"
            continue
        score = {x: math.log(prior[x] / len(known)) + sum(math.log((counts[x][g] + .1) / (total[x] + .1 * buckets)) for g in grams(r["text"]))
                 for x in sorted(counts)}
        assert pred == max(score, key=score.get)


def test_exact_stage(stages):
    before, after = stages[0][1]
    best = {}
    for r in before.collect():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        if key not in best or (r["doc_id"] is not None, r["doc_id"] or 0) > (best[key]["doc_id"] is not None, best[key]["doc_id"] or 0):
            best[key] = r
    assert texts(after) == sorted(str(tuple(r)) for r in best.values())


def test_near_stage(stages):
    before, after = stages[0][2]
    rows = before.collect()

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r["text"]) for r in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert close
    best = {}
    for i, p in plain_components(range(len(rows)), close).items():
        rank = (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0)
        if p not in best or rank < best[p][0]:
            best[p] = (rank, rows[i])
    assert texts(after) == sorted(str(tuple(r)) for _, r in best.values())


def test_mixing_stage(stages):
    before, after = stages[0][3]
    size = lambda r: len((r["text"] or "").split())
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before.collect():
        sizes[r["source"]] += size(r)
        largest[r["source"]] = max(largest[r["source"]], size(r))
    for r in after.collect():
        taken[r["source"]] += size(r)
    assert all(abs(taken[s] - t) <= largest[s] for s, t in plain_targets(sizes).items())
    assert max(Counter(texts(after)).values()) <= 2 and set(texts(after)) <= set(texts(before))


def test_packing_stage(stages):
    before, after = stages[0][4]
    import numpy as np
    want = Counter(zlib.crc32(np.array(x + [1], dtype="<u4").tobytes()) for x in plain_ids([r["text"] for r in before.collect()]))
    pieces = sorted(after.collect(), key=lambda p: (p["sequence_id"], p["offset"]))
    assert sum(p["length"] for p in pieces) == sum(len(x) + 1 for x in plain_ids([r["text"] for r in before.collect()]))
    whole = Counter(p["ids_crc32"] for p in pieces if p["length"] == p["doc_tokens"])
    assert whole and not whole - want
    assert all(zlib.crc32(p["ids"]) == p["ids_crc32"] for p in pieces)
