"""Streaming exact deduplication against a plain grouping."""

import hashlib

from pyspark.sql import functions as F

from veridoc.llm import streamdedup as S

ROWS = [(1, "Same Text"), (5, "same text"), (3, "SAME TEXT"), (7, "É upper"), (8, "é upper"), (9, "É UPPER"), (2, None), (4, ""), (None, ""),
        (None, "no id"), (None, "NO ID"), (6, "one"), (6, "ONE"), (6, "One"), (10, " same text"), (11, "x" * 200_000), (12, "X" * 200_000),
        (13, "İ"), (14, "i̇"), (15, "Σας"), (16, "σας")]


def plain(rows):
    def norm(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return sorted(str((i, max((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]),
                       hashlib.sha256(norm(t).encode()).hexdigest())) for i, t in rows), len(groups)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, digest string, row int").repartition(3)


def test_groups_equal_plain_ones(spark):
    want, groups = plain(ROWS)
    got = S.exact_duplicates(frame(spark, ROWS)).collect()
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["digest"])) for r in got) == want
    assert sum(r["kept"] for r in got) == groups and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    left = S.without_duplicates(frame(spark, ROWS))
    assert left.columns == ["doc_id", "text", "digest", "row"] and left.count() == groups


def test_differing_texts_of_one_digest_stay_apart(spark):
    want, groups = plain(ROWS)

    def weak(t):
        return F.substring(S.sha256(t), 1, 1)
    docs = frame(spark, ROWS)
    got = S.exact_duplicates(docs, digest=weak).collect()
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"])) for r in got) == sorted(w.rsplit(",", 1)[0] + ")" for w in want)
    assert sum(r["kept"] for r in got) == groups


def test_state_is_kept_over_runs_and_batches(spark, tmp_path):
    docs = S.stored(frame(spark, ROWS))
    first, second = docs.filter("doc_id <= 6"), docs.filter("doc_id > 6 or doc_id is null")
    state = S.StreamDedup(spark, str(tmp_path / "s"), files_per_batch=1)
    state.add(first)
    state.add(second)
    want, _ = plain(ROWS)
    got = state.rows(docs).collect()
    assert sorted(str((r["id"], r["keep_id"], r["group_size"], r["digest"])) for r in got) == want


def test_empty_table(spark):
    docs = frame(spark, ROWS).limit(0)
    assert S.exact_duplicates(docs).count() == 0 and S.without_duplicates(docs).count() == 0
