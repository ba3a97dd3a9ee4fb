"""Words stay where their documents are: bounded tasks, and no shuffle of a token with its paths."""

import os

from pyspark.sql import functions as F

from veridoc.operators import pairing as P
from veridoc.session import spread


def test_tasks_that_expand_texts_are_small(spark, tmp_path):
    spark.range(200).select(F.col("id").alias("doc_id"), F.concat(*[F.sha2(F.concat("id", F.lit(f" {i}")), 512) for i in range(500)]).alias("text")) \
        .coalesce(1).write.parquet(f"{tmp_path}/d")
    size = sum(f.stat().st_size for f in os.scandir(f"{tmp_path}/d"))
    docs = spread(spark.read.parquet(f"{tmp_path}/d"), "doc_id")
    assert size > 6 << 20 and docs.rdd.getNumPartitions() >= size >> 20


def test_content_score_moves_no_token_with_its_paths(spark):
    files = lambda side: spark.createDataFrame([("p", f"{side}{i}") for i in range(4)] + [("p", None)], "product string, path string")
    tokens = {"s0": "a b c1", "t0": "b c1 d", "s1": "a", "t1": "a", "s2": "a", "t3": "x y"}
    fp = lambda side: spark.createDataFrame([("p", k, t) for k, v in tokens.items() if k[0] == side for t in v.split()],
                                            "product string, path string, token string")
    pairs = spark.createDataFrame([("p", f"s{i}", f"t{i}") for i in (0, 1, 1, 2, 3)] + [("p", None, "t0"), ("q", "s9", "t9")],
                                  "product string, source_path string, target_path string")
    got = P.content_score(pairs, fp("s"), fp("t"), P.token_weights(fp("s"), fp("t"), P.pool_sizes(files("s"), files("t"))))
    # Ten files in the pool: a occurs in three of them (2.5), b, d, x and y in up to two (6), c1 is twice a rare one (12).
    assert sorted((r[1] or "", round(r[3], 9)) for r in got.collect()) == sorted(
        [("s0", round(18 / 26.5, 9)), ("s1", 1.0), ("s1", 1.0), ("s2", 0.0), ("s3", 0.0), ("", 1.0), ("s9", 1.0)])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "token#" in x and "_path#" in x]
