"""Listed files, profiles and the CSV export on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from veridoc.operators import reports as P
from veridoc.sources import files, profiles


def test_list_files(spark, tmp_path):
    (tmp_path / "a" / "below").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    for name, text in (("a/x.pdf", "12"), ("a/Y.PDF", "123"), ("a/0.pdf", ""), ("a/z.txt", "1"), ("a/below/w.pdf", "123")):
        (tmp_path / name).write_text(text)
    a, gone, empty = str(tmp_path / "a"), str(tmp_path / "gone"), str(tmp_path / "empty")
    found = files.list_files(spark, [a, a + "", gone, empty, "", " "])
    assert sorted((r.name, r.length) for r in found.collect()) == [("Y.PDF", 3), ("x.pdf", 2)] and "content" not in found.columns
    assert sorted(r.name for r in files.list_files(spark, [a], deep=True).collect()) == ["Y.PDF", "w.pdf", "x.pdf"]
    assert {r.name: bytes(r.content) for r in files.list_files(spark, [a], "*.txt", content=True).collect()} == {"z.txt": b"1"}
    assert files.list_files(spark, []).count() == files.list_files(spark, [gone]).count() == 0


def test_profiles(spark, tmp_path):
    rule = lambda rule_id, pattern, on=True: {"rule_id": rule_id, "rule_order": 1, "pattern": pattern, "is_enabled": on, "ignore_case": True}
    zone = lambda rule_id, width: {"rule_id": rule_id, "is_enabled": True, "width": width, "height": 5.0}
    lines = [json.dumps({"profile_name": "p", "critical_regex": "[", "file_key_regex": "", "unknown": 1,
                         "zones": [zone("z", 4.0), zone("flat", 0.0), zone("none", None)],
                         "regexes": [rule("ok", "a+"), rule("bad", "("), rule("off", "(", False), rule("blank", " ")]}),
             json.dumps({"profile_name": "q", "critical_regex": "a", "regexes": [rule("ok", r"\bx")]}),
             '{"profile_name": "broken', json.dumps({"profile_name": " "}), json.dumps({"profile_name": "wrong", "zones": "text"})]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.json").write_text("\n".join(lines))
    got = profiles.load_profiles(spark, str(tmp_path / "p"))
    assert sorted(r.rule_id for r in got.regexes.collect()) == ["p/ok", "q/ok"] and [r.rule_id for r in got.zones.collect()] == ["p/z"]
    assert sorted(map(tuple, got.errors.where("profile is not null and kind <> 'profile'").select("profile", "rule_id", "kind").collect())) == [
        ("p", "critical_regex", "setting"), ("p", "p/bad", "pattern"), ("p", "p/flat", "zone"), ("p", "p/none", "zone")]
    assert got.errors.where("kind = 'profile'").count() == 3 and sorted(r.profile_name for r in got.settings.collect()) == ["p", "q"]
    assert [r.rule_id for r in profiles.rule_list(got.regexes)] == ["p/ok", "q/ok"]
    (tmp_path / "none").mkdir()
    assert all(t.count() == 0 for t in profiles.load_profiles(spark, str(tmp_path / "none")))


def test_profiles_come_back_as_saved(spark, tmp_path):
    table = spark.createDataFrame([("p", "x"), ("q", None)], "profile_name string, file_key_regex string").withColumn(
        "regexes", F.array(F.struct(F.lit("r").alias("rule_id"), F.lit(2).alias("rule_order"), F.lit('"\\d;\n').alias("pattern"), F.lit(True).alias("is_enabled"))))
    profiles.save_profiles(table, str(tmp_path / "s"))
    got = profiles.load_profiles(spark, str(tmp_path / "s"))
    assert sorted((r.rule_id, r.rule_order, r.pattern) for r in got.regexes.collect()) == [("p/r", 2, '"\\d;\n'), ("q/r", 2, '"\\d;\n')]
    assert got.errors.count() == 0


def test_too_many_rules(spark):
    with pytest.raises(ValueError):
        profiles.rule_list(spark.range(profiles.MAX_RULES + 1).select(F.lit(1).alias("rule_order"), F.col("id").alias("rule_id")))


def test_csv_round_trip(spark, tmp_path):
    texts = ['a;b', 'say "hi"', '"', '\\', 'a\\"b;', " blanks ", "", None, "line\nend\r\n", ",,", "é€", '""', "x" * 50_000]
    rows = [("Bank", i % 3, t, "Different", "P.1", t, "new", p) for i, t in enumerate(texts) for p in ("src1", "7", None)]
    table = spark.createDataFrame(rows, "channel string, n_docs long, document string, status string, pages string, old_text string, new_text string, product string")
    P.export_product_csv(table, str(tmp_path / "csv"))
    flat = lambda t: (t or "").replace("\r", " ").replace("\n", " ")
    want = sorted((c, n, flat(d), s, g, flat(o), w, p or "") for c, n, d, s, g, o, w, p in rows)
    got = P.read_product_csv(spark, str(tmp_path / "csv"))
    assert sorted((*r[:-1], r[-1] or "") for r in got.collect()) == want and got.where("product is null").count() == len(texts)
    assert {p.name for p in (tmp_path / "csv").glob("product=*")} == {"product=src1", "product=7", "product=__HIVE_DEFAULT_PARTITION__"}


def test_hot_product_is_many_files(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(0, 20_000, 1, 8).select(F.lit("c").alias("channel"), F.col("id").alias("n_docs"), F.sha2(F.col("id").cast("string"), 256).alias("document"),
                                                   *[F.lit("").alias(c) for c in ("status", "pages", "old_text", "new_text")], F.lit("hot").alias("product"))
        P.export_product_csv(rows, str(tmp_path / "csv"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "csv" / "product=hot").glob("*.csv"))) > 3
    assert P.read_product_csv(spark, str(tmp_path / "csv")).agg(F.sum("n_docs"), F.count("*")).first()[:] == (199_990_000, 20_000)
