"""Discovery in small listings: every branch of the fallbacks, roots named as channels, empty and foreign roots."""

import pytest

from veridoc.operators import campaign as C


def listing(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def products(spark, root, *paths, **how):
    found = C.discover_product_subfolders(listing(spark, *paths), root, ["Bank", "Broker"], "2026_R11", **how)
    return sorted((r["channel"], r["product"], r["source_dir"], r["source_count"], r["target_dir"], r["target_count"], r["is_ready"]) for r in found.collect())


A = ("Bank", "P1", "/r/Bank/P1/Source", 1, "/r/Bank/P1/2026_R11/Target", 1, True)
FILES = ("/r/Bank/P1/Source/a.pdf", "/r/Bank/P1/2026_R11/Target/a.pdf", "/r/Other/P2/Source/a.pdf")


@pytest.mark.parametrize("root", ["/r", "/r/", "/r/bank"])
def test_channels(spark, root):
    assert products(spark, root, *FILES) == [A]


def test_inner_folder(spark):
    deeper = [p.replace("/r/", "/r/In/") for p in FILES]
    assert [x[:4] for x in products(spark, "/r", *deeper, inner="in")] == [("Bank", "P1", "/r/In/Bank/P1/Source", 1)]
    assert [x[:2] for x in products(spark, "/r", *FILES, *deeper, inner="In")] == [("Bank", "P1")]


def test_root_is_product(spark):
    assert products(spark, "/r/Bank/P1", *FILES) == [A]


def test_root_is_parent(spark):
    got = products(spark, "/r/Other", *FILES, "/r/Other/P3/x.pdf", "/r/Other/plain.pdf")
    assert [(x[1], x[3], x[6]) for x in got] == [("P2", 1, False), ("P3", 0, False)]


def test_nothing(spark):
    assert products(spark, "/none", *FILES) == [] and products(spark, "/r") == []


def pairs(spark, root, *paths):
    found = C.discover_auto_pairs(listing(spark, *paths), root)
    return sorted((r["dir"], r["source_name"], r["source_count"], r["target_count"]) for r in found.collect())


def test_two_folders(spark):
    two = ("/r/b/1.pdf", "/r/b/2.pdf", "/r/A/1.pdf", "/r/A/x.txt", "/r/texts/x.txt")
    assert pairs(spark, "/r", *two) == [("/r", "A", 1, 2)]
    assert pairs(spark, "/r", *two, "/r/c/1.pdf") == [] and pairs(spark, "/r", *two[:2]) == [] and pairs(spark, "/r") == []
    # A named pair anywhere in the scan comes first.
    assert pairs(spark, "/r", *two, "/r/x/y/Source/1.pdf", "/r/x/y/Target/1.pdf") == [("/r/x/y", "Source", 1, 1)]
