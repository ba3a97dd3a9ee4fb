"""Review of results without running them again: which stored blocks an approval or a new rule takes away, and the counts after.

Only pairs that lose blocks are touched: only their blocks are counted once more, all others keep their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veridoc.functions.text import fold
from veridoc.operators.grouping import BOX, same_spot
from veridoc.operators.zonerules import scope
from veridoc.operators.zones import zone_hit
from veridoc.session import small

KEY = ["pair_id", "seq"]
APPROVED = "Approved by hand"
EXCLUDED = "Excluded by rule"


def _sides(p: str):
    return lambda c: F.col(f"{p}.{c}")


def _any_of(*hits: DataFrame) -> DataFrame:
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.dropDuplicates(KEY)


def approved_blocks(blocks: DataFrame, approved: DataFrame) -> DataFrame:
    """Blocks that an approval takes away: those of an approved (product, signature), and where `is_zone`, of the same spot."""
    named = blocks.join(small(approved.select("product", "signature").distinct()), ["product", "signature"], "left_semi")
    spots = small(approved.where("is_zone").select("product", "page", *BOX).distinct()).alias("z")
    b = blocks.alias("b")
    near = b.join(spots, (F.col("b.product") == F.col("z.product")) & (F.col("b.page") == F.col("z.page")) & same_spot(_sides("b"), _sides("z")), "left_semi")
    return _any_of(named, near)


def excluded_by_text(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Blocks with the signature of a new rule, without case, in all products."""
    keys = small(rules.select(fold(F.col("signature")).alias("_sig")).distinct())
    return blocks.withColumn("_sig", fold(F.col("signature"))).join(keys, "_sig", "left_semi").select(*blocks.columns)


def excluded_by_zones(blocks: DataFrame, zones: DataFrame, clicks: DataFrame) -> DataFrame:
    """Blocks that zones made from other blocks take away.

    `zones` are (zone_id, product, page, left, bottom, right, top) as they are after the upsert, `clicks` the blocks they were made
    from with the `zone_id` each one ended in. A zone takes blocks of its products and its page that it hits by the centre or by 45 %
    on each axis, and those at the spot of a click on it or with its signature. A zone without product applies to all. Blocks without
    a box go by signature only.
    """
    b = blocks.withColumn("_scope", scope(F.col("product"))).alias("b")
    made = zones.join(clicks.select("zone_id").distinct(), "zone_id", "left_semi").withColumn("_scope", scope(F.col("product")))
    spots = clicks.select("zone_id", "signature", *BOX).join(made.select("zone_id", "_scope", "page"), "zone_id")
    fixed = {"unit": F.lit("PdfPoints"), "origin": F.lit("BottomLeft"), "x": F.col("z.left"), "y": F.col("z.bottom"), "is_user_zone": F.lit(True),
             "width": F.col("z.right") - F.col("z.left"), "height": F.col("z.top") - F.col("z.bottom"), "scope_key": F.col("z._scope")}
    page = F.lit(0.0)  # boxes in points do not depend on the size of the page
    hit = zone_hit(fixed.__getitem__, *(F.col(f"b.{c}") for c in ("left", "bottom", "right", "top")), page, page)
    out = []
    for wide in (False, True):
        of = lambda df: small(df.where(F.col("_scope") == "" if wide else F.col("_scope") != "")).alias("z")
        place = (F.col("b.page") == F.col("z.page")) & (F.lit(True) if wide else F.col("b._scope") == F.col("z._scope"))
        out += [b.join(of(made), place & hit, "left_semi"),
                b.join(of(spots.drop("signature").distinct()), place & same_spot(_sides("b"), _sides("z")), "left_semi"),
                b.join(of(spots.select("_scope", "page", "signature").distinct()), place & (F.col("b.signature") == F.col("z.signature")), "left_semi")]
    return _any_of(*out).select(*blocks.columns)


def retracted(pairs: DataFrame, blocks: DataFrame, gone: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """(pairs that lose blocks, with their counts after it; the blocks that they keep).

    `gone` are rows of `blocks`; pairs that are missing or in error keep what they have. A pair without blocks left is identical.
    `note` tells why, or how many differences are left. Insertions and deletions are those of the analysis until none is left.
    """
    gone = gone.select(*KEY).dropDuplicates(KEY)
    touched = pairs.where(F.col("status").isin("Different", "Identical")).join(small(gone.select("pair_id").distinct()), "pair_id", "left_semi")
    kept = blocks.join(small(touched.select("pair_id")), "pair_id", "left_semi").join(small(gone), KEY, "left_anti")
    left = kept.groupBy("pair_id").agg(F.count("*").alias("_n"), F.count_if(F.col("severity") == 3).alias("_c"), F.max("severity").alias("_s"))
    n, none, zero = F.coalesce("_n", F.lit(0)), F.col("_n").isNull(), F.lit(0)
    after = {"status": F.when(none, "Identical").otherwise("Different"), "diff_count": n, "critical_count": F.coalesce("_c", zero),
             "max_severity": F.coalesce("_s", zero), "insertions": F.when(none, 0).otherwise(F.col("insertions")),
             "deletions": F.when(none, 0).otherwise(F.col("deletions"))}
    rows = touched.join(left, "pair_id", "left").select(
        *[after[c].cast(pairs.schema[c].dataType).alias(c) if c in after else F.col(c) for c in pairs.columns if c != "note"],
        F.when(none, F.lit(reason)).otherwise(F.concat(n.cast("string"), F.lit(" difference(s)"))).alias("note"))
    return rows, kept
