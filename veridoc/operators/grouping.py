"""Equal differences over many documents: per document, per product, merged by place, summed by channel.

A signature may occur in a third of all documents, so groups are never collected: counts, first values and
set fingerprints are partial aggregates, the impacted documents stay a child table (group, document), and
lists that are shown (2 contexts, 12 variants) are exact top-k.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from veridoc.functions.text import fold, one_line
from veridoc.operators import spots, sweeps
from veridoc.operators.ranking import rank_in_group
from veridoc.operators.spots import COLUMN, OVERLAP
from veridoc.session import small, written

BOX = ["left", "bottom", "right", "top", "f_left", "f_bottom", "f_right", "f_top"]
GROUP = ["product", "signature"]
# Groups of one spot that a task sweeps.
SPOT_CHUNK = 20_000


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 32) -> DataFrame:
    """First k rows per key, exactly: first k per key and salt, then first k of those."""
    pre = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    near = pre.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_r") <= k)
    return near.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).drop("_salt", "_r")


def same_spot(a, b) -> Column:
    """Same page, same height (15 points, overlap within 2) and same column start (28 points) or overlap."""
    cy = lambda x: (x("bottom") + x("top")) * 0.5
    level = (F.abs(cy(a) - cy(b)) <= 15.0) & (F.least(a("top"), b("top")) + 2.0 >= F.greatest(a("bottom"), b("bottom")))
    start = lambda x: F.when(x("f_right") > x("f_left"), x("f_left")).otherwise(x("left"))
    column = (F.abs(start(a) - start(b)) <= 28.0) | (F.least(a("right"), b("right")) > F.greatest(a("left"), b("left")))
    return (a("page") == b("page")) & level & column


def merge_boxes(blocks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Box per group: the first block's, widened by blocks on its page within 22 points of height."""
    first = blocks.groupBy(*keys).agg(F.min_by(F.struct("page", *BOX), F.struct(*order)).alias("_f"))
    w = blocks.join(first, keys)
    near = (F.col("page") == F.col("_f.page")) & (F.abs((F.col("bottom") + F.col("top")) / 2 - (F.col("_f.bottom") + F.col("_f.top")) / 2) <= 22.0)
    side = lambda c: (F.min if c.endswith(("left", "bottom")) else F.max)(F.when(near, F.col(c))).alias(c)
    return w.groupBy(*keys).agg(*[side(c) for c in BOX])


def fold_blocks(blocks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First block wins; highest severity with its category; first delta text that is not empty; pages as a set."""
    at = F.struct(*order)
    first = lambda c: F.min_by(c, at).alias(c)
    out = blocks.groupBy(*keys).agg(
        *[first(c) for c in ("old_text", "new_text", "change_type", "context_before", "context_after", "channel")],
        F.max("severity").alias("severity"), F.max("severity").alias("_s"),
        F.min(F.struct((-F.col("severity")).alias("neg"), at.alias("at"), "category")).alias("_c"),
        F.coalesce(F.min_by("delta_text", F.when(F.col("delta_text") != "", at)), F.lit("")).alias("delta_text"),
        F.sort_array(F.collect_set("page")).alias("pages"), F.count("*").alias("n_blocks"))
    return out.withColumn("category", F.col("_c.category")).drop("_c", "_s").join(merge_boxes(blocks, keys, order), keys)


def dedupe_in_document(blocks: DataFrame, order: list[str]) -> DataFrame:
    """One block per signature of a document (`pair_id`)."""
    out = fold_blocks(blocks, ["pair_id", "product", "signature"], order)
    return out.withColumn("page", F.element_at("pages", 1))


def group_documents(blocks: DataFrame) -> DataFrame:
    """Child table: which documents carry a difference."""
    return blocks.select(*GROUP, "pair_id").distinct()


def group_across_documents(blocks: DataFrame, order: list[str]) -> DataFrame:
    """One row per product and signature with its document count and set fingerprint."""
    docs = group_documents(blocks).groupBy(*GROUP).agg(
        F.count("*").alias("n_docs"), F.min("pair_id").alias("first_doc"), F.bit_xor(F.xxhash64("pair_id")).alias("set_x"),
        F.sum(F.hash("pair_id").cast("long")).alias("set_s"))
    return fold_blocks(blocks, GROUP, order).join(docs, GROUP)


def first_contexts(blocks: DataFrame, keys: list[str], order: list[str], k: int = 2) -> DataFrame:
    """Up to k contexts per group, each once (case-insensitive), in order of appearance, joined by ' / '."""
    ctx = F.trim(F.when(F.trim("context_before") != "", F.col("context_before")).otherwise(F.col("context_after")))
    c = blocks.withColumn("_ctx", ctx).where("_ctx <> ''").groupBy(*keys, fold(F.col("_ctx")).alias("_u")).agg(
        F.min(F.struct(*order, "_ctx")).alias("_o"))
    best = top_k(c, keys, [F.col("_o"), F.col("_u")], k)
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("_o._ctx").alias("c")))), lambda x: x["c"]), " / ").alias("contexts"))


def spot_edges(nodes: DataFrame) -> DataFrame:
    """Pairs of boxes (`node`) of a product and page that lie at the same spot, found by bands of 15 points."""
    band = F.floor((F.col("bottom") + F.col("top")) * 0.5 / 15.0)
    a = nodes.withColumn("band", F.explode(F.sequence(band - 1, band + 1))).alias("a")
    b = nodes.withColumn("band", band).alias("b")
    get = lambda p: (lambda c: F.col(f"{p}.{c}"))
    on = ((F.col("a.product") == F.col("b.product")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.band") == F.col("b.band"))
          & (F.col("a.node") < F.col("b.node")) & same_spot(get("a"), get("b")))
    return a.join(b, on).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.lone").alias("la"), F.col("b.lone").alias("lb"))


def spot_islands(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `y_isle` and `x_isle`: boxes of different isles can never meet.

    Hulls whose heights lie more than the overlap tolerance apart are never on one level; on one level, hulls more than the
    column tolerance apart share no column.
    """
    start = F.when(F.col("f_right") > F.col("f_left"), F.col("f_left")).otherwise(F.col("left"))
    out = boxes.withColumn("_lo", F.least("left", start)).withColumn("_hi", F.greatest("right", start))
    return sweeps.islands(out, keys, [("y_isle", "bottom", "top", OVERLAP), ("x_isle", "_lo", "_hi", COLUMN)]).drop("_lo", "_hi")


def merge_variants(groups: DataFrame, chunk: int = SPOT_CHUNK, limit: int | None = None) -> DataFrame:
    """Adds `component`: groups at the same spot belong together, unless both come from one and the same document.

    Groups are swept in order (first_doc, page, signature) of their product and page; a merged box widens and then catches
    more (see `spots`). Pages fall into isles that cannot meet, and the sweep of a crowded isle into chunks (see `sweeps`). The
    component is the id of the group that the others joined; groups without a box stay alone.
    """
    g = written(groups.withColumn("gid", F.sha2(F.concat_ws("|", "product", "signature"), 256)))
    placed = F.col("left").isNotNull() & F.col("bottom").isNotNull() & F.col("right").isNotNull() & F.col("top").isNotNull()
    order = ["first_doc", "page", "signature"]
    field = [F.coalesce(c, F.lit(0.0)).alias(c) for c in BOX[4:]]
    boxes = g.where(placed).select("gid", "product", *order, *BOX[:4], *field,
                                   F.when(F.col("n_docs") == 1, F.col("first_doc").cast("string")).alias("doc"))
    isle = ["product", "page", "y_isle", "x_isle"]
    rows = rank_in_group(spot_islands(boxes, ["product", "page"]), isle, [F.col(c) for c in order if c != "page"], "rn", limit)
    done, last = sweeps.chunked_sweep(rows, isle, ["gid", *BOX, "doc"], spots.sweep, chunk)
    moved = written(last.select(_settled("state").alias("m")).select(F.explode("m").alias("target", "component")).where("target <> component"))
    took = done.join(small(moved), "target", "left").select("gid", F.coalesce("component", "target").alias("component"))
    return g.join(took, "gid", "left").withColumn("component", F.coalesce("component", "gid"))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _settled(states: pd.Series) -> pd.Series:
    return states.map(lambda s: spots.settle(sweeps.unpacked(s)))


def finalize_groups(merged: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per component: representative block, documents, pages label, variants (12 shown, the rest counted)."""
    keys = ["product", "component"]
    at = F.struct("first_doc", "page", "signature")
    label = F.concat(one_line(F.col("old_text"), 36), F.lit(" ➔ "), one_line(F.col("new_text"), 36))
    n_docs = docs.join(merged.select(*GROUP, "component"), GROUP).select(*keys, "pair_id").distinct().groupBy(*keys).agg(F.count("*").alias("occurrence_count"))
    rep = merged.groupBy(*keys).agg(
        *[F.min_by(c, at).alias(c) for c in ("channel", "signature", "change_type", "old_text", "new_text", "context_before")],
        F.max("severity").alias("severity"), F.min(F.struct((-F.col("severity")).alias("neg"), at.alias("at"), "category"))["category"].alias("category"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("pages"), F.count("*").alias("variant_count"))
    shown = top_k(merged.select(*keys, at.alias("at"), label.alias("label")), keys, [F.col("at")], 12).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("variants"))
    out = rep.join(n_docs, keys).join(shown, keys)
    more = F.when(F.col("variant_count") > 12, F.concat(F.col("variants"), F.array(F.concat(
        F.lit("… (+"), (F.col("variant_count") - 12).cast("string"), F.lit(")"))))).when(F.col("variant_count") > 1, F.col("variants")).otherwise(
        F.array().cast("array<string>"))
    pages = F.array_join(F.col("pages").cast("array<string>"), ", ")
    return out.withColumn("variants", more).withColumn("page", F.element_at("pages", 1)).withColumn(
        "pages_label", F.concat(F.when(F.size("pages") > 1, "Pages ").otherwise("Page "), pages))


def group_by_document_set(groups: DataFrame) -> DataFrame:
    """Differences of a product that hit exactly the same documents form one row (sets compared by fingerprint)."""
    key = ["product", "n_docs", "set_x", "set_s"]
    return groups.groupBy(*key).agg(
        F.count("*").alias("diff_count"), F.count_if(F.col("severity") == 3).alias("critical_count"), F.max("severity").alias("max_severity"),
        F.count_if(F.col("change_type").isin(2, 4)).alias("insertions"), F.count_if(F.col("change_type").isin(1, 4)).alias("deletions"),
        F.min("first_doc").alias("first_doc")).drop("set_x", "set_s")


def product_summary(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    docs = blocks.select("channel", "product", "pair_id").distinct().groupBy("channel", "product").agg(F.count("*").alias("impacted_docs"))
    diffs = groups.groupBy("channel", "product").agg(F.count("*").alias("unique_diffs"), F.count_if(F.col("severity") == 3).alias("critical_unique"))
    return docs.join(diffs, ["channel", "product"], "left")


def channel_summary(products: DataFrame) -> DataFrame:
    """Two-level sums: a row per product, per channel and in total."""
    return products.rollup("channel", "product").agg(F.count("*").alias("products"), F.sum("unique_diffs").alias("unique_diffs"),
                                                     F.sum("impacted_docs").alias("impacted_docs"))
