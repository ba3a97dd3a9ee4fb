"""Statuses, counters, the gate, report rows, sinks, and review of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from veridoc.functions.text import fold, strip_badge
from veridoc.operators.blocks import row_key
from veridoc.operators.grouping import GROUP, first_contexts, group_across_documents, same_spot

STATUS_ORDER = ["Different", "Error", "MissingInTarget", "Identical"]


def pair_status(pairs: DataFrame, blocks: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Status and counts per pair: missing, error, identical (no verified block) or different."""
    b = blocks.groupBy("pair_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("severity") == 3).alias("_crit"), F.max("severity").alias("_sev"),
        F.count_if(F.col("change_type").isin(2, 4)).alias("_ins"), F.count_if(F.col("change_type").isin(1, 4)).alias("_del"))
    out = pairs.join(b, "pair_id", "left")
    if errors is not None:
        out = out.join(errors.select("pair_id").distinct().withColumn("_err", F.lit(True)), "pair_id", "left")
    else:
        out = out.withColumn("_err", F.lit(None).cast("boolean"))
    gone = F.col("target_path").isNull()
    status = F.when(gone, "MissingInTarget").when(F.col("_err"), "Error").when(F.col("_n") > 0, "Different").otherwise("Identical")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*pairs.columns, status.alias("status"),
                      F.when(gone | F.coalesce("_err", F.lit(False)), -1).otherwise(zero("_n")).cast("long").alias("diff_count"),
                      zero("_ins").alias("insertions"), zero("_del").alias("deletions"), zero("_crit").alias("critical_count"),
                      zero("_sev").cast("int").alias("max_severity"))


def kpis(pairs: DataFrame, unique_diffs: DataFrame | None = None) -> DataFrame:
    n = lambda cond: F.count_if(cond)
    st = F.col("status")
    out = pairs.agg(F.count("*").alias("total"), n(st == "Identical").alias("identical"), n(st == "Different").alias("different"),
                    n((st == "Different") & ((F.col("max_severity") == 3) | (F.col("critical_count") > 0))).alias("critical"),
                    n(st.isin("MissingInTarget", "Error")).alias("issues"))
    if unique_diffs is not None:
        out = out.withColumn("_k", F.lit(1)).join(unique_diffs.agg(F.count("*").alias("unique_diffs")).withColumn("_k", F.lit(1)), "_k").drop("_k")
    return out


def gate(pairs: DataFrame, critical_only: bool = False) -> DataFrame:
    """Exit code: 2 for critical, error or missing; 1 for any other difference unless only critical ones count; else 0."""
    k = kpis(pairs)
    return k.select(F.when((F.col("critical") > 0) | (F.col("issues") > 0), 2).when(
        (F.col("different") > 0) & F.lit(not critical_only), 1).otherwise(0).alias("exit_code"))


def status_filter(pairs: DataFrame, view: str) -> DataFrame:
    keep = {"ALL": STATUS_ORDER, "ERRORS": ["Different", "Error"], "COMPATIBLE": ["Identical"], "MISSING": ["MissingInTarget"]}[view]
    return pairs.where(F.col("status").isin(keep))


def status_rank(status: Column) -> Column:
    out = F.lit(len(STATUS_ORDER))
    for i, s in reversed(list(enumerate(STATUS_ORDER))):
        out = F.when(status == s, i).otherwise(out)
    return out


def order_results(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("diff_count"), "pair_id")


def order_documents(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(status_rank(F.col("status")), "channel", "product", "match_key", "pair_id")


def channel_priority(items: DataFrame) -> DataFrame:
    return items.groupBy("channel").agg(F.min("sort_priority").alias("priority"))


def order_campaign(pairs: DataFrame, priority: DataFrame) -> DataFrame:
    return pairs.join(F.broadcast(priority), "channel").orderBy("priority", F.desc("diff_count"), "product", "pair_id")


def summaries_from_pairs(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    name = F.regexp_extract(F.coalesce("target_path", "source_path"), r"([^/\\]*)$", 1)
    head = pairs.where("status = 'Different'").select(
        "pair_id", "channel", "product", name.alias("raw_file_name"),
        F.concat(F.lit("["), "channel", F.lit(" • "), "product", F.lit("] "), name).alias("document_name"), "max_severity", "critical_count")
    return head.join(blocks.select("pair_id", "page", "change_type", "severity", "category", "signature"), "pair_id")


def product_csv_rows(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the per-product export: grouped differences, then one row per pair without differences."""
    flat = lambda c: F.translate(F.coalesce(c, F.lit("")), "\r\n", "  ")
    diffs = groups.select("channel", "product", F.col("occurrence_count").alias("n_docs"), F.lit("").alias("document"), F.lit("Different").alias("status"),
                          F.concat(F.lit("P."), F.array_join(F.col("pages").cast("array<string>"), ",")).alias("pages"),
                          flat("old_text").alias("old_text"), flat("new_text").alias("new_text"), F.col("group_key"))
    name = strip_badge(F.regexp_extract(F.coalesce("target_path", "source_path"), r"([^/\\]*)$", 1))
    rest = pairs.where("status <> 'Different'").select("channel", "product", F.lit(1).cast("long"), name, "status", F.lit("P.1"), F.lit(""), F.lit(""), F.lit(""))
    return diffs.union(rest)


CSV_SCHEMA = "channel string, n_docs long, document string, status string, pages string, old_text string, new_text string, product string"


def export_product_csv(rows: DataFrame, path: str) -> None:
    """One folder of CSV files a product: `;`, all values quoted, quotes doubled, line ends as blanks, nulls as empty values.

    Rows meet by product and a product with many rows is split again (adaptive execution), so it is several files and several
    tasks. A product that is null or empty has a folder of its own and comes back as null.
    """
    flat = [F.translate(F.coalesce(c, F.lit("")), "\r\n", "  ").alias(c) if t == "string" and c != "product" else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).hint("rebalance", "product").write.mode("overwrite").partitionBy("product").options(
        sep=";", quote='"', escape='"', quoteAll=True, header=True, emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False).csv(path)


def read_product_csv(spark: SparkSession, path: str, schema: str = CSV_SCHEMA) -> DataFrame:
    """What `export_product_csv` wrote."""
    back = spark.read.schema(schema).options(sep=";", quote='"', escape='"', header=True, enforceSchema=False).csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" and c != "product" else F.col(c) for c, t in back.dtypes])


# --- synthesis ---------------------------------------------------------------------------------------

def synthesis_dataset(blocks: DataFrame, order: list[str]) -> DataFrame:
    """Three levels in one table: channels, their products, and one row for each grouped difference with texts, pages and contexts.

    Channels and products carry their numbers of products, grouped differences and documents; these come from one rollup over
    sums by product. Rows stay rows, so a product of any size is no single value; their documents are a table of their own
    (`synthesis_documents`).
    """
    groups = group_across_documents(blocks, order).join(first_contexts(blocks, GROUP, order), GROUP, "left")
    facts = blocks.select("channel", "product", "pair_id").distinct().select("channel", "product", F.lit(0).alias("d"), F.lit(1).alias("p")).union(
        blocks.select("channel", *GROUP).distinct().select("channel", "product", F.lit(1), F.lit(0)))
    products = facts.groupBy("channel", "product").agg(F.sum("d").alias("d"), F.sum("p").alias("p"))
    totals = products.rollup("channel", "product").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n_products"), F.sum("d").alias("n_differences"), F.sum("p").alias("n_docs")).where("level < 2")
    none = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    heads = totals.select(F.when(F.col("level") == 1, "channel").otherwise("product").alias("level"), "channel", "product", none("row_key"), none("old_text"),
                          none("new_text"), none("contexts"), none("pages"), none("severity", "int"), "n_products", "n_differences", "n_docs")
    rows = groups.select(F.lit("row").alias("level"), "channel", "product", _row_key(), "old_text", "new_text", F.coalesce("contexts", F.lit("")).alias("contexts"),
                         F.concat(F.lit("P."), F.array_join(F.col("pages").cast("array<string>"), ",")).alias("pages"), F.col("severity").cast("int").alias("severity"),
                         F.lit(1).cast("long").alias("n_products"), F.lit(1).cast("long").alias("n_differences"), "n_docs")
    return heads.unionByName(rows)


def synthesis_documents(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row_key, pair_id, document, first_page): the documents that show a grouped difference, each with its first page there."""
    first = blocks.groupBy("channel", *GROUP, "pair_id").agg(F.min("page").cast("int").alias("first_page"))
    return first.join(pairs.select("pair_id", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("document")), "pair_id").select(
        _row_key(), "pair_id", "document", "first_page")


def _row_key() -> Column:
    return row_key(F.concat_ws(" • ", "channel", "product"), F.col("signature")).alias("row_key")


# --- review ------------------------------------------------------------------------------------------

def recount(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Counts and statuses after blocks were taken away; a pair left without any is identical."""
    counts = blocks.groupBy("pair_id").agg(F.count("*").alias("_n"), F.count_if(F.col("severity") == 3).alias("_c"), F.max("severity").alias("_s"))
    out = pairs.join(counts, "pair_id", "left")
    was = F.col("status") == "Different"
    return out.select(*[c for c in pairs.columns if c not in ("status", "diff_count", "critical_count", "max_severity")],
                      F.when(was & F.col("_n").isNull(), "Identical").otherwise(F.col("status")).alias("status"),
                      F.when(was, F.coalesce("_n", F.lit(0))).otherwise(F.col("diff_count")).alias("diff_count"),
                      F.when(was, F.coalesce("_c", F.lit(0))).otherwise(F.col("critical_count")).alias("critical_count"),
                      F.when(was, F.coalesce("_s", F.lit(0))).otherwise(F.col("max_severity")).cast("int").alias("max_severity"))


def approve_differences(blocks: DataFrame, approved: DataFrame) -> DataFrame:
    """Blocks left after approval. `approved`: (product, signature) and, for variant groups, a place to clear."""
    left = blocks.join(approved.select("product", "signature").distinct(), ["product", "signature"], "left_anti")
    zones = approved.where("is_zone").alias("z")
    get = lambda p: (lambda c: F.col(f"{p}.{c}"))
    b = left.alias("b")
    return b.join(zones, (F.col("b.product") == F.col("z.product")) & (F.col("b.page") == F.col("z.page")) & same_spot(get("b"), get("z")), "left_anti")


def apply_text_rule(blocks: DataFrame, rule_signatures: DataFrame) -> DataFrame:
    """Retract blocks by signature (case-insensitive) in all products."""
    return blocks.withColumn("_sig", fold(F.col("signature"))).join(
        rule_signatures.select(fold(F.col("signature")).alias("_sig")).distinct(), "_sig", "left_anti").drop("_sig")


def review_filter(rows: DataFrame, verified: DataFrame, channel: str | None = None, product: str | None = None) -> DataFrame:
    """Difference rows of a channel or product that nobody has verified yet."""
    if channel:
        rows = rows.where(F.col("channel") == channel)
    if product:
        rows = rows.where(F.col("product") == product)
    return rows.join(verified.select("row_key").distinct(), "row_key", "left_anti")


def retest_selection(pairs: DataFrame, selection: DataFrame) -> DataFrame:
    return pairs.join(selection.select("pair_id").distinct(), "pair_id", "left_semi")


def change_breakdown(blocks: DataFrame) -> DataFrame:
    """Counts by product: insertions, deletions, and kinds of content."""
    c = F.col("category")
    return blocks.groupBy("channel", "product").agg(
        F.count_if(F.col("change_type") == 2).alias("inserted"), F.count_if(F.col("change_type") == 1).alias("deleted"),
        F.count_if(F.col("change_type") == 4).alias("modified"), F.count_if(c == "date").alias("dates"),
        F.count_if(c.isin("amount", "rate")).alias("numbers"), F.count_if(c.startswith("text_")).alias("words"))


def diff_pages(unmatched: DataFrame) -> DataFrame:
    """Distinct pages per pair with an unmatched token on either side."""
    pages = unmatched.select("pair_id", "page").distinct()
    return pages.groupBy("pair_id").agg(F.sort_array(F.collect_set("page")).alias("pages"))
