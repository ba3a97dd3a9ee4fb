"""Difference blocks: changed tokens -> changed lines -> clusters -> typed, classified, verified blocks.

`change_type` codes: 1 deleted, 2 inserted, 4 modified. Severity: 1 minor, 2 major, 3 critical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veridoc.functions.amounts import classify
from veridoc.functions.text import clean_word, fold
from veridoc.operators.kernels import common_words
from veridoc.session import cut

SIDE = ["pair_id", "side"]


def diff_key_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def signature(change: Column, old: Column, new: Column) -> Column:
    return F.concat_ws("|", change.cast("string"), diff_key_text(old), diff_key_text(new))


def row_key(product_key: Column, sig: Column, zone: Column | None = None) -> Column:
    """16 hex digits; `zone` (page|column|height steps) replaces the signature for groups of variants."""
    tail = sig if zone is None else F.coalesce(F.concat(F.lit("ZONE|"), zone), sig)
    return F.upper(F.substring(F.sha2(F.concat_ws("|", product_key, tail), 256), 1, 16))


# --- lines and clusters -----------------------------------------------------------------------------

def changed_lines(tokens: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Lines with a change: changed words only, the words around them, tight box and field box.

    Context: up to 5 words before the first change and 4 after the last one; without words before it on
    the line, the last 4 words of the line above. The field box spans the columns (gaps of 22 points or
    more) that hold a change, plus a margin to the right.
    """
    marks = unmatched.select(*SIDE, "line_idx", "idx").distinct().withColumn("hit", F.lit(True))
    w = tokens.join(marks, [*SIDE, "line_idx", "idx"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    line = W.partitionBy(*SIDE, "line_idx").orderBy("idx")
    far = F.col("x0") - F.lag("x1").over(line) >= 22.0
    w = w.withColumn("col", F.sum(F.when(far, 1).otherwise(0)).over(line.rowsBetween(W.unboundedPreceding, 0)))
    item = F.struct("idx", "text", "hit", "col", "x0", "x1", "y0", "y1")
    lines = w.groupBy(*SIDE, "line_idx", "page").agg(F.sort_array(F.collect_list(item)).alias("ws"), F.max(F.col("hit").cast("int")).alias("any"),
                                                     F.min_by("y0", "idx").alias("y"))
    texts = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), " ")
    above = F.lag("ws").over(W.partitionBy(*SIDE, "page").orderBy("line_idx"))
    last4 = texts(F.slice("above", F.greatest(F.size("above") - 3, F.lit(1)), 4))
    lines = lines.withColumn("above", above).where("any = 1")
    hits = F.filter("ws", lambda x: x["hit"])
    lines = lines.withColumn("hits", hits)
    at = lambda k, f: F.element_at("hits", k)[f]
    before = F.filter("ws", lambda x: x["idx"] < F.element_at("hits", 1)["idx"])
    after = F.filter("ws", lambda x: x["idx"] > F.element_at("hits", -1)["idx"])
    lines = lines.withColumn("before", before).withColumn("after", after)
    cols = F.filter("ws", lambda x: (x["col"] >= F.element_at("hits", 1)["col"]) & (x["col"] <= F.element_at("hits", -1)["col"]))
    nxt = F.try_element_at(F.filter("ws", lambda x: x["col"] > F.element_at("hits", -1)["col"]), F.lit(1))["x0"]
    low = lambda a, f: F.array_min(F.transform(a, lambda x: x[f]))
    high = lambda a, f: F.array_max(F.transform(a, lambda x: x[f]))
    lines = lines.withColumn("cols", cols).withColumn("nxt", nxt)
    right = F.when(F.col("nxt").isNotNull(), F.least(high("cols", "x1") + 10.0, (high("cols", "x1") + F.col("nxt")) * 0.5)).otherwise(
        F.greatest(high("cols", "x1") + 18.0, F.least(F.lit(566.0), low("cols", "x0") + 320.0)))
    f_left = F.greatest(F.lit(0.0), low("cols", "x0") - 3.0)
    return lines.select(
        *SIDE, "line_idx", "page", "y", texts(F.col("hits")).alias("diff_text"),
        F.when(F.size("before") > 0, texts(F.slice("before", F.greatest(F.size("before") - 4, F.lit(1)), 5))).otherwise(
            F.coalesce(last4, F.lit(""))).alias("context_before"),
        texts(F.slice("after", 1, 4)).alias("context_after"),
        low("hits", "x0").alias("left"), low("hits", "y0").alias("bottom"), high("hits", "x1").alias("right"), high("hits", "y1").alias("top"),
        f_left.alias("f_left"), F.greatest(F.lit(0.0), low("cols", "y0") - 2.5).alias("f_bottom"),
        F.greatest(f_left + 10.0, right).alias("f_right"), (high("cols", "y1") + 2.5).alias("f_top"))


BOX = ["left", "bottom", "right", "top", "f_left", "f_bottom", "f_right", "f_top"]


def diff_clusters(lines: DataFrame) -> DataFrame:
    """Consecutive changed lines of a page (next line, or within 34 points) form one cluster."""
    page = W.partitionBy(*SIDE, "page").orderBy("line_idx")
    near = (F.col("line_idx") <= F.lag("line_idx").over(page) + 1) | (F.abs(F.lag("y").over(page) - F.col("y")) <= 34.0)
    w = lines.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn(
        "cluster", F.sum("_new").over(page.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    agg = [F.min(c).alias(c) if c.endswith(("left", "bottom")) else F.max(c).alias(c) for c in BOX]
    return w.groupBy(*SIDE, "page", "cluster").agg(
        F.expr("listagg(diff_text, '\n') within group (order by line_idx)").alias("diff_text"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.min_by("context_before", "line_idx").alias("context_before"), F.max_by("context_after", "line_idx").alias("context_after"), *agg)


def pair_clusters(clusters: DataFrame) -> DataFrame:
    """Source clusters take the target clusters at their height; leftovers are deletions and insertions.

    Each target cluster goes to the first source cluster (reading order) within reach.
    """
    s, t = clusters.where("side = 'S'").drop("side"), clusters.where("side = 'T'").drop("side")
    sk = s.select("pair_id", "page", F.col("cluster").alias("s_c"), F.col("min_y").alias("s_lo"), F.col("max_y").alias("s_hi"))
    reach = t.join(sk, ["pair_id", "page"]).where(
        "(s_lo - 48 <= max_y and min_y - 48 <= s_hi) or abs((s_lo + s_hi) / 2 - (min_y + max_y) / 2) <= 55")
    owner = reach.groupBy("pair_id", "page", "cluster").agg(F.min("s_c").alias("s_c"))
    owned = t.join(owner, ["pair_id", "page", "cluster"], "left")
    boxes = [F.min(c).alias(f"t_{c}") if c.endswith(("left", "bottom")) else F.max(c).alias(f"t_{c}") for c in BOX]
    targets = owned.where("s_c is not null").groupBy("pair_id", "page", F.col("s_c").alias("cluster")).agg(
        F.expr("listagg(diff_text, '\n') within group (order by cluster)").alias("new_text"), *boxes)
    both = s.join(targets, ["pair_id", "page", "cluster"], "left")
    close = F.abs((F.col("f_bottom") + F.col("f_top")) / 2 - (F.col("t_f_bottom") + F.col("t_f_top")) / 2) <= 22.0
    # Far apart in height (text above has grown): the target's box, with the common width of the field.
    def box(c):
        pick = F.least if c.endswith(("left", "bottom")) else F.greatest
        wide = c in ("f_left", "f_right")
        return F.when(F.col("t_left").isNull(), F.col(c)).when(close | F.lit(wide), pick(F.col(c), F.col(f"t_{c}"))).otherwise(F.col(f"t_{c}")).alias(c)
    out = both.select("pair_id", "page", F.lit(0).alias("part"), "cluster", F.col("diff_text").alias("old_text"), F.coalesce("new_text", F.lit("")).alias("new_text"),
                      "context_before", "context_after", *[box(c) for c in BOX])
    extra = owned.where("s_c is null").select("pair_id", "page", F.lit(1).alias("part"), "cluster", F.lit("").alias("old_text"), F.col("diff_text").alias("new_text"),
                                              "context_before", "context_after", *BOX)
    return out.unionByName(extra)


# --- texts of a block ----------------------------------------------------------------------------------

def words_of(text: Column) -> Column:
    """Words split on any blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def changed_tokens(old: Column, new: Column) -> Column:
    """Normalised word tokens whose counts differ between the two texts (each once, sorted)."""
    toks = lambda t: F.filter(F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), 1), clean_word), lambda x: x != "")
    a, b = toks(old), toks(new)
    both = F.array_distinct(F.concat(a, b))
    # Counts come from positions in the sorted lists, so nothing is counted more than once per word.
    sa, sb = F.array_sort(a), F.array_sort(b)
    n = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    return F.array_sort(F.filter(both, lambda x: n(sa, x) != n(sb, x)))


def trim_common_affixes(blocks: DataFrame) -> DataFrame:
    """Move equal leading and trailing words of the two texts into the context (5 words before, 4 after)."""
    same = lambda x, y: F.coalesce((clean_word(x) == clean_word(y)) & (clean_word(x) != ""), F.lit(False))
    def head(a, b):
        stop = F.array_position(F.zip_with(a, b, same), False)
        return F.when(F.least(F.size(a), F.size(b)) == 0, 0).when(stop > 0, stop - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")
    b = blocks.withColumn("_o", words_of(F.col("old_text"))).withColumn("_n", words_of(F.col("new_text")))
    b = b.withColumn("_p", head(F.col("_o"), F.col("_n")))
    rest = lambda a, k: F.when(F.size(a) > k, F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    b = b.withColumn("_pre", F.slice("_o", F.lit(1), F.col("_p"))).withColumn("_o2", rest(F.col("_o"), F.col("_p"))).withColumn("_n2", rest(F.col("_n"), F.col("_p")))
    b = b.withColumn("_s", head(F.reverse("_o2"), F.reverse("_n2")))
    keep = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - F.col("_s"), F.lit(0)))
    tail = F.when(F.col("_s") > 0, F.slice("_o2", F.size("_o2") - F.col("_s") + 1, F.greatest(F.col("_s"), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    before = F.concat(words_of(F.col("context_before")), F.col("_pre"))
    b = b.withColumn("_before", before).withColumn("_after", F.concat(tail, words_of(F.col("context_after"))))
    return b.withColumn("old_words", keep(F.col("_o2"))).withColumn("new_words", keep(F.col("_n2"))).withColumn(
        "context_before", F.array_join(F.slice("_before", F.greatest(F.size("_before") - 4, F.lit(1)), 5), " ")).withColumn(
        "context_after", F.array_join(F.slice("_after", 1, 4), " ")).withColumn(
        "old_text", F.array_join("old_words", " ")).withColumn("new_text", F.array_join("new_words", " ")).drop(
        "_o", "_n", "_p", "_pre", "_o2", "_n2", "_s", "_before", "_after")


def collapse_unchanged_middle(blocks: DataFrame, longest: int | None = None) -> DataFrame:
    """Runs of two or more common words inside texts of 3 words or more become an ellipsis; `longest` limits the words."""
    fits = lambda words: (F.size(words) >= 3) & (F.lit(True) if longest is None else F.size(words) <= longest)
    inside = fits("old_words") & fits("new_words")
    # Words that are empty after cleaning never match: they hash to values that differ by side.
    h = lambda a, side: F.transform(a, lambda x: F.when(clean_word(x) == "", F.xxhash64(F.lit(side))).otherwise(F.xxhash64(clean_word(x))))
    none = F.array().cast("array<bigint>")
    b = blocks.withColumn("_m", common_words(F.when(inside, h("old_words", "old")).otherwise(none), F.when(inside, h("new_words", "new")).otherwise(none)))
    def short(words, odd):
        common = F.filter("_m", lambda x, i: i % 2 == odd)
        here = lambda i: F.array_contains(common, i)
        out = F.transform(words, lambda w, i: F.when(here(i) & (here(i - 1) | here(i + 1)), "\u0001").otherwise(w))
        text = F.regexp_replace(F.array_join(out, " "), "\u0001(?: \u0001)*", "…")
        return F.regexp_replace(text, "^… ?", "")
    big = F.size("_m") >= 4
    return b.withColumn("old_text", F.when(big, short(F.col("old_words"), 0)).otherwise(F.col("old_text"))).withColumn(
        "new_text", F.when(big, short(F.col("new_words"), 1)).otherwise(F.col("new_text"))).drop("_m")


def verify_blocks(blocks: DataFrame, critical: str, sanitize=None) -> DataFrame:
    """Texts cleaned by rules, common words trimmed; blocks without a real change or of equal numeric value drop out."""
    if sanitize is not None:
        blocks = blocks.withColumn("old_text", sanitize(F.col("old_text"))).withColumn("new_text", sanitize(F.col("new_text")))
    # Blocks are few. They are stored between the steps, because a filter pushed down through this chain of
    # text expressions would repeat all of them in every predicate.
    b = cut(trim_common_affixes(cut(blocks)))
    b = cut(collapse_unchanged_middle(b).drop("old_words", "new_words"))
    b = b.where(clean_word(F.col("old_text")) != clean_word(F.col("new_text"))).withColumn(
        "changed", changed_tokens(F.col("old_text"), F.col("new_text")))
    b = cut(b).where("size(changed) > 0")
    return cut(type_and_classify(b, critical)).where("category not in ('number_format', 'format')").drop("changed")


def type_and_classify(b: DataFrame, critical: str) -> DataFrame:
    old, new = F.trim("old_text") != "", F.trim("new_text") != ""
    b = b.withColumn("change_type", F.when(old & new, 4).when(new, 2).otherwise(1)).withColumn(
        "_c", classify(F.col("change_type"), F.col("old_text"), F.col("new_text"), F.col("changed"), critical))
    b = b.select(*[c for c in b.columns if c not in ("_c", "category", "severity", "delta_text", "signature")], "_c.category", "_c.severity", "_c.delta_text")
    return b.withColumn("signature", signature(F.col("change_type"), F.col("old_text"), F.col("new_text")))


def merge_delete_insert(blocks: DataFrame, critical: str, order: list[str]) -> DataFrame:
    """A deletion followed by an insertion on its page (or on the next page, with shared context) is one modification.

    Blocks are consumed two at a time: inside a run of mergeable neighbours the odd ones merge.
    """
    seq = W.partitionBy("pair_id").orderBy(*order)
    last = lambda c: clean_word(F.try_element_at(words_of(c), F.lit(-1)))
    first = lambda c: clean_word(F.try_element_at(words_of(c), F.lit(1)))
    nx = lambda c: F.lead(c).over(seq)
    b = blocks.withColumn("_i", F.row_number().over(seq)).withColumn("_n", nx(F.struct("page", "change_type", "new_text", "old_text", "context_before", "context_after", *BOX)))
    shared = ((last(F.col("context_before")) == last(F.col("_n.context_before"))) & (last(F.col("context_before")) != "")) | (
        (first(F.col("context_after")) == first(F.col("_n.context_after"))) & (first(F.col("context_after")) != ""))
    de, ins = (F.col("change_type") == 1) & (F.col("_n.change_type") == 2), (F.col("change_type") == 2) & (F.col("_n.change_type") == 1)
    gap = F.abs(F.col("page") - F.col("_n.page"))
    b = b.withColumn("_ok", F.coalesce(((gap == 0) & de) | ((gap == 1) & (de | ins) & F.coalesce(shared, F.lit(False))), F.lit(False)))
    b = b.withColumn("_run", F.col("_i") - F.sum(F.col("_ok").cast("int")).over(seq.rowsBetween(W.unboundedPreceding, 0)))
    in_run = W.partitionBy("pair_id", "_run", "_ok").orderBy("_i")
    b = b.withColumn("_merge", F.col("_ok") & (F.row_number().over(in_run) % 2 == 1)).withColumn("_eaten", F.coalesce(F.lag("_merge").over(seq), F.lit(False)))
    plain = b.where("not _merge and not _eaten").select(*blocks.columns)
    ins_side = F.when(F.col("change_type") == 2, F.struct("page", *BOX)).otherwise(F.struct("_n.page", *[F.col(f"_n.{c}") for c in BOX]))
    close = (gap == 0) & (F.abs((F.col("f_bottom") + F.col("f_top")) / 2 - (F.col("_n.f_bottom") + F.col("_n.f_top")) / 2) <= 22.0)
    m = b.where("_merge").withColumn("_ins", ins_side)
    fold_box = lambda c: F.when(close, (F.least if c.endswith(("left", "bottom")) else F.greatest)(F.col(c), F.col(f"_n.{c}"))).otherwise(F.col(f"_ins.{c}"))
    m = m.withColumn("_old", F.when(de, F.col("old_text")).otherwise(F.col("_n.old_text"))).withColumn("_new", F.when(de, F.col("_n.new_text")).otherwise(F.col("new_text")))
    m = m.where(clean_word(F.col("_old")) != clean_word(F.col("_new")))
    boxes = {c: fold_box(c) for c in BOX}
    own = [c for c in blocks.columns if c not in ("old_text", "new_text", "page", "category", "severity", "delta_text", "signature", "change_type", *BOX)]
    m = m.select(*own, F.col("_old").alias("old_text"), F.col("_new").alias("new_text"), F.col("_ins.page").alias("page"), *[v.alias(c) for c, v in boxes.items()])
    m = cut(m.withColumn("changed", changed_tokens(F.col("old_text"), F.col("new_text")))).where("size(changed) > 0")
    m = cut(type_and_classify(m, critical))
    return plain.unionByName(m.where("category not in ('number_format', 'format')").select(*blocks.columns))


def suppress_by_signature(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop blocks that an enabled rule in scope carries by signature (case-insensitive)."""
    from veridoc.sources.rules import scope_keys
    r = scope_keys(rules.where("is_enabled and coalesce(ignored_signature, '') <> ''")).select(
        fold(F.col("ignored_signature")).alias("_sig"), F.coalesce("scope_key", F.lit("*")).alias("_scope")).distinct()
    b = blocks.withColumn("_sig", fold(F.col("signature")))
    anywhere = b.join(r.where("_scope = '*'"), "_sig", "left_anti")
    return anywhere.withColumn("_scope", F.upper("product")).join(r, ["_sig", "_scope"], "left_anti").drop("_sig", "_scope")


# --- visual blocks ---------------------------------------------------------------------------------------

def line_segments(letters: DataFrame, keys: list[str]) -> DataFrame:
    """Unmatched letters or tokens -> segments of a line: gaps up to max(24, 2.5 x font)."""
    page = W.partitionBy(*keys).orderBy(F.desc("y0"), "x0")
    step = F.lag("y0").over(page) - F.col("y0") > F.greatest(F.lit(4.5), F.col("font_size") * 0.48)
    w = letters.withColumn("_ln", F.sum(F.when(step, 1).otherwise(0)).over(page.rowsBetween(W.unboundedPreceding, 0)))
    line = W.partitionBy(*keys, "_ln").orderBy("x0", "x1")
    gap = F.col("x0") - F.max("x1").over(line.rowsBetween(W.unboundedPreceding, -1))
    w = w.withColumn("_seg", F.sum(F.when(gap > F.greatest(F.lit(24.0), F.col("font_size") * 2.5), 1).otherwise(0)).over(line.rowsBetween(W.unboundedPreceding, 0)))
    return w.groupBy(*keys, "_ln", "_seg").agg(F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.avg("y0").alias("y"), F.max("font_size").alias("font"))


def unified_boxes(letters: DataFrame, keys: list[str], down: float = 0.22, up: float = 0.92, x_reach: float | None = 120.0) -> DataFrame:
    """Segments that follow each other vertically (gap up to max(18, 2.2 x font)) and, with `x_reach`, horizontally."""
    s = line_segments(letters, keys).withColumn("lo", F.col("y") - F.col("font") * down).withColumn("hi", F.col("y") + F.col("font") * up)
    order = W.partitionBy(*keys).orderBy("_ln", "_seg")
    gap = F.lag("lo").over(order) - F.col("hi")
    limit = F.greatest(F.lit(18.0), F.col("font") * 2.2)
    far = (gap > limit) if x_reach is not None else (gap >= limit)
    if x_reach is not None:
        far = far | (F.col("min_x") > F.lag("max_x").over(order) + x_reach) | (F.col("max_x") < F.lag("min_x").over(order) - x_reach)
    s = s.withColumn("_b", F.sum(F.when(far, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(*keys, "_b").agg(F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("lo").alias("min_y"), F.max("hi").alias("max_y")).drop("_b")


def segment_blocks(letters: DataFrame, keys: list[str]) -> DataFrame:
    """Number of vertical blocks of unmatched segments per key: visual insertions or deletions."""
    return unified_boxes(letters, keys, 0.2, 0.9, x_reach=None).groupBy(*keys).agg(F.count("*").alias("n_blocks"))


def text_concordance(changed_letters: Column, total_words: Column) -> Column:
    """1 - changed / max(20, 5 x words), at most 0.999, as a percentage with two digits (half to even)."""
    share = 1.0 - changed_letters / F.greatest(F.lit(20), total_words * 5)
    return F.bround(F.least(F.greatest(share, F.lit(0.0)), F.lit(0.999)) * 100, 2)


def inline_chunks(blocks: DataFrame) -> DataFrame:
    """Word chunks of both texts with a changed flag: `old_chunks`, `new_chunks` as array<struct<text, changed>>."""
    h = lambda a: F.transform(a, lambda x: F.xxhash64(x))
    b = blocks.withColumn("_o", words_of(F.col("old_text"))).withColumn("_n", words_of(F.col("new_text")))
    b = b.withColumn("_m", common_words(h("_o"), h("_n")))
    chunk = lambda a, odd: F.transform(a, lambda x, i: F.struct(x.alias("text"), (~F.array_contains(
        F.filter("_m", lambda y, k: k % 2 == odd), i)).alias("changed")))
    return b.withColumn("old_chunks", chunk("_o", 0)).withColumn("new_chunks", chunk("_n", 1)).drop("_o", "_n", "_m")


def marked_text(chunks: Column, open_tag: str = "[", close_tag: str = "]") -> Column:
    return F.array_join(F.transform(chunks, lambda c: F.when(c["changed"], F.concat(F.lit(open_tag), c["text"], F.lit(close_tag))).otherwise(c["text"])), " ")


def changed_line_parts(letters: DataFrame) -> DataFrame:
    """Words of a line as parts with a changed flag. `letters`: (pair_id, side, page, line_idx, idx, k, ch, changed).

    A partly changed word splits at its first separator, or at its one border between changed and
    unchanged letters; with more borders it stays whole and counts as changed.
    """
    keys = [*SIDE, "page", "line_idx", "idx"]
    ws = letters.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "ch", "changed"))).alias("l"))
    txt = lambda a: F.array_join(F.transform(a, lambda x: x["ch"]), "")
    any_ = lambda a: F.exists(a, lambda x: x["changed"])
    flips = F.size(F.filter(F.sequence(F.lit(2), F.greatest(F.size("l"), F.lit(2))), lambda i: F.coalesce(
        F.try_element_at("l", i)["changed"] != F.try_element_at("l", i - 1)["changed"], F.lit(False))))
    sep = F.array_position(F.transform("l", lambda x: x["ch"].isin(":", ";", "(", ")", "[", "]")), True).cast("int")
    border = (F.array_position(F.transform("l", lambda x: x["changed"] != F.element_at("l", 1)["changed"]), True) - 1).cast("int")
    ws = ws.withColumn("flips", flips).withColumn("sep", sep).withColumn("at", F.when(F.col("flips") == 0, None).when(
        F.col("sep") > 0, F.col("sep")).when(F.col("flips") == 1, border))
    part = lambda a: F.struct(txt(a).alias("text"), any_(a).alias("changed"))
    two = F.array(part(F.slice("l", F.lit(1), F.greatest("at", F.lit(1)))), part(F.slice("l", F.greatest("at", F.lit(1)) + 1, F.size("l"))))
    whole = F.array(F.struct(txt(F.col("l")).alias("text"), any_(F.col("l")).alias("changed")))
    return ws.select(*keys, F.posexplode(F.filter(F.when(F.col("at").isNotNull(), two).otherwise(whole), lambda p: p["text"] != "")).alias("part_no", "p")).select(
        *keys, "part_no", "p.text", "p.changed")
