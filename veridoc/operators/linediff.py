"""From clean words to changed lines and unmatched tokens of a document pair.

Tables are keyed by `pair_id` and `side` (S or T) and hashed by `pair_id`, so the steps below stay in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from veridoc.operators import kernels as K, pages as P
from veridoc.operators.ranking import rank_in_group
from veridoc.operators.words import dedupe_overprint_words, merge_kerning_and_numbers, sanitizer_lines
from veridoc.session import cut

SIDE = ["pair_id", "side"]
# Lines, or anchors, that one task numbers together.
LINE_BLOCK = 4096


def diff_tokens(words: DataFrame) -> DataFrame:
    """Words -> clean tokens with their line: compound words split, punctuation dropped, overprints and splits repaired.

    Adds `line_no` (per page), `line_idx` (0.. per document side) and `idx` (0.. per line).
    """
    part = lambda fields: [f for f in fields if f.name not in ("text", "is_masked")] + [
        T.StructField("sub", T.IntegerType()), T.StructField("text", T.StringType())]
    # A part starts in proportion to its place in the word; words that end empty go.
    w = sanitizer_lines(P.with_step(words, SIDE, P.split_words, part), SIDE)
    w = merge_kerning_and_numbers(dedupe_overprint_words(w, SIDE), SIDE, ["pos", "sub", "font_size"])
    added = [T.StructField("line_idx", T.IntegerType()), T.StructField("idx", T.IntegerType())]
    return P.with_step(w, SIDE, P.numbered, lambda fields: [*fields, *added])


def token_lines(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(*SIDE, "line_idx", "page", "line_no").agg(
        F.expr("listagg(text, ' ') within group (order by idx)").alias("line_text"),
        F.min_by("y0", "idx").alias("y"), F.count("*").alias("n"))


def text_hashes(lines: DataFrame) -> DataFrame:
    """One SHA-256 per document side: equal texts need no diff."""
    return lines.groupBy(*SIDE).agg(F.sha2(F.expr("listagg(line_text, '\n') within group (order by line_idx)"), 256).alias("digest"))


def common_line_counts(lines: DataFrame) -> DataFrame:
    """Order-free prefilter: lines of a pair that only one side holds (multiset difference), and common ones."""
    per_text = lines.groupBy("pair_id", "line_text").agg(
        F.count_if(F.col("side") == "S").alias("s"), F.count_if(F.col("side") == "T").alias("t"))
    return per_text.groupBy("pair_id").agg(
        F.sum(F.greatest(F.col("s") - F.col("t"), F.lit(0))).alias("only_source"),
        F.sum(F.greatest(F.col("t") - F.col("s"), F.lit(0))).alias("only_target"),
        F.sum(F.least("s", "t")).alias("common"))


def line_diff(lines: DataFrame, cells: int | None = None) -> DataFrame:
    """Changed rows of the side-by-side diff: (pair_id, row, s_line, t_line, kind).

    Every pair, whatever its size, travels to the kernel as one array of 64-bit hashes per side, unless both are equal, and is aligned
    as a whole. Only a caller that gives `cells` has pairs whose table of lines against lines has more fields cut at anchors
    first, so that they become many rows, see `anchored_rows`; such alignments need not be longest ones.
    """
    hashes = lines.select(*SIDE, "line_idx", F.xxhash64("line_text").alias("h"))
    whole = lambda h: _line_arrays(h, ["pair_id"]).where("s <> t").select(
        "pair_id", F.lit(0).alias("base"), F.lit(0).alias("s0"), F.lit(0).alias("t0"), K.changed_rows("s", "t").alias("r"))
    if cells is None:
        flat = whole(hashes)
    else:
        h = cut(hashes)
        n = lambda s: F.count_if(F.col("side") == s)
        long = h.groupBy("pair_id").agg((n("S") * n("T")).alias("table")).where(F.col("table") > cells).select("pair_id")
        flat = whole(h.join(long, "pair_id", "left_anti"))
        if not long.isEmpty():
            flat = flat.unionByName(anchored_rows(h.join(long, "pair_id", "left_semi")))
    rows = flat.where("size(r) > 0").select("pair_id", "base", "s0", "t0", F.explode(F.expr("sequence(0, size(r) div 3 - 1)")).alias("k"), "r")
    pick = lambda j: F.element_at("r", (F.col("k") * 3 + j + 1).cast("int"))
    line = lambda c, first: F.when(c >= 0, c + F.col(first)).cast("int")
    return rows.select("pair_id", (pick(0) + F.col("base")).cast("int").alias("row"), line(pick(1), "s0").alias("s_line"),
                       line(pick(2), "t0").alias("t_line")).withColumn(
        "kind", F.when(F.col("t_line").isNull(), "deleted").when(F.col("s_line").isNull(), "inserted").otherwise("modified"))


def _line_arrays(h: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Hashes of both sides in line order, one row per key; a side without lines has an empty array."""
    return h.groupBy(*keys).agg(*[F.transform(F.sort_array(F.collect_list(F.when(
        F.col("side") == s, F.struct("line_idx", "h")))), lambda x: x["h"]).alias(s.lower()) for s in ("S", "T")], *more)


def anchors(h: DataFrame, limit: int | None = None) -> DataFrame:
    """(pair_id, s_line, t_line): lines that occur once on either side, as many as lie in the same order on both.

    Anchors that follow each other on both sides form a run, found by equi-joins on their ranks; the longest increasing chain
    of anchors is then the heaviest chain of runs, so only the runs of a pair meet in one task, one for each moved passage.
    """
    one = lambda s: F.min(F.when(F.col("side") == s, F.col("line_idx"))).alias(f"{s.lower()}_line")
    count = lambda s: F.count_if(F.col("side") == s)
    once = h.groupBy("pair_id", "h").agg(one("S"), one("T"), count("S").alias("ns"), count("T").alias("nt")).where("ns = 1 and nt = 1")
    once = cut(once.select("pair_id", "s_line", "t_line"))
    ranked = rank_in_group(once, ["pair_id"], [F.col("s_line")], "sr", limit)
    ranked = cut(rank_in_group(ranked, ["pair_id"], [F.col("t_line")], "tr", limit)).withColumn("shift", F.col("tr") - F.col("sr"))
    beside = lambda step, name: ranked.select("pair_id", (F.col("sr") + step).alias("sr"), F.col("shift").alias(name))
    edges = ranked.join(beside(1, "before"), ["pair_id", "sr"], "left").join(beside(-1, "after"), ["pair_id", "sr"], "left")
    first, last = ~F.col("before").eqNullSafe(F.col("shift")), ~F.col("after").eqNullSafe(F.col("shift"))
    edges = cut(edges.select("pair_id", "sr", "tr", first.alias("first"), last.alias("last")).where("first or last"))
    # Runs are intervals of the source order: the k-th start belongs to the k-th end.
    k = F.row_number().over(W.partitionBy("pair_id").orderBy("sr"))
    runs = edges.where("first").select("pair_id", "sr", "tr", k.alias("k")).join(
        edges.where("last").select("pair_id", F.col("sr").alias("end"), k.alias("k")), ["pair_id", "k"])
    runs = runs.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("sr", "end", "tr"))).alias("runs"))
    kept = runs.select("pair_id", "runs", F.explode(K.chained_runs(
        F.transform("runs", lambda r: r["tr"]), F.transform("runs", lambda r: r["end"] - r["sr"] + 1))).alias("i"))
    kept = kept.select("pair_id", F.element_at("runs", F.col("i") + 1).alias("run"))
    # A run covers blocks of ranks, and an anchor looks at the runs of its block only.
    block = lambda c: F.floor(F.col(c) / LINE_BLOCK)
    kept = kept.select("pair_id", F.col("run.sr").alias("a"), F.col("run.end").alias("z")).select(
        "pair_id", "a", "z", F.explode(F.sequence(block("a"), block("z"))).alias("block"))
    return ranked.withColumn("block", block("sr")).join(kept, ["pair_id", "block"]).where("sr between a and z").select(
        "pair_id", "s_line", "t_line")


def anchored_rows(h: DataFrame, limit: int | None = None) -> DataFrame:
    """Diff of long pairs in pieces: (pair_id, base, s0, t0, r) as the kernel gives them, one row for each stretch between anchors.

    Anchors are equal lines; the lines between two of them are aligned for themselves. `base` is the row of the side-by-side
    layout where the stretch starts, s0 and t0 its first lines. All steps are keyed by pair and block of lines.
    """
    found = cut(anchors(h, limit))
    marks = found.select("pair_id", F.lit("S").alias("side"), F.col("s_line").alias("line_idx")).union(
        found.select("pair_id", F.lit("T"), "t_line")).withColumn("anchor", F.lit(1))
    marked = h.join(marks, [*SIDE, "line_idx"], "left").withColumn("block", F.floor(F.col("line_idx") / LINE_BLOCK))
    marked = cut(marked.withColumn("anchor", F.coalesce("anchor", F.lit(0))))
    ahead = W.partitionBy(*SIDE).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = marked.groupBy(*SIDE, "block").agg(F.sum("anchor").alias("held")).select(
        *SIDE, "block", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("start"))
    here = F.sum("anchor").over(W.partitionBy(*SIDE, "block").orderBy("line_idx").rowsBetween(W.unboundedPreceding, 0))
    between = marked.withColumn("here", here).join(starts, [*SIDE, "block"]).where("anchor = 0").withColumn(
        "part", F.col("start") + F.col("here"))
    low = lambda s: F.coalesce(F.min(F.when(F.col("side") == s, F.col("line_idx"))), F.lit(0)).alias(f"{s.lower()}0")
    parts = _line_arrays(between, ["pair_id", "part"], low("S"), low("T"))
    parts = cut(parts.select("pair_id", "part", "s0", "t0", F.size("s").alias("n"), K.changed_rows("s", "t").alias("r")))
    # Rows of a stretch: changed ones and the source lines that are not among them.
    rows = F.size("r") / 3 + F.col("n") - F.size(F.filter("r", lambda x, i: (i % 3 == 1) & (x >= 0)))
    over = W.partitionBy("pair_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = F.col("part") + F.coalesce(F.sum("rows").over(over), F.lit(0))
    placed = parts.select("pair_id", "part", rows.cast("long").alias("rows")).withColumn("base", base.cast("int")).drop("rows")
    return parts.join(placed, ["pair_id", "part"]).select("pair_id", "base", F.col("s0").cast("int").alias("s0"), F.col("t0").cast("int").alias("t0"), "r")


def changed_tokens_of_lines(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """Tokens of changed lines with the diff row they stand on and the kind of the row."""
    where = rows.select("pair_id", F.lit("S").alias("side"), F.col("s_line").alias("line_idx"), "row", "kind").where("line_idx is not null").union(
        rows.select("pair_id", F.lit("T").alias("side"), F.col("t_line").alias("line_idx"), "row", "kind").where("line_idx is not null"))
    return tokens.join(where, [*SIDE, "line_idx"]).select(
        *SIDE, "row", "idx", "kind", "page", "line_idx", "text", "x0", "x1", "y0", "y1", "font_size", "pos")


def loose_tokens(tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """Tokens of lines without an equal line on the other side (multiset difference, order-free): the `row` is the line."""
    k = F.row_number().over(W.partitionBy("pair_id", "side", "line_text").orderBy("line_idx"))
    n = F.count("*").over(W.partitionBy("pair_id", "line_text", "k"))
    odd = lines.withColumn("k", k).withColumn("n", n).where("n = 1").select(*SIDE, "line_idx")
    return tokens.join(odd, [*SIDE, "line_idx"], "left_semi").withColumn("row", F.col("line_idx"))


def facing_tokens(tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """Tokens of lines that differ from the line with the same number on the other side."""
    other = F.when(F.count("*").over(W.partitionBy("pair_id", "line_idx")) == 2,
                   F.min("line_text").over(W.partitionBy("pair_id", "line_idx")) == F.max("line_text").over(W.partitionBy("pair_id", "line_idx")))
    odd = lines.withColumn("same", F.coalesce(other, F.lit(False))).where("not same").select(*SIDE, "line_idx")
    return tokens.join(odd, [*SIDE, "line_idx"], "left_semi").withColumn("row", F.col("line_idx"))


def inline_lcs(toks: DataFrame) -> DataFrame:
    """Unmatched tokens: words common to both lines of a modified row are settled at once.

    Lines equal without blanks settle as a whole; otherwise the longest common word sequence counts when the lines
    lie on one page (within 60 points, or two common words) or on adjacent pages (two common words). Then
    two neighbouring words on one side settle with their joined form on the other.
    """
    faced = toks.where("kind = 'modified'").groupBy("pair_id", "row").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("idx", "text", "page", "y0")))).alias(s) for s in ("S", "T")])
    words = lambda s: F.transform(s, lambda x: x["text"])
    hashes = lambda s: F.transform(s, lambda x: F.xxhash64(x["text"]))
    first = lambda s, f: F.element_at(s, 1)[f]
    faced = faced.withColumn("same", F.array_join(words("S"), "") == F.array_join(words("T"), "")).withColumn(
        "hs", hashes("S")).withColumn("ht", hashes("T"))
    faced = faced.withColumn("m", K.common_words(F.when(F.col("same"), F.array().cast("array<bigint>")).otherwise(F.col("hs")),
                                                 F.when(F.col("same"), F.array().cast("array<bigint>")).otherwise(F.col("ht"))))
    gap = F.abs(first("S", "page") - first("T", "page"))
    n = F.size("m") / 2
    near = ((gap == 0) & ((F.abs(first("S", "y0") - first("T", "y0")) <= 60.0) | (n >= 2))) | ((gap == 1) & (n >= 2))
    every = lambda s: F.transform(s, lambda x: x["idx"])
    hit = lambda s, odd: F.when(F.col("same"), every(s)).when(near, F.transform(
        F.filter("m", lambda x, i: i % 2 == odd), lambda k: k)).otherwise(F.array().cast("array<int>"))
    done = faced.select("pair_id", "row", near.alias("near"), F.explode(F.array(
        F.struct(F.lit("S").alias("side"), hit("S", 0).alias("hit")), F.struct(F.lit("T").alias("side"), hit("T", 1).alias("hit")))).alias("d"))
    done = done.select("pair_id", "row", "near", "d.side", "d.hit")
    left = toks.join(done, ["pair_id", "row", "side"], "left").where("hit is null or not array_contains(hit, idx)").drop("hit")
    return left


def joined_fragments(left: DataFrame) -> DataFrame:
    """Drop two neighbouring words of a modified line that equal one word of the facing line."""
    line = W.partitionBy(*SIDE, "row").orderBy("idx")
    nxt = F.when(F.lead("idx").over(line) == F.col("idx") + 1, F.lead("text").over(line))
    two = left.withColumn("nxt", nxt).where("near and nxt is not null").select(
        *SIDE, "row", "idx", F.concat("text", "nxt").alias("key"))
    one = left.where("near").select("pair_id", "row", "side", F.col("idx").alias("o_idx"), F.col("text").alias("key"))
    other = one.withColumn("side", F.when(F.col("side") == "S", "T").otherwise("S"))
    edge = two.join(other, ["pair_id", "row", "side", "key"])
    edge = edge.withColumn("r1", F.row_number().over(W.partitionBy(*SIDE, "row", "idx").orderBy("o_idx"))).where("r1 = 1")
    edge = edge.withColumn("r2", F.row_number().over(W.partitionBy(*SIDE, "row", "o_idx").orderBy("idx"))).where("r2 = 1")
    used = edge.select(*SIDE, "row", F.explode(F.expr("array(idx, idx + 1)")).alias("idx")).union(
        edge.select("pair_id", F.when(F.col("side") == "S", "T").otherwise("S").alias("side"), "row", F.col("o_idx").alias("idx")))
    return left.join(used.distinct(), [*SIDE, "row", "idx"], "left_anti")


def page_similarity(words: DataFrame) -> DataFrame:
    """Jaccard of the word sets of pages of a pair that share a word: (pair_id, sp, tp, sim)."""
    sets = words.select("pair_id", "side", "page", F.upper("text").alias("tok")).distinct()
    size = sets.groupBy("pair_id", "side", "page").agg(F.count("*").alias("n"))
    s = sets.where("side = 'S'").select("pair_id", "tok", F.col("page").alias("sp"))
    t = sets.where("side = 'T'").select("pair_id", "tok", F.col("page").alias("tp"))
    inter = s.join(t, ["pair_id", "tok"]).groupBy("pair_id", "sp", "tp").agg(F.count("*").alias("i"))
    n = lambda side, page, name: size.where(F.col("side") == side).select("pair_id", F.col("page").alias(page), F.col("n").alias(name))
    return inter.join(n("S", "sp", "ns"), ["pair_id", "sp"]).join(n("T", "tp", "nt"), ["pair_id", "tp"]).select(
        "pair_id", "sp", "tp", (F.col("i") / (F.col("ns") + F.col("nt") - F.col("i"))).alias("sim"))


def align_pages(words: DataFrame) -> DataFrame:
    """(pair_id, sp, tp): pages side by side; a page without a partner is a structural difference (severity 3)."""
    n = words.groupBy("pair_id").agg(*[F.coalesce(F.max(F.when(F.col("side") == s, F.col("page"))), F.lit(0)).alias(f"n_{s}") for s in ("S", "T")])
    # Similarities only matter where the page counts differ.
    uneven = words.join(n.where("n_S <> n_T").select("pair_id"), "pair_id", "left_semi")
    sims = page_similarity(uneven).groupBy("pair_id").agg(F.collect_list(F.struct("sp", "tp", "sim")).alias("l"))
    rows = n.join(sims, "pair_id", "left").withColumn("l", F.coalesce("l", F.array().cast("array<struct<sp:int,tp:int,sim:double>>")))
    out = rows.select("pair_id", F.explode(K.aligned_pages("n_S", "n_T", F.col("l.sp"), F.col("l.tp"), F.col("l.sim"))).alias("p"))
    page = lambda f: F.when(F.col(f"p.{f}") > 0, F.col(f"p.{f}"))
    return out.select("pair_id", page("s").alias("sp"), page("t").alias("tp"),
                      F.when((F.col("p.s") == 0) | (F.col("p.t") == 0), 3).otherwise(0).alias("severity"))


def tokens_in_regions(toks: DataFrame, regions: DataFrame, margin: float = 12.0) -> DataFrame:
    """Tokens whose box, widened by the margin, touches a region of the same page."""
    t, r = toks.alias("t"), regions.alias("r")
    touch = ((F.col("t.pair_id") == F.col("r.pair_id")) & (F.col("t.page") == F.col("r.page"))
             & (F.col("t.x0") - margin <= F.col("r.x1")) & (F.col("t.x1") + margin >= F.col("r.x0"))
             & (F.col("t.y0") - margin <= F.col("r.y1")) & (F.col("t.y1") + margin >= F.col("r.y0")))
    return t.join(r, touch, "left_semi")


def mark_changed_letters(letters: DataFrame, changed: DataFrame) -> DataFrame:
    """Letters with `changed`: does an unmatched letter lie at the same page and rounded place?"""
    key = lambda df: df.withColumn("_x", F.bround("x", 1)).withColumn("_y", F.bround("y", 1))
    hit = key(changed).select(*SIDE, "page", "_x", "_y").distinct().withColumn("_hit", F.lit(True))
    return key(letters).join(hit, [*SIDE, "page", "_x", "_y"], "left").withColumn(
        "changed", F.coalesce("_hit", F.lit(False))).drop("_hit", "_x", "_y")
