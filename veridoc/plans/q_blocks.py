"""Blocks, grouping, reports and review over a block table built from facing lines of every pair."""

from pyspark.sql import functions as F

from veridoc.functions.amounts import CRITICAL_WORDS, classify, critical_pattern
from veridoc.operators import blocks as B, grouping as G, linediff as L, reports as P
from veridoc.plans.oracle import cte, with_
from veridoc.plans.q_diff import facing, tokens
from veridoc.plans.q_text import tax_pairs
from veridoc.plans.registry import query
from veridoc.session import cut, written
from veridoc.sources import corpus

BOX = G.BOX


def block_table(spark, sf_dir):
    """One block per line number whose text differs between the two sides of a pair."""
    t = tokens(spark, sf_dir)
    lines = t.groupBy("pair_id", "side", "line_idx").agg(
        F.expr("listagg(text, ' ') within group (order by idx)").alias("x"), F.min("page").alias("page"),
        F.min("x0").alias("l"), F.min("y0").alias("b"), F.max("x1").alias("r"), F.max("y1").alias("t"))
    both = lines.groupBy("pair_id", F.col("line_idx").alias("seq")).agg(*[F.max(F.when(F.col("side") == s, F.struct("x", "page", "l", "b", "r", "t"))).alias(s) for s in ("S", "T")])
    both = both.where("S is null or T is null or S.x <> T.x").withColumn("w", F.coalesce("T", "S"))
    old, new = F.coalesce("S.x", F.lit("")), F.coalesce("T.x", F.lit(""))
    change = F.when(F.col("S").isNull(), 2).when(F.col("T").isNull(), 1).otherwise(4)
    digit = F.concat(old, new).rlike("[0-9]")
    meta = corpus.files(spark, sf_dir, "T").select(F.col("doc_id").alias("pair_id"), "product", "channel")
    out = both.select("pair_id", "seq", change.alias("change_type"), old.alias("old_text"), new.alias("new_text"), F.col("w.page").alias("page"),
                      F.when(digit, 3).otherwise(2).alias("severity"), F.when(digit, "amount").otherwise("text_changed").alias("category"),
                      F.when(digit, F.substring(new, 1, 5)).otherwise("").alias("delta_text"), F.substring(old, 1, 4).alias("context_before"), F.lit("").alias("context_after"),
                      F.col("w.l").alias("left"), F.col("w.b").alias("bottom"), F.col("w.r").alias("right"), F.col("w.t").alias("top"),
                      (F.col("w.l") - 3.0).alias("f_left"), (F.col("w.b") - 2.5).alias("f_bottom"), (F.col("w.r") + 18.0).alias("f_right"), (F.col("w.t") + 2.5).alias("f_top"))
    out = out.withColumn("signature", B.signature(F.col("change_type"), F.col("old_text"), F.col("new_text")))
    return written(out.join(meta, "pair_id"))


cte("pbox", "SELECT doc_id, side, line_idx, string_agg(text, ' ' ORDER BY idx) AS x, min(page) AS page, min(x0) AS l, min(y0) AS b, max(x1) AS r, max(y1) AS t FROM ptok GROUP BY ALL", "ptok")
cte("blocks", r"""SELECT pair_id, seq, change_type, old_text, new_text, page, CASE WHEN digit THEN 3 ELSE 2 END AS severity, CASE WHEN digit THEN 'amount' ELSE 'text_changed' END AS category,
  CASE WHEN digit THEN substr(new_text, 1, 5) ELSE '' END AS delta_text, substr(old_text, 1, 4) AS context_before, '' AS context_after, l AS "left", b AS bottom, r AS "right", t AS top,
  l - 3 AS f_left, b - 2.5 AS f_bottom, r + 18 AS f_right, t + 2.5 AS f_top, change_type || '|' || old_text || '|' || new_text AS signature, product, channel FROM (
  SELECT coalesce(s.doc_id, t.doc_id) AS pair_id, coalesce(s.line_idx, t.line_idx) AS seq, CASE WHEN s.x IS NULL THEN 2 WHEN t.x IS NULL THEN 1 ELSE 4 END AS change_type,
    coalesce(s.x, '') AS old_text, coalesce(t.x, '') AS new_text, coalesce(t.page, s.page) AS page, regexp_matches(coalesce(s.x, '') || coalesce(t.x, ''), '[0-9]') AS digit,
    coalesce(t.l, s.l) AS l, coalesce(t.b, s.b) AS b, coalesce(t.r, s.r) AS r, coalesce(t.t, s.t) AS t
  FROM (SELECT * FROM pbox WHERE side = 'S') s FULL JOIN (SELECT * FROM pbox WHERE side = 'T') t ON s.doc_id = t.doc_id AND s.line_idx = t.line_idx
  WHERE s.x IS NULL OR t.x IS NULL OR s.x <> t.x) JOIN (SELECT doc_id AS pair_id, product, channel FROM docs WHERE side = 'T') USING (pair_id)""", "pbox", "docs")


@query("h10_classify_block", with_(r"""SELECT l_orderkey, l_linenumber, CASE WHEN flag = 'A' AND NOT contains(old_text, ',') THEN 'number_format' ELSE 'amount' END AS category FROM tax
  WHERE flag <> 'N' AND NOT (flag = 'R' AND old_text = new_text)""", "tax"))
def h10(spark, sf_dir):
    d = tax_pairs(spark, sf_dir).where("flag <> 'N' and not (flag = 'R' and old_text = new_text)")
    # The other format of a price reads "1.234,56" for "1,234.56"; both hold the same numbers in another notation.
    c = classify(F.lit(4), F.col("old_text"), F.col("new_text"), B.changed_tokens(F.concat("old_text", F.lit(" a")), F.col("new_text")), critical_pattern(CRITICAL_WORDS))
    return d.select("l_orderkey", "l_linenumber", c["category"].alias("category"))


@query("h9_delta_text")
def h9t(spark, sf_dir):
    from veridoc.functions.amounts import delta_text, numeric_delta
    return tax_pairs(spark, sf_dir).select("l_orderkey", "l_linenumber", delta_text(numeric_delta(F.col("old_text"), F.col("new_text"))).alias("delta_text"))


@query("g18_changed_tokens", with_(r"""SELECT pair_id, seq, array_to_string(list_sort(list(tok)), ' ') AS changed FROM (SELECT pair_id, seq, tok FROM (
   SELECT pair_id, seq, lower(m) AS tok, 1 AS o, 0 AS n FROM (SELECT pair_id, seq, unnest(regexp_extract_all(old_text, '[\p{L}\p{N}]+')) AS m FROM blocks) UNION ALL
   SELECT pair_id, seq, lower(m), 0, 1 FROM (SELECT pair_id, seq, unnest(regexp_extract_all(new_text, '[\p{L}\p{N}]+')) AS m FROM blocks))
   GROUP BY ALL HAVING sum(o) <> sum(n)) GROUP BY ALL""", "blocks"))
def g18(spark, sf_dir):
    return block_table(spark, sf_dir).select("pair_id", "seq", F.array_join(B.changed_tokens(F.col("old_text"), F.col("new_text")), " ").alias("changed")).where("changed <> ''")


@query("h19_trim_common_affixes", with_(r"""SELECT pair_id, seq, array_to_string(o[p + 1 : len(o) - s], ' ') AS old_text, array_to_string(n[p + 1 : len(n) - s], ' ') AS new_text FROM (
  SELECT *, list_filter(range(0, least(len(o), len(n)) - p + 1), lambda k: o[len(o) - k + 1 :] = n[len(n) - k + 1 :])[-1] AS s FROM (
  SELECT *, list_filter(range(0, least(len(o), len(n)) + 1), lambda k: o[1 : k] = n[1 : k])[-1] AS p FROM (
  SELECT pair_id, seq, list_filter(string_split(old_text, ' '), lambda x: x <> '') AS o, list_filter(string_split(new_text, ' '), lambda x: x <> '') AS n FROM blocks)))""", "blocks"))
def h19(spark, sf_dir):
    return B.trim_common_affixes(block_table(spark, sf_dir)).select("pair_id", "seq", "old_text", "new_text")


@query("e13_collapse_unchanged_middle")
def e13(spark, sf_dir):
    return B.collapse_unchanged_middle(B.trim_common_affixes(block_table(spark, sf_dir))).select("pair_id", "seq", "old_text", "new_text")


@query("h20_inline_chunks")
def h20(spark, sf_dir):
    c = B.inline_chunks(block_table(spark, sf_dir))
    return c.select("pair_id", "seq", B.marked_text(F.col("old_chunks")).alias("old_marked"), B.marked_text(F.col("new_chunks")).alias("new_marked"))


def marks(spark, sf_dir):
    return facing(spark, sf_dir)


@query("e6_diff_clusters", with_("""SELECT doc_id AS pair_id, side, page, count(*) AS n_lines, min(y) AS min_y, max(y) AS max_y FROM (SELECT *, sum(nw) OVER (PARTITION BY doc_id, side, page ORDER BY line_idx) AS c FROM (
  SELECT *, CASE WHEN line_idx <= lag(line_idx) OVER w + 1 OR abs(lag(y) OVER w - y) <= 34 THEN 0 ELSE 1 END AS nw FROM (SELECT doc_id, side, page, line_idx, min_by(y0, idx) AS y FROM facing GROUP BY ALL)
  WINDOW w AS (PARTITION BY doc_id, side, page ORDER BY line_idx))) GROUP BY doc_id, side, page, c""", "facing"))
def e6(spark, sf_dir):
    m = marks(spark, sf_dir)
    c = B.diff_clusters(B.changed_lines(m, m))
    return c.select("pair_id", "side", "page", F.size(F.split("diff_text", "\n")).cast("long").alias("n_lines"), "min_y", "max_y")


def changed_halves(spark, sf_dir):
    """Tokens of every line, with the ones holding a digit as changed."""
    t = written(tokens(spark, sf_dir))  # read by each step of the lines
    return t, t.where(F.col("text").rlike("[0-9]"))


cte("hline", r"""SELECT doc_id, side, line_idx, page, list(text ORDER BY idx) AS ws, min(idx) FILTER (regexp_matches(text, '[0-9]')) AS a, max(idx) FILTER (regexp_matches(text, '[0-9]')) AS z,
  string_agg(text, ' ' ORDER BY idx) FILTER (regexp_matches(text, '[0-9]')) AS diff_text FROM ptok GROUP BY ALL""", "ptok")


@query("e7_line_context", with_("""SELECT doc_id AS pair_id, side, line_idx, diff_text, array_to_string(CASE WHEN a > 0 THEN ws[greatest(a - 4, 1) : a] ELSE coalesce(up[-4:], []) END, ' ') AS context_before,
  array_to_string(ws[z + 2 : z + 5], ' ') AS context_after FROM (SELECT *, lag(ws) OVER (PARTITION BY doc_id, side, page ORDER BY line_idx) AS up FROM hline) WHERE a IS NOT NULL""", "hline"))
def e7(spark, sf_dir):
    t, u = changed_halves(spark, sf_dir)
    return B.changed_lines(t, u).select("pair_id", "side", "line_idx", "diff_text", "context_before", "context_after")


@query("e8_column_spans", with_(r"""SELECT doc_id AS pair_id, side, line_idx, round(greatest(0, cl - 3), 3) AS f_left, round(greatest(greatest(0, cl - 3) + 10, CASE WHEN nx IS NOT NULL THEN least(cr + 10, (cr + nx) * 0.5)
    ELSE greatest(cr + 18, least(566, cl + 320)) END), 3) AS f_right FROM (SELECT doc_id, side, line_idx, min(x0) FILTER (col BETWEEN ca AND cz) AS cl, max(x1) FILTER (col BETWEEN ca AND cz) AS cr, min(x0) FILTER (col > cz) AS nx FROM (
    SELECT *, min(CASE WHEN hit THEN col END) OVER l AS ca, max(CASE WHEN hit THEN col END) OVER l AS cz FROM (SELECT *, regexp_matches(text, '[0-9]') AS hit, sum(far) OVER (PARTITION BY doc_id, side, line_idx ORDER BY idx) AS col FROM (
    SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id, side, line_idx ORDER BY idx) >= 22 THEN 1 ELSE 0 END AS far FROM ptok)) WINDOW l AS (PARTITION BY doc_id, side, line_idx)) WHERE ca IS NOT NULL GROUP BY ALL)""", "ptok"))
def e8(spark, sf_dir):
    t, u = changed_halves(spark, sf_dir)
    return B.changed_lines(t, u).select("pair_id", "side", "line_idx", F.round("f_left", 3).alias("f_left"), F.round("f_right", 3).alias("f_right"))


@query("j17_pair_clusters")
def j17(spark, sf_dir):
    t, u = changed_halves(spark, sf_dir)
    return B.pair_clusters(B.diff_clusters(B.changed_lines(t, u))).select("pair_id", "page", "part", "cluster", "old_text", "new_text", "left", "right")


@query("e9_changed_line_parts")
def e9(spark, sf_dir):
    """Words of all lines letter by letter; digits are the changed letters."""
    t = tokens(spark, sf_dir)
    letters = t.select("pair_id", "side", "page", "line_idx", "idx", F.posexplode(F.split("text", "")).alias("k", "ch")).where("ch <> ''").withColumn(
        "changed", F.col("ch").rlike("[0-9]"))
    return B.changed_line_parts(letters).where("changed").select("pair_id", "side", "line_idx", "idx", "part_no", "text")


@query("g19_segment_blocks", with_("""SELECT doc_id AS pair_id, side, page, count(DISTINCT b)::BIGINT AS n_blocks FROM (SELECT *, sum(CASE WHEN gap >= greatest(18, f * 2.2) THEN 1 ELSE 0 END) OVER (
   PARTITION BY doc_id, side, page ORDER BY y DESC) AS b FROM (SELECT *, lag(y - f * 0.2) OVER (PARTITION BY doc_id, side, page ORDER BY y DESC) - (y + f * 0.9) AS gap FROM (
   SELECT doc_id, side, page, y0 AS y, max(font_size) AS f FROM facing GROUP BY ALL))) GROUP BY ALL""", "facing"))
def g19(spark, sf_dir):
    return B.segment_blocks(marks(spark, sf_dir), ["pair_id", "side", "page"])


@query("g20_unified_boxes")
def g20(spark, sf_dir):
    return B.unified_boxes(marks(spark, sf_dir), ["pair_id", "side", "page"])


@query("a10_diff_pages", with_("SELECT doc_id AS pair_id, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM facing GROUP BY ALL", "facing"))
def a10(spark, sf_dir):
    return P.diff_pages(marks(spark, sf_dir)).select("pair_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("u1_affected_pages", with_("SELECT DISTINCT doc_id AS pair_id, page FROM facing", "facing"))
def u1(spark, sf_dir):
    m = marks(spark, sf_dir)
    return m.where("side = 'S'").select("pair_id", "page").union(m.where("side = 'T'").select("pair_id", "page")).distinct()


# --- grouping ------------------------------------------------------------------------------------------
FOLD = """SELECT {k}, count(*) AS n_blocks, max(severity) AS severity, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages,
  coalesce(min_by(delta_text, ({o})) FILTER (delta_text <> ''), '') AS delta_text, round(min("left") FILTER (near), 3) AS box_left, round(max(top) FILTER (near), 3) AS box_top FROM (
  SELECT *, page = fp AND abs((bottom + top) / 2 - fy) <= 22 AS near FROM (SELECT *, first(page) OVER f AS fp, first((bottom + top) / 2) OVER f AS fy FROM blocks WINDOW f AS (PARTITION BY {k} ORDER BY {o}))) GROUP BY {k}"""


def folded(df, keys):
    return df.select(*keys, "n_blocks", "severity", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "delta_text",
                     F.round("left", 3).alias("box_left"), F.round("top", 3).alias("box_top"))


@query("g4_dedupe_in_document", with_(FOLD.format(k="pair_id, product, signature", o="seq"), "blocks"))
def g4(spark, sf_dir):
    return folded(G.dedupe_in_document(block_table(spark, sf_dir), ["seq"]), ["pair_id", "product", "signature"])


@query("g5_group_across_documents", with_(f"""SELECT a.*, d.n_docs, d.first_doc FROM ({FOLD.format(k="product, signature", o="pair_id, seq")}) a JOIN (
  SELECT product, signature, count(DISTINCT pair_id) AS n_docs, min(pair_id) AS first_doc FROM blocks GROUP BY ALL) d USING (product, signature)""", "blocks"))
def g5(spark, sf_dir):
    g = G.group_across_documents(block_table(spark, sf_dir), ["pair_id", "seq"])
    return folded(g, ["product", "signature", "n_docs", "first_doc"])


@query("g9_merge_boxes", with_("""SELECT product, signature, round(min("left") FILTER (near), 3) AS l, round(max("right") FILTER (near), 3) AS r FROM (SELECT *, page = fp AND abs((bottom + top) / 2 - fy) <= 22 AS near FROM (
  SELECT *, first(page) OVER f AS fp, first((bottom + top) / 2) OVER f AS fy FROM blocks WINDOW f AS (PARTITION BY product, signature ORDER BY pair_id, seq))) GROUP BY ALL""", "blocks"))
def g9(spark, sf_dir):
    return G.merge_boxes(block_table(spark, sf_dir), ["product", "signature"], ["pair_id", "seq"]).select(
        "product", "signature", F.round("left", 3).alias("l"), F.round("right", 3).alias("r"))


cte("grp", """SELECT product, signature, min(channel) AS channel, max(severity) AS severity, min(change_type) AS change_type, count(DISTINCT pair_id) AS n_docs, min(pair_id) AS first_doc,
  array_to_string(list_sort(list(DISTINCT pair_id)), ',') AS docset FROM blocks GROUP BY ALL""", "blocks")


def groups(spark, sf_dir):
    b = block_table(spark, sf_dir)
    return b, G.group_across_documents(b, ["pair_id", "seq"])


@query("g5_contexts", with_("""SELECT product, signature, string_agg(c, ' / ' ORDER BY rk) AS contexts FROM (SELECT *, row_number() OVER (PARTITION BY product, signature ORDER BY o, u) AS rk FROM (
  SELECT product, signature, upper(c) AS u, min((pair_id, seq)) AS o, min_by(c, (pair_id, seq, c)) AS c FROM (SELECT *, trim(context_before) AS c FROM blocks) WHERE c <> '' GROUP BY product, signature, upper(c))) WHERE rk <= 2 GROUP BY ALL""", "blocks"))
def g5c(spark, sf_dir):
    return G.first_contexts(block_table(spark, sf_dir), ["product", "signature"], ["pair_id", "seq"])


SPOT = """a.page = b.page AND abs((a.bottom + a.top) / 2 - (b.bottom + b.top) / 2) <= 15 AND least(a.top, b.top) + 2 >= greatest(a.bottom, b.bottom)
  AND (abs(a.f_left - b.f_left) <= 28 OR least(a."right", b."right") > greatest(a."left", b."left"))"""


cte("places", 'SELECT DISTINCT product, page, "left", bottom, "right", top, f_left, f_bottom, f_right, f_top FROM blocks', "blocks")


@query("j21_same_spot", with_(f"""SELECT a.product, a.page, count(*) AS n_edges FROM places a JOIN places b ON a.product = b.product AND a.page = b.page
  AND (a."left", a.bottom, a."right", a.top) < (b."left", b.bottom, b."right", b.top) AND {SPOT} GROUP BY ALL""", "places"))
def j21(spark, sf_dir):
    b = block_table(spark, sf_dir)
    nodes = b.select("product", "page", *BOX).distinct().withColumn("node", F.sha2(F.concat_ws("|", "product", "page", *BOX), 256)).withColumn("lone", F.lit(None).cast("string"))
    return G.spot_edges(nodes).join(nodes.select(F.col("node").alias("a"), "product", "page"), "a").groupBy("product", "page").agg(F.count("*").alias("n_edges"))


@query("g6_merge_variants")
def g6(spark, sf_dir):
    b, g = groups(spark, sf_dir)
    g = g.withColumn("page", F.element_at("pages", 1))
    return G.merge_variants(g).groupBy("product", "component").agg(F.count("*").alias("variants"), F.min("signature").alias("first_signature")).drop("component")


def merged(spark, sf_dir):
    b, g = groups(spark, sf_dir)
    m = cut(G.merge_variants(g.withColumn("page", F.element_at("pages", 1))))
    return b, G.finalize_groups(m, G.group_documents(b))


@query("g7_finalize_group")
def g7(spark, sf_dir):
    _, f = merged(spark, sf_dir)
    return f.select("product", "channel", "signature", "severity", "occurrence_count", "page", "pages_label", "variant_count", F.array_join("variants", " ; ").alias("variants"))


@query("g12_count_unique_differences", with_("SELECT product, count(*) AS unique_signatures FROM grp GROUP BY ALL", "grp"))
def g12(spark, sf_dir):
    _, g = groups(spark, sf_dir)
    return g.groupBy("product").agg(F.count("*").alias("unique_signatures"))


PROD = """SELECT b.channel, b.product, impacted_docs, unique_diffs, critical_unique FROM (SELECT channel, product, count(DISTINCT pair_id) AS impacted_docs FROM blocks GROUP BY ALL) b
  JOIN (SELECT channel, product, count(*) AS unique_diffs, count_if(severity = 3)::BIGINT AS critical_unique FROM grp GROUP BY ALL) g USING (channel, product)"""


@query("g8_product_summary", with_(PROD, "blocks", "grp"))
def g8(spark, sf_dir):
    b, g = groups(spark, sf_dir)
    return G.product_summary(g, b)


@query("g10_channel_summary", with_(f"""SELECT channel, product, count(*) AS products, sum(unique_diffs)::BIGINT AS unique_diffs, sum(impacted_docs)::BIGINT AS impacted_docs
  FROM ({PROD}) GROUP BY ROLLUP (channel, product)""", "blocks", "grp"))
def g10(spark, sf_dir):
    b, g = groups(spark, sf_dir)
    return G.channel_summary(G.product_summary(g, b))


@query("g11_group_by_document_set", with_("""SELECT product, n_docs, count(*) AS diff_count, count_if(severity = 3)::BIGINT AS critical_count, max(severity) AS max_severity,
  count_if(change_type IN (2, 4))::BIGINT AS insertions, count_if(change_type IN (1, 4))::BIGINT AS deletions, min(first_doc) AS first_doc FROM grp GROUP BY product, n_docs, docset""", "grp"))
def g11(spark, sf_dir):
    return G.group_by_document_set(groups(spark, sf_dir)[1])


# --- statuses, reports, review -----------------------------------------------------------------------
def pair_table(spark, sf_dir):
    s = corpus.files(spark, sf_dir, "S").select(F.col("doc_id").alias("pair_id"), "product", "channel", F.col("path").alias("source_path"))
    t = corpus.files(spark, sf_dir, "T").select(F.col("doc_id").alias("pair_id"), F.col("path").alias("target_path"))
    return s.join(t, "pair_id", "left").withColumn("match_key", F.regexp_extract("source_path", r"([^/]*)\.pdf$", 1))


def status_table(spark, sf_dir):
    b = block_table(spark, sf_dir)
    return cut(P.pair_status(pair_table(spark, sf_dir), b)), b


cte("pairs", """SELECT s.doc_id AS pair_id, s.product, s.channel, s.path AS source_path, t.path AS target_path, regexp_extract(s.path, '([^/]*)\\.pdf$', 1) AS match_key
  FROM docs s LEFT JOIN docs t ON s.doc_id = t.doc_id AND t.side = 'T' WHERE s.side = 'S'""".replace("\\\\", "\\"), "docs")
cte("st", """SELECT p.*, CASE WHEN target_path IS NULL THEN 'MissingInTarget' WHEN n > 0 THEN 'Different' ELSE 'Identical' END AS status,
  CASE WHEN target_path IS NULL THEN -1 ELSE coalesce(n, 0) END AS diff_count, coalesce(ins, 0) AS insertions, coalesce(del, 0) AS deletions, coalesce(crit, 0) AS critical_count, coalesce(sev, 0) AS max_severity
  FROM pairs p LEFT JOIN (SELECT pair_id, count(*) AS n, count_if(severity = 3)::BIGINT AS crit, max(severity) AS sev, count_if(change_type IN (2, 4))::BIGINT AS ins, count_if(change_type IN (1, 4))::BIGINT AS del
   FROM blocks GROUP BY ALL) b USING (pair_id)""", "pairs", "blocks")
ST = "SELECT pair_id, status, diff_count, critical_count, max_severity FROM st"
SHOW = ["pair_id", "status", "diff_count", "critical_count", "max_severity"]


@query("g2_pair_status", with_("SELECT pair_id, status, diff_count, insertions, deletions, critical_count, max_severity FROM st", "st"))
def g2(spark, sf_dir):
    return status_table(spark, sf_dir)[0].select("pair_id", "status", "diff_count", "insertions", "deletions", "critical_count", "max_severity")


@query("g3_text_concordance", with_("""SELECT pair_id, round_even(least(greatest(1.0::DOUBLE - changed::DOUBLE / greatest(20, total * 5), 0), 0.999) * 100, 2) AS score FROM (
  SELECT doc_id AS pair_id, sum(length(text))::BIGINT AS changed FROM facing GROUP BY ALL) JOIN (SELECT doc_id AS pair_id, count(*) AS total FROM mwords GROUP BY ALL) USING (pair_id)""", "facing", "mwords"))
def g3(spark, sf_dir):
    changed = marks(spark, sf_dir).groupBy("pair_id").agg(F.sum(F.length("text")).alias("changed"))
    total = corpus.pair_words(spark, sf_dir).groupBy("pair_id").agg(F.count("*").alias("total"))
    return changed.join(total, "pair_id").select("pair_id", B.text_concordance(F.col("changed"), F.col("total")).alias("score"))


@query("g13_summaries_from_pairs", with_("""SELECT pair_id, channel, product, '[' || channel || ' • ' || product || '] ' || regexp_extract(target_path, '([^/]*)$', 1) AS document_name, count(*) AS n
  FROM st JOIN (SELECT pair_id FROM blocks) USING (pair_id) WHERE status = 'Different' GROUP BY ALL""", "st", "blocks"))
def g13(spark, sf_dir):
    st, b = status_table(spark, sf_dir)
    return P.summaries_from_pairs(st, b).groupBy("pair_id", "channel", "product", "document_name").agg(F.count("*").alias("n"))


KPI = """SELECT count(*) AS total, count_if(status = 'Identical')::BIGINT AS identical, count_if(status = 'Different')::BIGINT AS different, count_if(status = 'Different' AND (max_severity = 3 OR critical_count > 0))::BIGINT AS critical,
  count_if(status IN ('MissingInTarget', 'Error'))::BIGINT AS issues FROM st"""


@query("g14_kpis", with_(KPI, "st"))
def g14(spark, sf_dir):
    return P.kpis(status_table(spark, sf_dir)[0])


@query("g15_gate", with_(f"SELECT CASE WHEN critical > 0 OR issues > 0 THEN 2 WHEN different > 0 THEN 1 ELSE 0 END AS exit_code FROM ({KPI})", "st"))
def g15(spark, sf_dir):
    return P.gate(status_table(spark, sf_dir)[0])


@query("g21_change_breakdown", with_("""SELECT channel, product, count_if(change_type = 2)::BIGINT AS inserted, count_if(change_type = 1)::BIGINT AS deleted, count_if(change_type = 4)::BIGINT AS modified, 0::BIGINT AS dates,
  count_if(category = 'amount')::BIGINT AS numbers, count_if(category = 'text_changed')::BIGINT AS words FROM blocks GROUP BY ALL""", "blocks"))
def g21(spark, sf_dir):
    return P.change_breakdown(block_table(spark, sf_dir))


@query("b9_status_filter", with_(ST + " WHERE status IN ('Different', 'Error')", "st"))
def b9(spark, sf_dir):
    return P.status_filter(status_table(spark, sf_dir)[0], "ERRORS").select(*SHOW)


@query("o1_order_results", with_(ST, "st"))
def o1(spark, sf_dir):
    return P.order_results(status_table(spark, sf_dir)[0]).select(*SHOW)


PRI = "CASE WHEN channel = 'Bank' THEN 1 ELSE 2 END"


@query("o2_campaign_order", with_(f"SELECT pair_id, channel, {PRI} AS priority, diff_count FROM st", "st"))
def o2(spark, sf_dir):
    st = status_table(spark, sf_dir)[0]
    pri = P.channel_priority(st.select("channel", F.expr(PRI).alias("sort_priority")))
    return P.order_campaign(st, pri).select("pair_id", "channel", "priority", "diff_count")


@query("g22_channel_priority", with_(f"SELECT channel, min({PRI}) AS priority FROM docs GROUP BY ALL", "docs"))
def g22(spark, sf_dir):
    return P.channel_priority(corpus.files(spark, sf_dir, "S").select("channel", F.expr(PRI).alias("sort_priority")))


@query("o3_document_list_order", with_("SELECT pair_id, status, channel, product, match_key FROM st", "st"))
def o3(spark, sf_dir):
    return P.order_documents(status_table(spark, sf_dir)[0]).select("pair_id", "status", "channel", "product", "match_key")


@query("o5_top_n_with_overflow", with_("""SELECT pair_id, count(*) AS n, string_agg(signature, ' ; ' ORDER BY seq) FILTER (rk <= 3) || CASE WHEN count(*) > 3 THEN ' (+' || (count(*) - 3) || ')' ELSE '' END AS top FROM (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY seq) AS rk FROM blocks) GROUP BY ALL""", "blocks"))
def o5(spark, sf_dir):
    b = block_table(spark, sf_dir)
    top = G.top_k(b.select("pair_id", "seq", "signature"), ["pair_id"], [F.col("seq")], 3).groupBy("pair_id").agg(
        F.expr("listagg(signature, ' ; ') within group (order by seq)").alias("t"))
    n = b.groupBy("pair_id").agg(F.count("*").alias("n"))
    return n.join(top, "pair_id").select("pair_id", "n", F.concat("t", F.when(F.col("n") > 3, F.concat(F.lit(" (+"), (F.col("n") - 3).cast("string"), F.lit(")"))).otherwise("")).alias("top"))


@query("a7_export_product_csv", with_("""SELECT channel, product, n_docs, '' AS document, 'Different' AS status, 'P.' || pages AS pages, old_text, new_text FROM (SELECT channel, product, signature, count(DISTINCT pair_id) AS n_docs,
   array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, min(old_text) AS old_text, min(new_text) AS new_text FROM blocks GROUP BY ALL)
  UNION ALL SELECT channel, product, 1, regexp_extract(coalesce(target_path, source_path), '([^/]*)$', 1), status, 'P.1', '', '' FROM st WHERE status <> 'Different'""", "blocks", "st"))
def a7(spark, sf_dir):
    st, b = status_table(spark, sf_dir)
    g = G.group_across_documents(b, ["pair_id", "seq"]).withColumn("occurrence_count", F.col("n_docs")).withColumn("group_key", F.col("signature"))
    return P.product_csv_rows(g, st).drop("group_key")


@query("a9_synthesis_dataset", with_("""SELECT channel, product, upper(substr(sha256(channel || ' • ' || product || '|' || signature), 1, 16)) AS row_key, n_docs, severity, count(*) OVER (PARTITION BY channel, product) AS product_total FROM grp""", "grp"))
def a9(spark, sf_dir):
    _, g = groups(spark, sf_dir)
    g = cut(g)
    total = g.groupBy("channel", "product").agg(F.count("*").alias("product_total"))
    rows = g.withColumn("row_key", B.row_key(F.concat_ws(" • ", "channel", "product"), F.col("signature")))
    return rows.join(total, ["channel", "product"]).select("channel", "product", "row_key", "n_docs", "severity", "product_total")


cte("rk", "SELECT *, upper(substr(sha256(channel || ' • ' || product || '|' || signature), 1, 16)) AS row_key FROM grp", "grp")


@query("b11_review_filter", with_("SELECT row_key, channel, product, n_docs FROM rk WHERE channel = 'Bank' AND row_key NOT IN (SELECT row_key FROM rk WHERE severity = 3)", "rk"))
def b11(spark, sf_dir):
    _, g = groups(spark, sf_dir)
    rows = cut(g.withColumn("row_key", B.row_key(F.concat_ws(" • ", "channel", "product"), F.col("signature"))))
    return P.review_filter(rows, rows.where("severity = 3").select("row_key"), channel="Bank").select("row_key", "channel", "product", "n_docs")


@query("j18_suppress_by_signature", with_("""SELECT pair_id, seq FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM (SELECT product, signature FROM blocks QUALIFY row_number() OVER (PARTITION BY product ORDER BY pair_id, seq) <= 3) r
  WHERE r.product = b.product AND upper(r.signature) = upper(b.signature))""", "blocks"))
def j18(spark, sf_dir):
    from veridoc.sources import rules as R
    b = block_table(spark, sf_dir)
    first = G.top_k(b.select("product", "signature", "pair_id", "seq"), ["product"], [F.col("pair_id"), F.col("seq")], 3)
    rules = first.select(F.col("signature").alias("ignored_signature"), F.col("product").alias("product_filter"), F.lit(True).alias("is_enabled"))
    return B.suppress_by_signature(b, rules).select("pair_id", "seq")


cte("ok", "SELECT *, row_number() OVER (PARTITION BY product ORDER BY pair_id, seq) = 1 AS is_zone FROM blocks QUALIFY row_number() OVER (PARTITION BY product ORDER BY pair_id, seq) <= 2", "blocks")


@query("j19_approve_differences", with_(f"""SELECT pair_id, status, diff_count FROM (SELECT st.pair_id, CASE WHEN st.status = 'Different' AND n IS NULL THEN 'Identical' ELSE st.status END AS status, CASE WHEN st.status = 'Different' THEN coalesce(n, 0) ELSE diff_count END AS diff_count
  FROM st LEFT JOIN (SELECT pair_id, count(*) AS n FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM ok a WHERE a.product = b.product AND a.signature = b.signature)
   AND NOT EXISTS (SELECT 1 FROM ok a WHERE a.is_zone AND a.product = b.product AND {SPOT}) GROUP BY ALL) k USING (pair_id))""", "st", "ok"))
def j19(spark, sf_dir):
    st, b = status_table(spark, sf_dir)
    first = G.top_k(b, ["product"], [F.col("pair_id"), F.col("seq")], 2).withColumn("is_zone", F.col("rank") == 1).drop("rank")
    left = P.approve_differences(b, cut(first))
    return P.recount(st, left).select("pair_id", "status", "diff_count")


@query("j20_apply_new_rule", with_("""SELECT pair_id, seq FROM blocks WHERE upper(signature) NOT IN (SELECT upper(signature) FROM ok)""", "blocks", "ok"))
def j20(spark, sf_dir):
    b = block_table(spark, sf_dir)
    return P.apply_text_rule(b, G.top_k(b, ["product"], [F.col("pair_id"), F.col("seq")], 2)).select("pair_id", "seq")


@query("j22_retest_pairs", with_(ST + " WHERE pair_id IN (SELECT pair_id FROM blocks WHERE severity = 3)", "st", "blocks"))
def j22(spark, sf_dir):
    st, b = status_table(spark, sf_dir)
    return P.retest_selection(st, b.where("severity = 3")).select(*SHOW)
