"""Line diff, page alignment and token reconciliation."""

from pyspark.sql import functions as F

from veridoc.operators import linediff as L, masking as M, reconcile as R
from veridoc.plans.oracle import cte, with_
from veridoc.plans.q_text import LIG, MAP
from veridoc.plans.q_masking import DATE, norm_sql, rules
from veridoc.plans.q_words import glue_sql, lines_sql
from veridoc.plans.registry import query
from veridoc.session import written
from veridoc.sources import corpus


def masked_words(spark, sf_dir):
    w = corpus.pair_words(spark, sf_dir).select("pair_id", "side", "page", "pos", "text", "x0", "x1", "y0", "y1", "font_size")
    return M.mask_words(w, ["pair_id", "side"], [r for r in rules(spark) if r.rule_id == "dates"])


def tokens(spark, sf_dir):
    return L.diff_tokens(masked_words(spark, sf_dir))


def loose(spark, sf_dir):
    # Read by the lines and by the tokens: made twice from one shuffle of the texts, as stored words take many times the input.
    t = tokens(spark, sf_dir)
    return written(L.loose_tokens(t, L.token_lines(t)))


def facing(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return written(L.facing_tokens(t, L.token_lines(t)))


cte("mwords", rf"""SELECT side, doc_id, page, pos, x0, x1, y0, y1, font_size, CASE WHEN norms IS NOT NULL AND regexp_matches(text, '{DATE}')
    AND list_contains(norms, {norm_sql('text')}) THEN '[DATE_IGNORE]' ELSE text END AS raw
  FROM words LEFT JOIN rep USING (side, doc_id) WHERE doc_id IN (SELECT doc_id FROM docs WHERE side = 'T')""", "words", "rep", "docs")
cte("ptok0", rf"""SELECT side, doc_id, page, pos, CAST(sub AS INTEGER) AS sub, y0, y1, font_size,
   x0 + (x1 - x0) * (greatest(instr(raw, part) - 1, 0)::DOUBLE / length(raw)) AS x0,
   x0 + (x1 - x0) * (greatest(instr(raw, part) - 1, 0)::DOUBLE / length(raw) + length(part)::DOUBLE / length(raw)) AS x1,
   lower(regexp_replace({MAP.replace('tok', 'part')}, '[^\p{{L}}\p{{Nd}}€$£%]', '', 'g')) AS text FROM (
   SELECT *, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS sub FROM (SELECT *, CASE WHEN (starts_with(raw, '[') AND contains(raw, ']'))
     OR contains(raw, '_IGNORE]') THEN [raw] ELSE list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(raw,
     '([0-9]):([0-9])', '\1§\2', 'g'), '([0-9]):([0-9])', '\1§\2', 'g'), '[:;()\[\]]'), lambda x: replace(x, '§', ':')), lambda x: x <> '') END AS parts FROM mwords))
  WHERE text <> ''""", "mwords")
cte("ptok1", lines_sql("ptok0", "greatest(4.5, font_size * 0.48)", ">="), "ptok0")
LW = "(PARTITION BY side, doc_id, page, line_no ORDER BY x0, pos, sub)"
cte("ptok2", f"""SELECT * FROM ptok1 WINDOW w AS {LW} QUALIFY NOT coalesce(x0 < lag(x1) OVER w - 0.5
  AND abs(x0 - lag(x0) OVER w) <= greatest(1.5, lag(font_size) OVER w * 0.18) AND text = lag(text) OVER w, false)""", "ptok1")
cte("ptok", "SELECT *, CAST(dense_rank() OVER (PARTITION BY side, doc_id ORDER BY page, line_no) - 1 AS INTEGER) AS line_idx, "
    "CAST(row_number() OVER (PARTITION BY side, doc_id, page, line_no ORDER BY x0, pos, sub) - 1 AS INTEGER) AS idx FROM ("
    + glue_sql("ptok2", r"""x0 - p_x1 >= -1.5 AND (x0 - p_x1 <= greatest(1.8, p_font * 0.22)
  OR (x0 - p_x1 <= greatest(5.0, p_font * 0.7) AND regexp_matches(p_text, '^\d{1,12}$') AND regexp_matches(text, '^[\d€$£%]+$')))""",
               ["pos", "sub", "font_size"]) + ")", "ptok2")
cte("plines", "SELECT doc_id, side, line_idx, page, string_agg(text, ' ' ORDER BY idx) AS line_text, count(*) AS n FROM ptok GROUP BY ALL", "ptok")
cte("loose", """SELECT t.*, t.line_idx AS row FROM ptok t JOIN (SELECT doc_id, side, line_idx FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, line_text, k) AS c FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, side, line_text ORDER BY line_idx) AS k FROM plines)) WHERE c = 1) USING (doc_id, side, line_idx)""", "ptok", "plines")


cte("facing", """SELECT t.*, t.line_idx AS row FROM ptok t JOIN plines a ON t.doc_id = a.doc_id AND t.side = a.side AND t.line_idx = a.line_idx
  LEFT JOIN plines b ON a.doc_id = b.doc_id AND a.side <> b.side AND a.line_idx = b.line_idx WHERE b.line_text IS NULL OR b.line_text <> a.line_text""", "ptok", "plines")


@query("g1_line_tokens", with_("""SELECT doc_id AS pair_id, side, line_idx, page, md5(line_text) AS digest, n FROM plines""", "plines"))
def g1_lines(spark, sf_dir):
    return L.token_lines(tokens(spark, sf_dir)).select("pair_id", "side", "line_idx", "page", F.md5("line_text").alias("digest"), "n")


@query("g1_common_line_counts", with_("""SELECT doc_id AS pair_id, sum(greatest(s - t, 0))::BIGINT AS only_source, sum(greatest(t - s, 0))::BIGINT AS only_target,
  sum(least(s, t))::BIGINT AS common FROM (SELECT doc_id, line_text, count_if(side = 'S') AS s, count_if(side = 'T') AS t FROM plines GROUP BY ALL) GROUP BY ALL""", "plines"))
def g1_prefilter(spark, sf_dir):
    return L.common_line_counts(L.token_lines(tokens(spark, sf_dir)))


@query("g1_line_diff")
def g1(spark, sf_dir):
    return L.line_diff(L.token_lines(tokens(spark, sf_dir)))


# One step of the longest common subsequence a line of the source; only pairs that differ are walked, on lines both sides hold.
LCS_SQL = with_("""SELECT doc_id AS pair_id, s_lines::BIGINT AS s_lines, t_lines::BIGINT AS t_lines, coalesce(kept, 0)::BIGINT AS kept FROM sizes LEFT JOIN (
    SELECT doc_id, least(head, len(a)) + CASE WHEN len(a) = len(b) AND head >= len(a) THEN 0 ELSE list_max(r) END AS kept FROM walk WHERE i = len(a)) USING (doc_id)""",
    "plines").replace("\nSELECT doc_id AS pair_id", """,
  sizes AS (SELECT doc_id, count_if(side = 'S') AS s_lines, count_if(side = 'T') AS t_lines FROM plines GROUP BY ALL),
  held AS (SELECT doc_id, line_text FROM plines GROUP BY ALL HAVING count(DISTINCT side) = 2),
  arr AS (SELECT doc_id, list(line_text ORDER BY line_idx) FILTER (WHERE side = 'S') AS a, list(line_text ORDER BY line_idx) FILTER (WHERE side = 'T') AS b
          FROM plines JOIN held USING (doc_id, line_text) GROUP BY ALL),
  cut AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda j: a[j] = b[j]), false) - 1, least(len(a), len(b))) AS head FROM arr),
  walk AS (SELECT doc_id, a, b, head, CASE WHEN len(a) = len(b) AND head >= len(a) THEN len(a) ELSE head END AS i,
             list_transform(range(0, len(b) - head + 1), lambda j: 0) AS r FROM cut
    UNION ALL SELECT doc_id, a, b, head, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (
      SELECT *, list_prepend(0, list_transform(range(1, len(r)), lambda j: CASE WHEN b[head + j] = a[i + 1] THEN r[j] + 1 ELSE r[j + 1] END)) AS c
      FROM walk WHERE i < len(a)))
SELECT doc_id AS pair_id""", 1).replace("WITH ", "WITH RECURSIVE ", 1)


def alignment_length(spark, sf_dir, cells):
    """Lines of both sides and how many of them the diff leaves unchanged."""
    lines = written(L.token_lines(tokens(spark, sf_dir)).select(*L.SIDE, "line_idx", "line_text"))
    sizes = lines.groupBy("pair_id").agg(*[F.count_if(F.col("side") == s).alias(f"{s.lower()}_lines") for s in ("S", "T")])
    changed = L.line_diff(lines, cells).groupBy("pair_id").agg(F.count("s_line").alias("gone"))
    return sizes.join(changed, "pair_id", "left").select("pair_id", "s_lines", "t_lines", (F.col("s_lines") - F.coalesce("gone", F.lit(0))).alias("kept"))


@query("g1_alignment_length", LCS_SQL)
def g1_length(spark, sf_dir):
    return alignment_length(spark, sf_dir, None)


@query("g1_anchored_alignment_length", LCS_SQL)
def g1_anchored_length(spark, sf_dir):
    """Every pair the way long pairs go."""
    return alignment_length(spark, sf_dir, 0)


@query("g2_text_hashes", with_("""SELECT doc_id AS pair_id, side, sha256(string_agg(line_text, chr(10) ORDER BY line_idx)) AS digest FROM plines GROUP BY ALL""", "plines"))
def g2_hash(spark, sf_dir):
    return L.text_hashes(L.token_lines(tokens(spark, sf_dir)))


def unmatched(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return L.changed_tokens_of_lines(t, L.line_diff(L.token_lines(t)))


@query("r1_inline_lcs")
def r1(spark, sf_dir):
    return L.joined_fragments(written(L.inline_lcs(written(unmatched(spark, sf_dir))))).select("pair_id", "side", "row", "idx", "text")


def line_match_sql(least, shift=30):
    """Each source line in order takes the first free target line of its key that is near."""
    return with_(f"""SELECT DISTINCT doc_id AS pair_id, side, row, idx FROM (
     SELECT doc_id, side, row, unnest(ids) AS idx FROM g JOIN (
       SELECT doc_id, key, 'S' AS side, unnest(s_rows) AS row FROM walk WHERE i = len(ss) UNION ALL
       SELECT doc_id, key, 'T', unnest(t_rows) FROM walk WHERE i = len(ss)) USING (doc_id, key, side, row))""", f"walk_{least}").replace(
        f"walk_{least} AS", "walk AS").replace(f"g_{least} AS", "g AS").replace("WITH ", "WITH RECURSIVE ", 1)


for _glue, _least in (("''", 1), ("chr(1)", 2)):
    cte(f"g_{_least}", f"""SELECT doc_id, side, row, string_agg(text, {_glue} ORDER BY idx) AS key, min(page) AS page, list(idx ORDER BY idx) AS ids
      FROM facing GROUP BY ALL HAVING count(*) >= {_least}""", "facing")
    cte(f"lists_{_least}", """SELECT doc_id, key, list({'row': row, 'page': page} ORDER BY row) FILTER (WHERE side = 'S') AS ss,
      list({'row': row, 'page': page} ORDER BY row) FILTER (WHERE side = 'T') AS ts FROM g GROUP BY ALL""", f"g_{_least}")
    cte(f"walk_{_least}", f"""SELECT doc_id, key, ss, ts, 0 AS i, []::INT[] AS s_rows, []::INT[] AS t_rows FROM lists_{_least} WHERE ss IS NOT NULL AND ts IS NOT NULL
      UNION ALL SELECT doc_id, key, ss, ts, i + 1, CASE WHEN m IS NULL THEN s_rows ELSE list_append(s_rows, ss[i + 1].row) END,
        CASE WHEN m IS NULL THEN t_rows ELSE list_append(t_rows, m) END
      FROM (SELECT *, list_filter(ts, lambda t: (t.page = ss[i + 1].page OR abs(t.row - ss[i + 1].row) <= 30) AND NOT list_contains(t_rows, t.row))[1].row AS m
            FROM walk WHERE i < len(ss))""", f"lists_{_least}")


@query("r2_match_spaceless_lines", line_match_sql(1))
def r2(spark, sf_dir):
    return R.match_spaceless_lines(facing(spark, sf_dir))


@query("r7_match_moved_lines", line_match_sql(2))
def r7(spark, sf_dir):
    return R.match_moved_lines(facing(spark, sf_dir))


RUN = lambda n: f"""SELECT * FROM (""" + " UNION ALL ".join(
    f"""SELECT doc_id, side, seq, row, page, y0, {k} AS n, {" || ".join(["text"] + [f"t{j}" for j in range(1, k)])} AS key FROM w WHERE true"""
    + "".join(f" AND p{j} = page AND abs(h{j} - y0) <= 36" for j in range(1, k)) for k in range(1, n + 1)) + ") WHERE key IS NOT NULL"
cte("w", "SELECT *, row_number() OVER o AS seq, " + ", ".join(
    f"lead(text, {j}) OVER o AS t{j}, lead(page, {j}) OVER o AS p{j}, lead(y0, {j}) OVER o AS h{j}" for j in range(1, 6))
    + " FROM loose WINDOW o AS (PARTITION BY doc_id, side ORDER BY row, idx)", "loose")
cte("runs3", RUN(3), "w")
cte("runs6", RUN(6), "w")
EDGE_OUT = "SELECT s.doc_id AS pair_id, s.key AS s_key, count(*) AS n_edges, sum(s.seq * 7 + t.seq)::BIGINT AS checksum FROM {r} s JOIN {r} t ON s.doc_id = t.doc_id AND s.side = 'S' AND t.side = 'T' AND s.key = t.key WHERE {c} GROUP BY ALL"


def edge_out(e):
    return e.groupBy("pair_id", "s_key").agg(F.count("*").alias("n_edges"), F.sum(F.col("s_seq").cast("long") * 7 + F.col("t_seq")).alias("checksum"))


@query("r3_split_word_edges", with_(EDGE_OUT.format(r="runs3", c="s.n + t.n > 2 AND (s.n = 1 OR t.n = 1 OR (s.n = 2 AND t.n = 2)) AND (s.page = t.page OR abs(s.row - t.row) <= 25)"), "runs3"))
def r3_edges(spark, sf_dir):
    ok = ((F.col("s_n") == 1) | (F.col("t_n") == 1) | ((F.col("s_n") == 2) & (F.col("t_n") == 2))) & R._near(R.SEQUENCE_SHIFT)
    return edge_out(R.run_edges(loose(spark, sf_dir), 3).where(ok))


@query("r3_match_split_words")
def r3(spark, sf_dir):
    return R.match_split_words(loose(spark, sf_dir))


@query("r4_run_edges", with_(EDGE_OUT.format(r="runs6", c="s.n + t.n > 2 AND s.page = t.page AND abs(s.y0 - t.y0) <= 65 AND length(s.key) >= 2"), "runs6"))
def r4_edges(spark, sf_dir):
    ok = (F.col("s_page") == F.col("t_page")) & (F.abs(F.col("s_y0") - F.col("t_y0")) <= 65.0) & (F.length("s_key") >= 2)
    return edge_out(R.run_edges(loose(spark, sf_dir), 6).where(ok))


@query("r4_match_spaceless_runs")
def r4(spark, sf_dir):
    return R.match_spaceless_runs(loose(spark, sf_dir))


@query("r5_match_page_lcs")
def r5(spark, sf_dir):
    return R.match_page_lcs(loose(spark, sf_dir))


TOK_EDGE = """SELECT s.doc_id AS pair_id, s.text AS s_text, count(*) AS n_edges, round(sum(abs(s.y0 - t.y0) + 0.25 * abs(s.x0 - t.x0)), 3) AS cost
  FROM loose s JOIN loose t ON s.doc_id = t.doc_id AND s.side = 'S' AND t.side = 'T' AND s.text = t.text WHERE {} GROUP BY ALL"""


def tok_out(e):
    return e.groupBy("pair_id", "s_text").agg(F.count("*").alias("n_edges"), F.round(F.sum(F.col("dy") + F.col("dx") * 0.25), 3).alias("cost"))


@query("r9_nearby_edges", with_(TOK_EDGE.format("s.page = t.page AND abs(s.y0 - t.y0) < greatest(60, s.font_size * 4.5) AND abs(s.x0 - t.x0) < 480"), "loose"))
def r9_edges(spark, sf_dir):
    return tok_out(R.nearby_edges(loose(spark, sf_dir)))


@query("r9_match_nearby_word")
def r9(spark, sf_dir):
    return R.match_nearby_word(loose(spark, sf_dir))


@query("r10_cost_edges", with_(TOK_EDGE.format(r"""s.page = t.page AND abs(s.y0 - t.y0) <= CASE WHEN regexp_matches(s.text, '\d') THEN
  CASE WHEN abs(s.x0 - t.x0) <= 45 THEN 95 ELSE 42 END WHEN length(s.text) >= 4 THEN 260 ELSE 110 END"""), "loose"))
def r10_edges(spark, sf_dir):
    return tok_out(R.cost_edges(loose(spark, sf_dir)))


@query("r10_match_min_cost")
def r10(spark, sf_dir):
    return R.match_min_cost(loose(spark, sf_dir))


@query("r6_reflow_edges", with_("""SELECT s.doc_id AS pair_id, s.text AS s_text, count(*) AS n_edges FROM loose s JOIN loose t ON s.doc_id = t.doc_id AND s.side = 'S'
  AND t.side = 'T' AND s.text = t.text WHERE (s.page = t.page AND (abs(s.row - t.row) <= 2 OR abs(s.y0 - t.y0) <= 38)) OR (abs(s.page - t.page) = 1 AND abs(s.row - t.row) <= 5) GROUP BY ALL""", "loose"))
def r6_edges(spark, sf_dir):
    return R.reflow_edges(loose(spark, sf_dir)).groupBy("pair_id", "s_text").agg(F.count("*").alias("n_edges"))


@query("r6_match_reflow")
def r6(spark, sf_dir):
    return R.match_reflow(loose(spark, sf_dir))


@query("r8_match_sequences")
def r8(spark, sf_dir):
    return R.match_sequences(loose(spark, sf_dir))


@query("r11_prune_common_prefix")
def r11(spark, sf_dir):
    return R.prune_common_prefix(loose(spark, sf_dir)).select("pair_id", "side", "row", "idx", "text")


cte("pset", "SELECT DISTINCT doc_id, side, page, upper(text) AS tok FROM words WHERE doc_id IN (SELECT doc_id FROM docs WHERE side = 'T')", "words", "docs")


@query("j13_page_similarity", with_("""SELECT i.doc_id AS pair_id, i.sp, i.tp, round(i.i / (a.n + b.n - i.i), 6) AS sim FROM
  (SELECT s.doc_id, s.page AS sp, t.page AS tp, count(*) AS i FROM pset s JOIN pset t ON s.doc_id = t.doc_id AND s.tok = t.tok AND s.side = 'S' AND t.side = 'T' GROUP BY ALL) i
  JOIN (SELECT doc_id, page, count(*) AS n FROM pset WHERE side = 'S' GROUP BY ALL) a ON a.doc_id = i.doc_id AND a.page = i.sp
  JOIN (SELECT doc_id, page, count(*) AS n FROM pset WHERE side = 'T' GROUP BY ALL) b ON b.doc_id = i.doc_id AND b.page = i.tp""", "pset"))
def j13(spark, sf_dir):
    from veridoc.functions.text import fold
    w = corpus.pair_words(spark, sf_dir).withColumn("text", fold(F.col("text")))
    return L.page_similarity(w).withColumn("sim", F.round("sim", 6))


@query("j14_align_pages")
def j14(spark, sf_dir):
    return L.align_pages(corpus.pair_words(spark, sf_dir))


@query("j15_tokens_in_regions", with_("""SELECT doc_id AS pair_id, side, page, count(*) AS n FROM words w WHERE doc_id IN (SELECT doc_id FROM docs WHERE side = 'T') AND EXISTS (
   SELECT 1 FROM (SELECT doc_id, page, x0, x1, y0, y1 FROM words WHERE side = 'S' AND regexp_matches(text, '^[0-9]+,00$')) r WHERE r.doc_id = w.doc_id AND r.page = w.page
   AND w.x0 - 12 <= r.x1 AND w.x1 + 12 >= r.x0 AND w.y0 - 12 <= r.y1 AND w.y1 + 12 >= r.y0) GROUP BY ALL""", "words", "docs"))
def j15(spark, sf_dir):
    w = corpus.pair_words(spark, sf_dir)
    regions = w.where("side = 'S'").where(F.col("text").rlike("^[0-9]+,00$")).select("pair_id", "page", "x0", "x1", "y0", "y1")
    return L.tokens_in_regions(w, regions).groupBy("pair_id", "side", "page").agg(F.count("*").alias("n"))


@query("j16_mark_changed_letters", with_("""SELECT w.doc_id AS pair_id, w.side, count_if(l.doc_id IS NOT NULL)::BIGINT AS changed, count(*) AS total FROM words w LEFT JOIN
  (SELECT DISTINCT doc_id, side, page, round_even(x0, 1) AS x, round_even(y0, 1) AS y FROM loose) l ON l.doc_id = w.doc_id AND l.side = w.side AND l.page = w.page
   AND round_even(w.x0, 1) = l.x AND round_even(w.y0, 1) = l.y WHERE w.doc_id IN (SELECT doc_id FROM docs WHERE side = 'T') GROUP BY ALL""", "words", "loose", "docs"))
def j16(spark, sf_dir):
    at = lambda df: df.select("pair_id", "side", "page", F.col("x0").alias("x"), F.col("y0").alias("y"))
    marked = L.mark_changed_letters(at(corpus.pair_words(spark, sf_dir)), at(loose(spark, sf_dir)))
    return marked.groupBy("pair_id", "side").agg(F.count_if("changed").alias("changed"), F.count("*").alias("total"))
