"""Scanned words, lines and zones."""

from pyspark.sql import functions as F

from veridoc.operators import words as O, zones as Z
from veridoc.plans.oracle import cte, with_
from veridoc.plans.registry import query
from veridoc.sources import corpus, rules as R

KEYS = ["side", "doc_id"]


def raw(spark, sf_dir):
    return corpus.raw_words(spark, sf_dir, "S").unionByName(corpus.raw_words(spark, sf_dir, "T"))


def digest(w, order="page, pos, sub"):
    return w.groupBy("side", "doc_id").agg(
        F.count("*").alias("n_words"), F.round(F.sum("x0"), 3).alias("sum_x"), F.round(F.sum("x1"), 3).alias("sum_x1"),
        F.md5(F.expr(f"listagg(text, ' ') within group (order by {order})")).alias("digest"))


DIGEST = """SELECT side, doc_id, count(*) AS n_words, round(sum(x0), 3) AS sum_x, round(sum(x1), 3) AS sum_x1,
  md5(string_agg(text, ' ' ORDER BY page, pos, sub)) AS digest FROM {} GROUP BY ALL"""
ci = lambda vals: ", ".join("'" + v.upper().replace("'", "''") + "'" for v in vals)

cte("visible", """SELECT * FROM raw_words WHERE NOT (x1 < 0 OR x0 > page_w OR y1 < 0 OR y0 > page_h
  OR (NOT horizontal AND (x1 <= 28 OR x0 >= page_w - 24)) OR font_size < 1.8 OR glyph_span <= 0.1 OR n_letters = 0
  OR trim(text) = '' OR grey >= 0.94)""", "raw_words")
FRAGS = " OR ".join(f"contains(upper(text), '{f}')" for f in O.WATERMARK_FRAGMENTS)
cte("unmarked", rf"""SELECT * FROM visible WHERE NOT (CASE WHEN regexp_matches(trim(text), '{O.ANCHOR}') THEN true
  WHEN regexp_matches(trim(text), '{O.PROTECTED}') THEN false WHEN regexp_matches(trim(text), '{O.CODE}') THEN true
  WHEN upper(trim(text)) IN ({ci(O.WATERMARK_WORDS)}) THEN true WHEN font_size >= 16 AND ({FRAGS}) THEN true
  ELSE font_size > 42 END)""", "visible")
WM = "|".join(O.WATERMARK_WORDS + O.WATERMARK_CODES)
cte("cleaned", rf"""SELECT * FROM (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(text, '{O.ANCHOR}', '', 'g'),
  '(?i)\b(?:{WM})\b', '', 'g'), '{O.STAMP}', '', 'g') AS text) FROM unmarked) WHERE trim(text) <> ''""", "unmarked")


def lines_sql(src, tol, op):
    return f"""SELECT * EXCLUDE (brk), CAST(sum(brk) OVER (PARTITION BY side, doc_id, page ORDER BY y0 DESC, x0, pos, sub
      ROWS UNBOUNDED PRECEDING) AS INTEGER) AS line_no FROM (SELECT *, CASE WHEN lag(y0) OVER (
      PARTITION BY side, doc_id, page ORDER BY y0 DESC, x0, pos, sub) - y0 {op} {tol} THEN 1 ELSE 0 END AS brk FROM {src})"""


def mean_lines_sql(src):
    """The words of a page one by one, with sum and count of the line they may join."""
    return f"""WITH RECURSIVE ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY side, doc_id, page ORDER BY y0 DESC, x0, pos, sub) AS i FROM {src}),
      walk AS (SELECT side, doc_id, page, i, y0 AS total, 1 AS n, 0 AS line_no FROM ranked WHERE i = 1
        UNION ALL SELECT w.side, w.doc_id, w.page, r.i, CASE WHEN joins THEN total + r.y0 ELSE r.y0 END, CASE WHEN joins THEN n + 1 ELSE 1 END,
          CASE WHEN joins THEN line_no ELSE line_no + 1 END FROM walk w JOIN ranked r ON r.side = w.side AND r.doc_id = w.doc_id
          AND r.page = w.page AND r.i = w.i + 1 CROSS JOIN LATERAL (SELECT total / n - r.y0 < greatest(4.5, r.font_size * 0.48) AS joins))
      SELECT r.* EXCLUDE (i), walk.line_no FROM ranked r JOIN walk USING (side, doc_id, page, i)"""


cte("lined", lines_sql("cleaned", "3.0", ">"), "cleaned")
LINE_W = "(PARTITION BY side, doc_id, page, line_no ORDER BY x0, pos, sub)"


def glue_sql(src, glued, keep):
    firsts = ", ".join(f"min_by({c}, (x0, pos, sub)) AS {c}" for c in keep)
    return f"""SELECT side, doc_id, page, line_no, string_agg(text, '' ORDER BY x0, pos, sub) AS text, min(x0) AS x0, min(y0) AS y0,
      max(x1) AS x1, max(y1) AS y1, {firsts} FROM (SELECT *, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY side, doc_id,
      page, line_no ORDER BY x0, pos, sub ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce({glued}, false) AS glued FROM (
      SELECT *, lag(text) OVER w AS p_text, lag(x0) OVER w AS p_x0, lag(x1) OVER w AS p_x1, lag(y0) OVER w AS p_y0,
      lag(font_size) OVER w AS p_font FROM {src} WINDOW w AS {LINE_W}))) GROUP BY side, doc_id, page, line_no, run"""


KEEP = ["pos", "sub", "font_size", "page_w", "page_h", "product", "channel", "path", "lang", "line_on_page"]
cte("single", f"""SELECT * FROM lined WINDOW w AS {LINE_W} QUALIFY NOT coalesce(abs(y0 - lag(y0) OVER w) <= 1.5
  AND abs(x0 - lag(x0) OVER w) <= 0.8 AND text = lag(text) OVER w, false)""", "lined")
cte("merged", glue_sql("single", rf"""abs(y0 - p_y0) <= 2.4 AND x0 - p_x1 >= -1.2 AND (x0 - p_x1 <= 0.75 OR (x0 - p_x1 <= 2.6 AND
  (regexp_matches(p_text, '[./]$') OR regexp_matches(text, '^[./]')) AND regexp_matches(p_text, '\d') AND regexp_matches(text, '\d')
  AND regexp_matches(p_text || text, '{O.SPLIT_TOKEN}')))""", KEEP), "single")


def visible(spark, sf_dir):
    return O.filter_visible_words(raw(spark, sf_dir))


def cleaned(spark, sf_dir):
    return O.clean_raw_token(O.filter_watermark_words(visible(spark, sf_dir)))


def merged(spark, sf_dir):
    return O.merge_touching(O.visual_lines(cleaned(spark, sf_dir), KEYS), KEYS, KEEP)


@query("b1_filter_visible_words", with_(DIGEST.format("visible"), "visible"))
def b1(spark, sf_dir):
    return digest(visible(spark, sf_dir))


@query("b2_filter_watermark_words", with_(DIGEST.format("unmarked"), "unmarked"))
def b2(spark, sf_dir):
    return digest(O.filter_watermark_words(visible(spark, sf_dir)))


@query("b3_clean_raw_token", with_(DIGEST.format("cleaned"), "cleaned"))
def b3(spark, sf_dir):
    return digest(cleaned(spark, sf_dir))


LINES = """SELECT side, doc_id, page, line_no, count(*) AS n_words, min(y0) AS low, max(y0) AS high FROM {} GROUP BY ALL"""
cte("lined_s", mean_lines_sql("cleaned"), "cleaned")


@query("e1_visual_lines", with_(LINES.format("lined"), "lined"))
def e1(spark, sf_dir):
    w = O.visual_lines(cleaned(spark, sf_dir), KEYS)
    return w.groupBy("side", "doc_id", "page", "line_no").agg(F.count("*").alias("n_words"), F.min("y0").alias("low"), F.max("y0").alias("high"))


# Skewed scans: words drop to the right by 0 to 1.2 points a column, so that neighbouring lines meet at the page's sides and
# only the mean of a line tells it from the next. The check walks the words of a page one by one with the line's sum and count.
cte("skewed", "SELECT * REPLACE (y0 - 0.3 * (doc_id % 5) * (x0 - 40) / 42 AS y0) FROM cleaned", "cleaned")
cte("walked", mean_lines_sql("skewed"), "skewed")


@query("e1_sanitizer_lines", with_("""SELECT side, doc_id, page, line_no, count(*) AS n_words, round(min(y0), 6) AS low, round(max(y0), 6) AS high,
  round(sum(y0), 3) AS sum_y FROM walked GROUP BY ALL""", "walked"))
def e1s(spark, sf_dir):
    w = cleaned(spark, sf_dir)
    w = w.withColumn("y0", F.col("y0") - F.lit(0.3) * (F.col("doc_id") % 5) * (F.col("x0") - 40) / 42)
    w = w.select(*KEYS, "page", "pos", "sub", "x0", "y0", "font_size")
    return O.sanitizer_lines(w, KEYS).groupBy("side", "doc_id", "page", "line_no").agg(
        F.count("*").alias("n_words"), F.round(F.min("y0"), 6).alias("low"), F.round(F.max("y0"), 6).alias("high"), F.round(F.sum("y0"), 3).alias("sum_y"))


@query("e2_merge_touching", with_(DIGEST.format("merged"), "merged"))
def e2(spark, sf_dir):
    return digest(merged(spark, sf_dir))


@query("e3_dedupe_overprint_words", with_(DIGEST.format(f"""(SELECT * FROM lined_s WINDOW w AS {LINE_W} QUALIFY NOT coalesce(x0 < lag(x1) OVER w - 0.5
  AND abs(x0 - lag(x0) OVER w) <= greatest(1.5, lag(font_size) OVER w * 0.18) AND text = lag(text) OVER w, false))"""), "lined_s"))
def e3(spark, sf_dir):
    w = cleaned(spark, sf_dir).select(*KEYS, "page", "pos", "sub", "text", "x0", "x1", "y0", "font_size")
    w = O.sanitizer_lines(w, KEYS)
    return digest(O.dedupe_overprint_words(w, KEYS))


@query("e5_merge_kerning_and_numbers", with_(DIGEST.format("(" + glue_sql("lined_s", r"""x0 - p_x1 >= -1.5 AND (x0 - p_x1 <= greatest(1.8, p_font * 0.22)
  OR (x0 - p_x1 <= greatest(5.0, p_font * 0.7) AND regexp_matches(p_text, '^\d{1,12}$') AND regexp_matches(text, '^[\d€$£%]+$')))""", KEEP) + ")"), "lined_s"))
def e5(spark, sf_dir):
    w = cleaned(spark, sf_dir).select(*KEYS, "page", "text", "x0", "x1", "y0", "y1", *KEEP)
    w = O.sanitizer_lines(w, KEYS)
    return digest(O.merge_kerning_and_numbers(w, KEYS, KEEP))


NORM = r"lower(regexp_replace(trim(text), '^[.,;:()\[\]\"«»]+|[.,;:()\[\]\"«»]+$', '', 'g'))"
HEADRX = "|".join(O.COPY_HEADS)
cte("footed", rf"""SELECT * FROM (SELECT *, min(cut) OVER (PARTITION BY side, doc_id, page, line_no) AS cut_from FROM (
  SELECT *, CASE WHEN first_y <= greatest(140.0, page_h * 0.17) AND n - k <= 9 AND (k = 0 OR x0 - p_x1 >= 16 OR ends_with(p_text, '.'))
    AND length(head) >= 4 AND (regexp_matches(head, '(?i)^(?:{HEADRX})(?:$|[^\p{{L}}])') OR (regexp_matches(head, '(?i)^(?:{HEADRX})') AND contains(head, '/'))
      OR (lower(head) IN ('copie', 'kopie', 'copy') AND n - k >= 2))
    AND NOT coalesce((CASE WHEN k > 0 THEN p_norm WHEN abs(above_y - first_y) <= 24 THEN above_last END) IN ({", ".join("'" + w.replace("'", "''") + "'" for w in O.COUNT_WORDS)}), false)
    AND NOT coalesce(noun, false) THEN k END AS cut FROM (
  SELECT w.*, h.above_y, h.above_last FROM (
    SELECT *, row_number() OVER l - 1 AS k, count(*) OVER a AS n, first(y0) OVER a AS first_y, lag(x1) OVER l AS p_x1, lag(text) OVER l AS p_text,
      lag(norm) OVER l AS p_norm, bool_or(norm IN ({", ".join("'" + w + "'" for w in O.CONTRACT_NOUNS)})) OVER (PARTITION BY side, doc_id, page, line_no ORDER BY x0, pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS noun
    FROM (SELECT *, {NORM} AS norm, regexp_replace(trim(text), '^[()\[\]\-–•:;,.]+|[()\[\]\-–•:;,.]+$', '', 'g') AS head FROM merged)
    WINDOW l AS (PARTITION BY side, doc_id, page, line_no ORDER BY x0, pos), a AS (PARTITION BY side, doc_id, page, line_no ORDER BY x0, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) w
  JOIN (SELECT side, doc_id, page, line_no, lag(fy) OVER p AS above_y, lag(ln) OVER p AS above_last FROM (
     SELECT side, doc_id, page, line_no, min_by(y0, (x0, pos)) AS fy, max_by(norm, (x0, pos)) AS ln FROM (SELECT *, {NORM} AS norm FROM merged) GROUP BY ALL)
     WINDOW p AS (PARTITION BY side, doc_id, page ORDER BY line_no)) h USING (side, doc_id, page, line_no))))
  WHERE cut_from IS NULL OR k < cut_from""", "merged")


@query("b4_strip_footer_mentions", with_(DIGEST.format("footed"), "footed"))
def b4(spark, sf_dir):
    return digest(O.strip_footer_mentions(merged(spark, sf_dir), KEYS))


# --- zones -----------------------------------------------------------------------------------------
ZONES = R.DEFAULT_ZONES + [
    ("ratio", 4, "Right ratio zone", True, True, False, "", "OddPages", None, None, "NormalizedRatio", "TopLeft", 0.85, 0.0, 0.15, 0.5),
    ("first", 5, "Product zone, first page", True, True, True, "src1, Broker / src3", "FirstPageOnly", None, None, "PdfPoints", "BottomLeft", 30.0, 500.0, 200.0, 60.0),
    ("range", 6, "Pages 2 to 3", True, True, False, "src2;src4", "CustomRange", 2, 3, "PdfPoints", "BottomLeft", 100.0, 300.0, 90.0, 33.0),
    ("off", 7, "Disabled", False, True, False, "", "AllPages", None, None, "PdfPoints", "TopLeft", 0.0, 0.0, 2000.0, 2000.0),
    ("last", 8, "Last page", True, True, True, "", "LastPageOnly", None, None, "PdfPoints", "BottomLeft", 50.0, 650.0, 150.0, 40.0),
]
lit = lambda v: "NULL" if v is None else ("true" if v is True else "false" if v is False else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}")
cte("zones", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in z) + ")" for z in ZONES) + """) v(rule_id, rule_order, name,
  is_enabled, is_user_zone, collect_dates, product_filter, page_scope, page_start, page_end, unit, origin, x, y, width, height)""")
cte("zscope", r"""SELECT * EXCLUDE (tok), CASE WHEN product_filter = '' THEN NULL ELSE upper(regexp_replace(trim(tok), '\s*/\s*', '/', 'g')) END AS scope_key
  FROM (SELECT *, unnest(CASE WHEN product_filter = '' THEN [''] ELSE regexp_split_to_array(product_filter, '[,;|]') END) AS tok FROM zones WHERE is_enabled)""", "zones")
cte("pwords", """SELECT *, CAST(0 AS INTEGER) AS sub, CAST(595 AS DOUBLE) AS page_w, CAST(842 AS DOUBLE) AS page_h, max(page) OVER (PARTITION BY side, doc_id) AS total_pages FROM words""", "words")
cte("zhits", """SELECT w.*, z.rule_id, z.rule_order, z.collect_dates FROM pwords w JOIN (SELECT * FROM zscope) z
  ON (z.scope_key IS NULL OR z.scope_key = upper(w.product) OR z.scope_key = upper(w.channel || '/' || w.product))
  AND CASE z.page_scope WHEN 'FirstPageOnly' THEN w.page = 1 WHEN 'LastPageOnly' THEN w.page = w.total_pages WHEN 'EvenPages' THEN w.page % 2 = 0
    WHEN 'OddPages' THEN w.page % 2 <> 0 WHEN 'CustomRange' THEN w.page BETWEEN z.page_start AND z.page_end ELSE true END
  CROSS JOIN LATERAL (SELECT CASE WHEN z.unit = 'NormalizedRatio' THEN z.x * w.page_w ELSE z.x END AS l,
     CASE WHEN z.unit = 'NormalizedRatio' THEN z.width * w.page_w ELSE z.width END AS wd, CASE WHEN z.unit = 'NormalizedRatio' THEN z.y * w.page_h ELSE z.y END AS o,
     CASE WHEN z.unit = 'NormalizedRatio' THEN z.height * w.page_h ELSE z.height END AS h) q
  CROSS JOIN LATERAL (SELECT q.l AS zl, q.l + q.wd AS zr, CASE WHEN z.origin = 'TopLeft' THEN w.page_h - q.o - q.h ELSE q.o END AS zb,
     CASE WHEN z.origin = 'TopLeft' THEN w.page_h - q.o ELSE q.o + q.h END AS zt) b
  WHERE w.x0 <= zr AND w.x1 >= zl AND w.y0 <= zt AND w.y1 >= zb AND ((NOT z.is_user_zone AND z.scope_key IS NULL) OR (
    ((w.x0 + w.x1) * 0.5 BETWEEN zl AND zr OR greatest(0, least(w.x1, zr) - greatest(w.x0, zl)) / greatest(0.1, w.x1 - w.x0) >= 0.45)
    AND ((w.y0 + w.y1) * 0.5 BETWEEN zb AND zt OR greatest(0, least(w.y1, zt) - greatest(w.y0, zb)) / greatest(0.1, w.y1 - w.y0) >= 0.45)))""",
    "pwords", "zscope")


def page_words(spark, sf_dir):
    """Words with page geometry; the page count comes from the token array, before it is expanded."""
    def one(side):
        d = corpus.tokens(corpus.spread(corpus.documents(spark, sf_dir, side), "doc_id"))
        per_line = F.expr("case when side = 'T' and lang = 'de' then 13 else 12 end")
        d = d.withColumn("total_pages", (F.floor(F.floor((F.size("toks") - 1) / per_line) / 50) + 1).cast("int"))
        return corpus.place(d)
    w = one("S").unionByName(one("T"))
    return w.withColumn("sub", F.lit(0)).withColumn("page_w", F.lit(595.0)).withColumn("page_h", F.lit(842.0))


def zones(spark):
    return R.zone_table(spark, ZONES)


@query("j11_zone_hit", with_("SELECT rule_id, side, doc_id, page, count(*) AS n_words, sum(pos)::BIGINT AS sum_pos FROM zhits GROUP BY ALL", "zhits"))
def j11(spark, sf_dir):
    return Z.zone_hits(page_words(spark, sf_dir), zones(spark)).groupBy("rule_id", "side", "doc_id", "page").agg(
        F.count("*").alias("n_words"), F.sum("pos").alias("sum_pos"))


cte("zfree", "SELECT * FROM pwords w WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT side, doc_id, pos FROM zhits) h WHERE h.side = w.side AND h.doc_id = w.doc_id AND h.pos = w.pos)", "pwords", "zhits")


@query("b5_exclude_zones", with_(DIGEST.format("zfree"), "zfree"))
def b5(spark, sf_dir):
    return digest(Z.exclude_zones(page_words(spark, sf_dir), zones(spark)))


@query("b6_collect_zone_dates", with_(r"""SELECT DISTINCT side, doc_id, trim(regexp_replace(text, '[^0-9]+', '.', 'g'), '.') AS norm FROM (
  SELECT * FROM zhits WHERE regexp_matches(text, '\b\d{1,2}[./\-\s]+\d{1,2}[./\-\s]+\d{2,4}\b')
  QUALIFY row_number() OVER (PARTITION BY side, doc_id, pos ORDER BY rule_order, rule_id) = 1) WHERE collect_dates""", "zhits"))
def b6(spark, sf_dir):
    return Z.collect_zone_dates(page_words(spark, sf_dir), zones(spark), KEYS)


@query("g23_rule_impact", with_("""SELECT h.rule_id, h.product, h.page, h.excluded, coalesce(k.kept, 0) AS kept, t.total FROM
  (SELECT rule_id, product, page, count(*) AS excluded FROM zhits GROUP BY ALL) h JOIN
  (SELECT product, page, count(*) AS total FROM pwords GROUP BY ALL) t USING (product, page) LEFT JOIN
  (SELECT product, page, count(*) AS kept FROM zfree GROUP BY ALL) k USING (product, page)""", "zhits", "zfree"))
def g23(spark, sf_dir):
    return Z.rule_impact(page_words(spark, sf_dir), zones(spark))


@query("b7_page_scope", with_("""SELECT z.rule_id, count(*) AS n_pages FROM (SELECT DISTINCT side, doc_id, page, total_pages FROM pwords) w JOIN zones z ON
  CASE z.page_scope WHEN 'FirstPageOnly' THEN w.page = 1 WHEN 'LastPageOnly' THEN w.page = w.total_pages WHEN 'EvenPages' THEN w.page % 2 = 0
    WHEN 'OddPages' THEN w.page % 2 <> 0 WHEN 'CustomRange' THEN w.page BETWEEN z.page_start AND z.page_end ELSE true END GROUP BY ALL""", "pwords", "zones"))
def b7(spark, sf_dir):
    pages = page_words(spark, sf_dir).groupBy("side", "doc_id", "page", "total_pages").agg(F.count("*").alias("n"))
    return pages.join(F.broadcast(zones(spark)), R.page_scope(*[F.col(c) for c in (
        "page", "total_pages", "page_scope", "page_start", "page_end")])).groupBy("rule_id").agg(F.count("*").alias("n_pages"))


SCOPED = """SELECT DISTINCT d.side, d.doc_id, z.rule_id FROM docs d JOIN zscope z ON z.scope_key IS NULL
  OR z.scope_key IN (upper(d.product), upper(d.channel || '/' || d.product))"""


def scoped_docs(spark, sf_dir):
    f = corpus.files(spark, sf_dir, "S").unionByName(corpus.files(spark, sf_dir, "T"))
    from veridoc.functions import paths as P
    return f.withColumn("scope_keys", R.document_keys(F.col("product"), F.col("product"), F.col("channel"), R.template_family(P.stem(F.col("path")))))


@query("b8_product_scope", with_(SCOPED, "docs", "zscope"))
def b8(spark, sf_dir):
    return R.rules_for_documents(scoped_docs(spark, sf_dir), zones(spark), KEYS)


@query("j12_rules_for_document", with_(f"SELECT side, doc_id, count(*) AS n_rules, array_to_string(list_sort(list(rule_id)), ',') AS rules FROM ({SCOPED}) GROUP BY ALL", "docs", "zscope"))
def j12(spark, sf_dir):
    return R.rules_for_documents(scoped_docs(spark, sf_dir), zones(spark), KEYS).groupBy("side", "doc_id").agg(
        F.count("*").alias("n_rules"), F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"))


@query("h23_zone_bounds", with_("""SELECT DISTINCT z.rule_id, round(CASE WHEN z.unit = 'NormalizedRatio' THEN x * page_w ELSE x END, 4) AS l,
  round(CASE WHEN z.origin = 'TopLeft' THEN page_h - (y + height) * k ELSE y * k END, 4) AS b, round(((x + width) * kx)::DOUBLE, 4) AS r,
  round(CASE WHEN z.origin = 'TopLeft' THEN page_h - y * k ELSE (y + height) * k END, 4) AS t FROM
  (SELECT DISTINCT page_w, page_h FROM pwords) w CROSS JOIN (SELECT *, CASE WHEN unit = 'NormalizedRatio' THEN 842.0 ELSE 1.0 END AS k,
  CASE WHEN unit = 'NormalizedRatio' THEN 595.0 ELSE 1.0 END AS kx FROM zones) z""", "pwords", "zones"))
def h23(spark, sf_dir):
    sizes = page_words(spark, sf_dir).select("page_w", "page_h").distinct()
    z = F.broadcast(zones(spark))
    b = Z.zone_bounds(F.col, F.col("page_w"), F.col("page_h"))
    return sizes.join(z, F.lit(True)).select("rule_id", *[F.round(c, 4).alias(n) for c, n in zip(b, "lbrt")]).distinct()


# --- texts -------------------------------------------------------------------------------------------
SEPW = "(PARTITION BY side, doc_id ORDER BY pos)"
cte("sepw", f"""SELECT *, CASE WHEN lag(page) OVER w IS NULL THEN '' WHEN lag(page) OVER w <> page OR abs(lag(y0) OVER w - y0) > 5 THEN chr(10) ELSE ' ' END AS sep
  FROM words WINDOW w AS {SEPW}""", "words")
cte("dtext", "SELECT side, doc_id, product, channel, string_agg(sep || text, '' ORDER BY pos) AS text FROM sepw GROUP BY ALL", "sepw")


@query("e11_masked_text", with_("SELECT side, doc_id, md5(text) AS digest, length(text) AS n_chars FROM dtext", "dtext"))
def e11(spark, sf_dir):
    t = O.masked_text(corpus.both_words(spark, sf_dir), KEYS)
    return t.select("side", "doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query("e12_char_offsets", with_(f"""SELECT side, doc_id, max(stop) AS n_chars, sum(stop * (pos % 7))::BIGINT AS checksum FROM (
  SELECT *, sum(length(sep) + length(text)) OVER (PARTITION BY side, doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM sepw) GROUP BY ALL""", "sepw"))
def e12(spark, sf_dir):
    w = O.char_offsets(corpus.both_words(spark, sf_dir), KEYS)
    return w.groupBy("side", "doc_id").agg(F.max("stop").alias("n_chars"), F.sum(F.col("stop") * (F.col("pos") % 7)).alias("checksum"))
