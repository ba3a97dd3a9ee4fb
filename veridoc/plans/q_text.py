"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from veridoc.functions import amounts as A, paths as P, text as X
from veridoc.plans import q_pairing  # noqa: F401  (states the file key tables)
from veridoc.plans.oracle import cte, with_
from veridoc.plans.registry import query
from veridoc.sources import corpus


def token_table(spark, sf_dir):
    """Distinct tokens of all texts."""
    d = corpus.table(spark, sf_dir, "documents").select("text").union(corpus.table(spark, sf_dir, "pages").select("html"))
    return d.select(F.explode(F.split("text", r"\s+")).alias("tok")).where("tok <> ''").distinct()


cte("tokens", r"""SELECT DISTINCT tok FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS tok FROM documents
  UNION ALL SELECT unnest(regexp_split_to_array(html, '\s+')) FROM pages) WHERE tok <> ''""")
Q = lambda s: s.replace("'", "''")
LIG = "tok"
for _g, _p in X.LIGATURES.items():
    LIG = f"replace({LIG}, '{_g}', '{_p}')"
_src = X.BULLETS + X.DASHES + X.APOSTROPHES + X.QUOTES
_dst = " " * len(X.BULLETS) + "-" * len(X.DASHES) + "'" * len(X.APOSTROPHES) + '"' * len(X.QUOTES)
MAP = f"translate({LIG}, '{Q(_src)}', '{Q(_dst)}')"
CLEAN = rf"lower(regexp_replace({MAP}, '[^\p{{L}}\p{{Nd}}€$£%]', '', 'g'))"


@query("h1_normalize_text")
def h1(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("digest"))


@query("h2_clean_line", with_(f"SELECT tok, nfc_normalize(translate(regexp_replace({MAP}, '[{X.ZERO_WIDTH}]', '', 'g'), "
                              f"'{X.WIDE_SPACES}', '   ')) AS clean FROM tokens", "tokens"))
def h2(spark, sf_dir):
    return token_table(spark, sf_dir).select("tok", X.clean_line(F.col("tok")).alias("clean"))


@query("h3_clean_word", with_(f"SELECT tok, {CLEAN} AS clean FROM tokens", "tokens"))
def h3(spark, sf_dir):
    return token_table(spark, sf_dir).select("tok", X.clean_raw_word(F.col("tok")).alias("clean"))


@query("h4_split_compound", with_(r"""SELECT tok, array_to_string(list_filter(list_transform(
    regexp_split_to_array(regexp_replace(regexp_replace(tok, '([0-9]):([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9]):([0-9])', '\1' || chr(1) || '\2', 'g'),
    '[:;()\[\]]'), lambda x: replace(x, chr(1), ':')), lambda x: x <> ''), '|') AS parts FROM tokens""", "tokens"))
def h4(spark, sf_dir):
    return token_table(spark, sf_dir).select(
        "tok", F.array_join(X.split_compound(F.col("tok")), "|").alias("parts"))


@query("h5_display_key", with_("""SELECT s.path AS source_path, t.path AS target_path,
    CASE WHEN upper(s.ekey) = upper(t.ekey) THEN s.ekey ELSE
     (CASE WHEN length(s.ekey) > 42 THEN substr(s.ekey, 1, 39) || '…' ELSE s.ekey END) || ' ➔ ' ||
     (CASE WHEN length(t.ekey) > 42 THEN substr(t.ekey, 1, 39) || '…' ELSE t.ekey END) END AS label, s.ekey AS name
  FROM files_k s JOIN files_k t ON s.doc_id = t.doc_id AND s.side = 'S' AND t.side = 'T'""", "files_k"))
def h5(spark, sf_dir):
    p = id_pairs(spark, sf_dir)
    return p.select("source_path", "target_path", P.display_key(F.col("source_path"), F.col("target_path")).alias("label"),
                    P.exact_key(F.col("source_path")).alias("name"))


def id_pairs(spark, sf_dir):
    s, t = corpus.files(spark, sf_dir, "S"), corpus.files(spark, sf_dir, "T")
    return s.select("doc_id", "product", "channel", F.col("path").alias("source_path")).join(
        t.select("doc_id", F.col("path").alias("target_path")), "doc_id")


DATE_RX = X.DATE


def date_sql(c):
    return (rf"CASE WHEN regexp_matches({c}, '{DATE_RX}') THEN trim(regexp_replace({c}, '[^0-9]+', '.', 'g'), '.') "
            rf"ELSE upper(trim({c})) END")


@query("h6_date_tokens", with_(rf"SELECT DISTINCT text AS tok, regexp_matches(text, '{DATE_RX}') AS is_date, {date_sql('text')} AS norm "
                               r"FROM words WHERE regexp_matches(text, '[0-9]')", "words"))
def h6(spark, sf_dir):
    w = corpus.both_words(spark, sf_dir).where(F.col("text").rlike("[0-9]")).select("text").distinct()
    return w.select(F.col("text").alias("tok"), X.is_date(F.col("text")).alias("is_date"), X.date_token(F.col("text")).alias("norm"))


ISSUED = "concat('Fait a Lille ', source, ' le 13/11/2026. ', text, ' Erstellt in ', lang, ' am 1-2-26')"


@query("h7_issuance_dates", rf"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all({ISSUED}, '{X.ISSUED_AT}', 1),
  lambda d: {date_sql('d')}), ',') AS dates FROM documents""")
def h7(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").withColumn("t", F.expr(ISSUED))
    return d.select("doc_id", F.array_join(X.issuance_dates(F.col("t")), ",").alias("dates"))


NUM_RX = r"-?\d{1,3}(?:[\s\x{00A0}\x{202F}.]\d{3})*(?:[.,]\d+)?|-?\d+(?:[.,]\d+)?"
PLAIN = r"regexp_replace(x, '[ \t\r\n\x{00A0}\x{202F}]', '', 'g')"
NUMBERS = rf"""list_filter(list_transform(regexp_extract_all(%s, '{NUM_RX}'), lambda x: TRY_CAST(
  CASE WHEN contains(x, ',') AND (NOT contains(x, '.') OR instr(reverse(x), ',') < instr(reverse(x), '.')) THEN replace(replace({PLAIN}, '.', ''), ',', '.')
       WHEN contains(x, ',') THEN replace({PLAIN}, ',', '') ELSE {PLAIN} END AS DECIMAL(28,6))), lambda n: n IS NOT NULL)"""


@query("h8_extract_numbers", f"""SELECT doc_id, len(n) AS n_numbers, coalesce(round(CAST(list_sum(n) AS DOUBLE), 4), 0) AS total FROM (
  SELECT doc_id, {NUMBERS % "text || ' 1 250,75 -3.4 1.234.567,8'"} AS n FROM documents)""")
def h8(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").withColumn(
        "n", A.extract_numbers(F.concat("text", F.lit(" 1 250,75 -3.4 1.234.567,8"))))
    return d.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.round(F.coalesce(F.aggregate(
        "n", F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + x).cast("decimal(38,6)")).cast("double"), F.lit(0.0)), 4).alias("total"))


def tax_pairs(spark, sf_dir):
    """Old and new price texts from line items: same format, other format, or other value."""
    li = corpus.table(spark, sf_dir, "lineitem")
    price = F.format_number(F.col("l_extendedprice").cast("double"), 2)
    new = F.format_number((F.col("l_extendedprice") * (F.col("l_linenumber") + 1) / 2).cast("double"), 2)
    swap = F.translate(F.translate(F.translate(price, ",", "\u0001"), ".", ","), "\u0001", ".")
    return li.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"),
                     F.concat(F.lit("Amount "), price, F.lit(" EUR")).alias("old_text"),
                     F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Amount "), swap)).when(
                         F.col("l_returnflag") == "R", F.concat(F.lit("Amount "), new, F.lit(" EUR"))).otherwise(
                         F.concat(F.lit("Sum "), new)).alias("new_text"))


FMT = lambda e: f"format('{{:t,.2f}}', CAST({e} AS DOUBLE))"
cte("tax", r"""SELECT l_orderkey, l_linenumber, l_returnflag AS flag, 'Amount ' || p || ' EUR' AS old_text,
  CASE WHEN l_returnflag = 'A' THEN 'Amount ' || translate(translate(translate(p, ',', '#'), '.', ','), '#', '.')
       WHEN l_returnflag = 'R' THEN 'Amount ' || n || ' EUR' ELSE 'Sum ' || n END AS new_text
  FROM (SELECT *, printf('%,.2f', CAST(l_extendedprice AS DOUBLE)) AS p,
          printf('%,.2f', CAST(l_extendedprice * (l_linenumber + 1) / 2 AS DOUBLE)) AS n FROM lineitem)""")


@query("h9_numeric_delta", with_(f"""SELECT l_orderkey, l_linenumber, round(CAST(n - o AS DOUBLE), 4) AS delta,
    CASE WHEN abs(o) >= 0.0001 THEN round(CAST(n - o AS DOUBLE) / abs(CAST(o AS DOUBLE)) * 100, 4) END AS percent,
    abs(n - o) < 0.0001 AND len(a) = len(b) AS same
  FROM (SELECT *, CASE WHEN i IS NULL THEN a[-1] ELSE a[i] END AS o, CASE WHEN i IS NULL THEN b[-1] ELSE b[i] END AS n FROM (
    SELECT *, list_filter(range(1, least(len(a), len(b)) + 1), lambda k: abs(a[k] - b[k]) >= 0.0001)[1] AS i FROM (
    SELECT *, {NUMBERS % 'old_text'} AS a, {NUMBERS % 'new_text'} AS b FROM tax)))""", "tax"))
def h9(spark, sf_dir):
    d = tax_pairs(spark, sf_dir).withColumn("d", A.numeric_delta(F.col("old_text"), F.col("new_text")))
    return d.select("l_orderkey", "l_linenumber", F.round("d.delta", 4).alias("delta"), F.round("d.percent", 4).alias("percent"),
                    F.col("d.same").alias("same"))


@query("h15_block_signature", with_(r"""SELECT l_orderkey, l_linenumber, '4|' || trim(regexp_replace(old_text, '\s+', ' ', 'g')) || '|' ||
  trim(regexp_replace(new_text, '\s+', ' ', 'g')) AS signature FROM tax""", "tax"))
def h15(spark, sf_dir):
    from veridoc.operators.blocks import signature
    return tax_pairs(spark, sf_dir).select("l_orderkey", "l_linenumber", signature(F.lit(4), F.col("old_text"), F.col("new_text")).alias("signature"))


@query("h16_row_key", with_("SELECT l_orderkey, l_linenumber, upper(substr(sha256('Bank • ' || flag || '|4|' || old_text || '|' || new_text), 1, 16)) AS row_key FROM tax", "tax"))
def h16(spark, sf_dir):
    from veridoc.operators.blocks import row_key, signature
    d = tax_pairs(spark, sf_dir)
    return d.select("l_orderkey", "l_linenumber", row_key(F.concat(F.lit("Bank • "), "flag"), signature(
        F.lit(4), F.col("old_text"), F.col("new_text"))).alias("row_key"))


@query("h17_safe_key", r"""SELECT page_id, CASE WHEN length(k) > 85 THEN substr(k, 1, 74) || '_' || upper(substr(sha256(url), 1, 8))
    WHEN trim(k) = '' THEN 'Doc' ELSE k END AS k FROM (SELECT page_id, url, replace(regexp_replace(trim(regexp_replace(url,
    '[<>:"/\\|?*\x00-\x1f\[\]•]', '_', 'g'), '_'), '__+', '_', 'g'), ' ', '_') AS k FROM (
    SELECT page_id, url || ' ' || html AS url FROM pages))""")
def h17(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("url"))
    return p.select("page_id", P.safe_key(F.col("url")).alias("k"))


@query("h18_flexible_pattern", r"""SELECT item_id, CASE WHEN regexp_matches(t, '^[\p{L}\p{Nd}]') THEN '(?<![\p{L}\p{N}])' ELSE '' END ||
   array_to_string(list_transform(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''),
     lambda w: regexp_replace(w, '([\\*+?|{\[()^$.#])', '\\\1', 'g')), '\s+') ||
   CASE WHEN regexp_matches(t, '[\p{L}\p{Nd}]$') THEN '(?![\p{L}\p{N}])' ELSE '' END AS pattern
  FROM (SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM benchmark)""")
def h18(spark, sf_dir):
    b = corpus.table(spark, sf_dir, "benchmark")
    return b.select("item_id", X.flexible_pattern(F.col("text")).alias("pattern"))


@query("h14_templates", """SELECT doc_id, '2026_R' || (doc_id % 12 + 1) || '/' || source AS target, source AS first_seg,
  array_to_string(list_sort(list_distinct(list_transform(['src1', lang, source], lambda x: upper(x)))), ',') AS names FROM documents""")
def h14(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    rel = P.release_name(F.lit(2026), F.col("doc_id") % 12 + 1)
    return d.select("doc_id", P.expand_template(F.concat(F.lit("/{release}/"), "source"), rel).alias("target"),
                    P.first_segment(F.concat(F.lit("/"), "source", F.lit("/x"))).alias("first_seg"),
                    F.array_join(F.sort_array(P.csv_set(F.concat(F.lit("src1 ;, "), "lang", F.lit(","), "source"), [])), ",").alias("names"))


@query("h13_releases", """SELECT DISTINCT '2026_R' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS release,
  2026 * 100 + month(o_orderdate) AS sort_key FROM orders""".replace("2026_R' ||", "' || year(o_orderdate) || '_R' ||").replace("'' || ", "").replace(
    "2026 * 100", "(CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) * 100 ELSE 0 END)").replace(
    "+ month(o_orderdate) AS", "+ (CASE WHEN year(o_orderdate) >= 2000 THEN month(o_orderdate) ELSE 0 END) AS"))
def h13(spark, sf_dir):
    o = corpus.table(spark, sf_dir, "orders").select(F.concat(F.year("o_orderdate"), F.lit("_R"), F.lpad(
        F.month("o_orderdate").cast("string"), 2, "0")).alias("release")).distinct()
    return o.select("release", P.release_order(F.col("release")).cast("long").alias("sort_key"))


@query("h24_truncate_one_line", r"""SELECT doc_id, CASE WHEN length(t) <= 36 THEN t ELSE substr(t, 1, 36) || '…' END AS short FROM (
  SELECT doc_id, trim(regexp_replace(text, '\r?\n', ' ', 'g')) AS t FROM documents)""")
def h24(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.one_line(F.col("text"), 36).alias("short"))


@query("h26_strip_title_badge", "SELECT page_id, url AS name FROM pages")
def h26(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "pages")
    return p.select("page_id", X.strip_badge(F.concat(F.lit("[Bank • X] "), "url")).alias("name"))


@query("b12_is_masked_token", r"""SELECT doc_id, count_if((starts_with(k, '[') AND contains(k, ']')) OR contains(k, '_IGNORE]')
  OR contains(k, '[IGNORED') OR contains(k, '[MASKED]'))::BIGINT AS n_masked FROM (SELECT doc_id, unnest(list_transform(
   regexp_split_to_array(text, '\s+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '[' || x || ']' ELSE x END)) AS k FROM documents) GROUP BY ALL""")
def b12(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.expr(
        r"transform(split(text, '\\s+'), x -> case when x rlike '[0-9]' then concat('[', x, ']') else x end)")).alias("k"))
    return d.groupBy("doc_id").agg(F.count_if(X.is_masked(F.col("k"))).alias("n_masked"))


# --- product and channel -----------------------------------------------------------------------------
LISTS = lambda vals: "[" + ", ".join("'" + Q(v.upper()) + "'" for v in vals) + "]"
STRUCT, ROLE = LISTS(P.STRUCTURAL_FOLDERS), LISTS(P.SOURCE_FOLDERS + P.TARGET_FOLDERS + P.OUTPUT_FOLDERS)


@query("h11_resolve_product", with_("SELECT doc_id, product AS resolved FROM docs WHERE side = 'T'", "docs"))
def h11(spark, sf_dir):
    p = id_pairs(spark, sf_dir)
    return p.select("doc_id", P.resolve_product(F.lit("Docs"), F.col("source_path"), F.col("target_path")).alias("resolved"))


@query("h12_resolve_channel", with_("SELECT doc_id, channel AS resolved FROM docs WHERE side = 'T'", "docs"))
def h12(spark, sf_dir):
    p = id_pairs(spark, sf_dir)
    return p.select("doc_id", P.resolve_channel(F.lit(""), F.col("source_path"), F.col("target_path"), F.col("product")).alias("resolved"))
