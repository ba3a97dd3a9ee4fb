"""Masking queries."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from veridoc.operators import masking as M, names as N, words as O
from veridoc.plans.oracle import cte, with_
from veridoc.plans.q_words import DIGEST, KEYS, digest
from veridoc.plans.registry import query
from veridoc.sources import corpus, rules as R

RULE_ROWS = R.DEFAULT_REGEXES + [
    ("drop_x", 4, "User rule: words with an inserted x", r"xth[a-z]+", "", "", "", True, False, True, 1),
    ("equal", 5, "User rule: A = B", r"(?:\d{3},00|\d{4},00)", "[EQUI_IGNORE]", "", "", True, True, True, 1),
    ("bad", 6, "Does not compile", "([", "", "", "", True, True, True, 1)]


def rules(spark):
    return R.usable_rules(spark, R.regex_table(spark, RULE_ROWS))[0]


DATE = R.DEFAULT_REGEXES[0][3]
norm_sql = lambda c: (rf"CASE WHEN regexp_matches({c}, '{DATE}') THEN trim(regexp_replace({c}, '[^0-9]+', '.', 'g'), '.') ELSE upper(trim({c})) END")
EXTRACT = {r[0]: ("(?i)" if r[8] else "") + r[3] for r in RULE_ROWS if r[0] != "bad"}
MIN = {r[0]: r[10] for r in RULE_ROWS}
cte("occ", " UNION ALL ".join(f"SELECT side, doc_id, '{k}' AS rule_id, {MIN[k]} AS min_occurrences, {norm_sql('m')} AS norm FROM "
                              f"(SELECT side, doc_id, unnest(regexp_extract_all(text, '{p}')) AS m FROM dtext)" for k, p in EXTRACT.items()), "dtext")


def texts(spark, sf_dir):
    return O.masked_text(corpus.both_words(spark, sf_dir), KEYS)


@query("g16_token_occurrences", with_("SELECT side, doc_id, rule_id, min_occurrences, norm, count(*) AS n FROM occ GROUP BY ALL", "occ"))
def g16(spark, sf_dir):
    return M.token_occurrences(texts(spark, sf_dir), KEYS, rules(spark))


REPEATED = f"""SELECT side, doc_id, list(norm) AS norms FROM (SELECT side, doc_id, norm FROM occ WHERE rule_id = 'dates' GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL"""
cte("rep", REPEATED, "occ")
# Dates are single tokens of this corpus, so masking them token by token equals masking the text.
cte("masked", rf"""SELECT side, doc_id, regexp_replace(regexp_replace(regexp_replace(CASE WHEN norms IS NULL THEN text ELSE
    array_to_string(list_transform(regexp_split_to_array(text, ' '), lambda t: array_to_string(list_transform(regexp_split_to_array(t, '\n'), lambda u:
      CASE WHEN regexp_matches(u, '{DATE}') AND list_contains(norms, {norm_sql('u')}) THEN regexp_replace(u, '{DATE}', '[DATE_IGNORE]') ELSE u END), chr(10))), ' ') END,
    '(?i)#[A-Z0-9_]+#', '', 'g'), '{EXTRACT["drop_x"]}', '', 'g'), '{EXTRACT["equal"]}', '[EQUI_IGNORE]', 'g') AS text
  FROM dtext LEFT JOIN rep USING (side, doc_id)""", "dtext", "rep")


@query("h21_mask_text", with_("SELECT side, doc_id, length(text) AS n_chars, md5(text) AS digest FROM masked", "masked"))
def h21(spark, sf_dir):
    t = M.mask_text(texts(spark, sf_dir), rules(spark))
    return t.select("side", "doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


cte("kwords", rf"""SELECT * FROM (SELECT side, doc_id, page, pos, x0, CASE
   WHEN regexp_matches(text, '{DATE}') AND norms IS NOT NULL AND list_contains(norms, {norm_sql('text')}) THEN '[DATE_IGNORE]'
   WHEN regexp_matches(text, '{EXTRACT["drop_x"]}') THEN CASE WHEN regexp_matches(regexp_replace(text, '{EXTRACT["drop_x"]}', ''), '[\p{{L}}\p{{Nd}}]')
        THEN regexp_replace(text, '{EXTRACT["drop_x"]}', '') ELSE '' END
   WHEN regexp_matches(text, '^{EXTRACT["equal"].replace("(?i)", "")}$') THEN '[EQUI_IGNORE]' ELSE text END AS text
  FROM words LEFT JOIN rep USING (side, doc_id)) WHERE text <> ''""", "words", "rep")


@query("k1_mask_words", with_("""SELECT side, doc_id, count(*) AS n_words, round(sum(x0), 3) AS sum_x, count_if(text = '[DATE_IGNORE]')::BIGINT AS dates,
  count_if(text = '[EQUI_IGNORE]')::BIGINT AS equal, md5(string_agg(text, ' ' ORDER BY pos)) AS digest FROM kwords GROUP BY ALL""", "kwords"))
def k1(spark, sf_dir):
    w = M.mask_words(corpus.both_words(spark, sf_dir).select("side", "doc_id", "page", "pos", "text", "x0", "x1", "y0"), KEYS, rules(spark))
    return w.groupBy("side", "doc_id").agg(
        F.count("*").alias("n_words"), F.round(F.sum("x0"), 3).alias("sum_x"), F.count_if(F.col("text") == "[DATE_IGNORE]").alias("dates"),
        F.count_if(F.col("text") == "[EQUI_IGNORE]").alias("equal"), F.md5(F.expr("listagg(text, ' ') within group (order by pos)")).alias("digest"))


def named_words(spark, sf_dir):
    """Words with role labels at line starts, a name to their right, and the name again further on."""
    w = corpus.both_words(spark, sf_dir)
    return w.withColumn("text", F.when(F.col("pos") % 240 == 0, "Souscripteur").when(
        (F.col("pos") % 240 == 1) | (F.col("pos") % 300 == 100), "Jean").when(
        (F.col("pos") % 240 == 2) | (F.col("pos") % 300 == 101), "DUPONT,").when(F.col("pos") % 300 == 150, "Monsieur").when(
        F.col("pos") % 300 == 151, "Dupont").otherwise(F.col("text"))).withColumn("x1", F.col("x0") + 5.0 * F.least(F.length("text"), F.lit(7)))


cte("nwords", """SELECT side, doc_id, lang, pos, x0, CASE WHEN pos % 240 = 0 THEN 'Souscripteur' WHEN pos % 240 = 1 OR pos % 300 = 100 THEN 'Jean'
  WHEN pos % 240 = 2 OR pos % 300 = 101 THEN 'DUPONT,' WHEN pos % 300 = 150 THEN 'Monsieur' WHEN pos % 300 = 151 THEN 'Dupont' ELSE text END AS text,
  max(pos) OVER (PARTITION BY side, doc_id) AS last_pos FROM words""", "words")


@query("k2_mask_client_names", with_("""SELECT side, doc_id, count(*) AS n_words, round(sum(x0), 3) AS sum_x, count_if(starts_with(text, '[NOM'))::BIGINT AS masked,
   md5(string_agg(text, ' ' ORDER BY pos)) AS digest FROM (SELECT side, doc_id, pos, x0, CASE WHEN text = 'Jean' AND nxt = 'DUPONT,' THEN '[NOM_IGNORE],'
      WHEN last_pos >= 2 AND text = 'Dupont' AND prv = 'Monsieur' THEN '[NOM_IGNORE]' ELSE text END AS text FROM
   (SELECT *, lead(text) OVER d AS nxt, lag(text) OVER d AS prv FROM nwords WINDOW d AS (PARTITION BY side, doc_id ORDER BY pos))
   WHERE NOT (text = 'DUPONT,' AND prv = 'Jean')) GROUP BY ALL""", "nwords"))
def k2(spark, sf_dir):
    w = N.mask_client_names(named_words(spark, sf_dir), KEYS)
    return w.groupBy("side", "doc_id").agg(
        F.count("*").alias("n_words"), F.round(F.sum("x0"), 3).alias("sum_x"), F.count_if(F.col("text").startswith("[NOM")).alias("masked"),
        F.md5(F.expr("listagg(text, ' ') within group (order by pos)")).alias("digest"))


@query("h22_person_name_parts", r"""SELECT conv_id, turn, CASE WHEN len(p) >= 2 THEN array_to_string(p, ' ') END AS name FROM (SELECT conv_id, turn,
  ['Jean', 'van'] || list_filter([regexp_extract(text, '^[A-Za-z]+', 0)], lambda x: regexp_matches(x, '^[A-Z][A-Za-z]+$') AND upper(x) NOT IN
   ('VAN', 'DE', 'DER', 'DEN', 'HET', 'TEN', 'TER', 'TE', 'DU', 'DES', 'LE', 'LA', 'VON', 'ZU', 'ZUM', 'ZUR', {stops})) AS q, CASE WHEN len(q) = 3 THEN q ELSE ['Jean'] END AS p FROM conversations)""".replace(
    "{stops}", ", ".join("'" + s.upper() + "'" for s in N.STOP_WORDS)))
def h22(spark, sf_dir):
    c = corpus.table(spark, sf_dir, "conversations")
    toks = F.array(F.lit("Mme"), F.lit("Jean"), F.lit("van"), F.concat(F.regexp_extract("text", "^[A-Za-z]+", 0), F.lit(",")), F.lit("Xavier"))
    return c.select("conv_id", "turn", F.array_join(N.person_name_parts(toks, False), " ").alias("name"))


@query("k3_sanitize_block_text", rf"""SELECT doc_id, md5(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(text), '(?i)#[A-Z0-9_]+#', '', 'g')),
   '{EXTRACT["drop_x"]}', '', 'g')), '{EXTRACT["equal"]}', '[EQUI_IGNORE]', 'g'))) AS digest FROM documents""")
def k3(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(M.sanitize_block_text(F.col("text"), rules(spark))).alias("digest"))


@query("a6_rule_errors")
def a6(spark, sf_dir):
    """Rules whose pattern does not compile, with the number of documents they would have applied to."""
    _, bad = R.usable_rules(spark, R.regex_table(spark, RULE_ROWS))
    errors = spark.createDataFrame(bad, "rule_id string, error string")
    n = corpus.files(spark, sf_dir, "S").agg(F.count("*").alias("n_documents"))
    return errors.select("rule_id").join(n, F.lit(True))
