"""Rule tables: exclusion zones and regex rules, their profile file, and the checks on them.

Rules are configuration: a few rows typed by users. They are built on the driver and joined as
small tables; nothing derived from the documents is collected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ZONE_SCHEMA = ("rule_id string, rule_order int, name string, is_enabled boolean, is_user_zone boolean, "
               "collect_dates boolean, product_filter string, page_scope string, page_start int, page_end int, "
               "unit string, origin string, x double, y double, width double, height double")
REGEX_SCHEMA = ("rule_id string, rule_order int, name string, pattern string, replacement_mask string, "
                "product_filter string, ignored_signature string, is_enabled boolean, ignore_case boolean, "
                "is_user_rule boolean, min_occurrences int")
PROFILE_SCHEMA = ("profile_name string, enable_name_masking boolean, name_mask string, min_font_size double, "
                  "max_font_size double, fragment_font_size double, ignore_white_text boolean, file_key_regex string, "
                  f"critical_regex string, zones array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in ZONE_SCHEMA.split(','))}>>, "
                  f"regexes array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in REGEX_SCHEMA.split(','))}>>")

# The built-in date mask and the built-in zones (header, footer, left margin).
DATE_MASK = "[DATE_IGNORE]"
DEFAULT_ZONES = [
    ("header", 1, "Header 130 pt", True, False, True, "", "AllPages", None, None, "PdfPoints", "TopLeft", 0.0, 0.0, 2000.0, 130.0),
    ("footer", 2, "Footer 40 pt", True, False, False, "", "AllPages", None, None, "PdfPoints", "BottomLeft", 0.0, 0.0, 2000.0, 40.0),
    ("margin", 3, "Left margin 28 pt", True, False, False, "", "AllPages", None, None, "PdfPoints", "TopLeft", 0.0, 0.0, 28.0, 2000.0),
]
DEFAULT_REGEXES = [
    ("dates", 1, "Repeated dates", r"\b\d{1,2}[./\-\s]+\d{1,2}[./\-\s]+\d{2,4}\b", DATE_MASK, "", "", True, True, False, 2),
    ("anchors", 3, "Signature anchors", r"#[A-Z0-9_]+#", "", "", "", True, True, False, 1),
]


def zone_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(DEFAULT_ZONES if rows is None else rows, ZONE_SCHEMA)


def regex_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(DEFAULT_REGEXES if rows is None else rows, REGEX_SCHEMA)


def pattern_error(spark: SparkSession, pattern: str) -> str | None:
    """The JVM's message for a pattern it cannot compile, else null."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return None
    except Exception as err:  # py4j wraps PatternSyntaxException
        return str(err).strip().splitlines()[-1][:300]


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    """Unicode classes and, on request, Unicode case folding."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def usable_rules(spark: SparkSession, rules: DataFrame) -> tuple[list, list]:
    """Enabled rules in order, and (rule_id, error) of those whose pattern does not compile."""
    good, bad = [], []
    for r in sorted(rules.collect(), key=lambda r: r.rule_order):
        if not r.is_enabled or not (r.pattern or "").strip():
            continue
        err = pattern_error(spark, java_pattern(r.pattern, r.ignore_case))
        (bad.append((r.rule_id, err)) if err else good.append(r))
    return good, bad


def load_profile(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A profile JSON -> its settings, `zones`, `regexes` and `rule_errors`. An unreadable file is an error row."""
    raw = spark.read.schema(PROFILE_SCHEMA + ", _bad string").option("multiLine", True).option(
        "columnNameOfCorruptRecord", "_bad").json(path)
    raw = raw.cache()
    zones = raw.where("_bad is null").select(F.explode("zones").alias("z")).select("z.*")
    regexes = raw.where("_bad is null").select(F.explode("regexes").alias("r")).select("r.*")
    _, bad = usable_rules(spark, regexes)
    errors = spark.createDataFrame(bad, "rule_id string, error string").union(
        raw.where("_bad is not null").select(F.lit("profile"), F.lit("invalid profile file")))
    return {"settings": raw.where("_bad is null").drop("zones", "regexes", "_bad"), "zones": zones, "regexes": regexes,
            "rule_errors": errors}


def save_profile(settings: DataFrame, zones: DataFrame, regexes: DataFrame, path: str) -> None:
    """One JSON document; the commit protocol makes the overwrite atomic per run folder."""
    pack = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)).withColumn("_k", F.lit(1))
    settings.withColumn("_k", F.lit(1)).join(pack(zones, "zones"), "_k").join(pack(regexes, "regexes"), "_k").drop(
        "_k").coalesce(1).write.mode("overwrite").json(path)


def page_scope(page, total, scope, start, end):
    """Does a rule with this page scope apply to the page?"""
    return (F.when(scope == "FirstPageOnly", page == 1).when(scope == "LastPageOnly", page == total)
            .when(scope == "EvenPages", page % 2 == 0).when(scope == "OddPages", page % 2 != 0)
            .when(scope == "CustomRange", (start.isNull() | (page >= start)) & (end.isNull() | (page <= end)))
            .otherwise(F.lit(True)))


# Scopes that mean all products (fixed values).
EVERYWHERE = ["*", "GLOBAL", "GLOBALE", "TOUS", "ALL"]


def is_global(product_filter):
    p = F.trim(F.coalesce(product_filter, F.lit("")))
    return (p == "") | F.upper(p).isin(EVERYWHERE)


def scope_keys(rules: DataFrame) -> DataFrame:
    """One row per rule and scope token: `scope_key` is null for rules that apply everywhere."""
    norm = lambda t: F.upper(F.regexp_replace(F.translate(F.trim(F.translate(F.trim(t), "[]", "  ")), "•\\", "//"),
                                              r"\s*/\s*", "/"))
    toks = F.transform(F.filter(F.split(F.coalesce("product_filter", F.lit("")), r"[,;|]"), lambda t: F.trim(t) != ""), norm)
    everywhere = is_global(F.col("product_filter")) | (F.size(toks) == 0) | F.exists(toks, is_global)
    return rules.withColumn("scope_key", F.explode(F.when(everywhere, F.array(F.lit(None).cast("string"))).otherwise(
        F.array_distinct(toks))))


def document_keys(product, raw_product, channel, family):
    """All upper-case tokens a rule scope may name to catch a document."""
    keys = F.array(F.upper(product), F.upper(raw_product), F.upper(family),
                   F.upper(F.concat(channel, F.lit("/"), product)), F.upper(F.concat(channel, F.lit("/"), raw_product)))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def family_pattern(prefix: str) -> str:
    """Code of a document template in a file name: the organisation's prefix and up to four parts, before language or number."""
    return rf"(?i)(?<![A-Za-z0-9])({prefix}[A-Z0-9]+(?:_[A-Za-z0-9]+){{1,4}}?)(?=_(?:FR|NL|DE|EN)(?![A-Za-z0-9])|_+\d|$)"


def template_family(stem_col, prefix: str = "TPL"):
    code = F.regexp_replace(F.regexp_extract(stem_col, family_pattern(prefix), 1), "^_+|_+$", "")
    return F.when(code != "", code)


def rules_for_documents(docs: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule_id): enabled rules in force per document. `docs` has `scope_keys` (array)."""
    scoped = scope_keys(rules.where("is_enabled")).select("rule_id", "scope_key")
    by_key = docs.select(*keys, F.explode("scope_keys").alias("scope_key")).join(scoped, "scope_key").select(*keys, "rule_id")
    # Global rules are configuration (a handful of ids): one literal array per document, no join.
    ids = sorted(r.rule_id for r in scoped.where("scope_key is null").select("rule_id").distinct().collect())
    everywhere = docs.select(*keys, F.explode(F.array(*[F.lit(i) for i in ids]).cast("array<string>")).alias("rule_id"))
    return by_key.union(everywhere).distinct()
