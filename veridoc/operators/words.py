"""From scanned tokens to clean words, lines and texts.

Keys name the document (for example ["side", "doc_id"]). Windows run per document and page; words that were
hashed by document before they were expanded stay in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from veridoc.functions.text import fold
from veridoc.operators import pages as P

# Watermark words, fragments of large print, and patterns around them.
WATERMARK_WORDS = ["SPECIMEN", "SPECIMENS", "SPECIME", "SPECIM", "PECIMEN", "ECIMEN", "TOTEIN", "ECIMIEN"]
WATERMARK_FRAGMENTS = ["SPECIMEN", "SPECIME", "SPECIM", "PECIMEN", "ECIMEN", "CIMEN", "SPECI", "IMEN", "TOTEIN", "TEST",
                       "ECIMIEN"]
WATERMARK_CODES = ["Q000", "D000", "P000", "A000"]
ANCHOR = r"(?i)#[A-Z0-9_]+#"
PROTECTED = r"(?i)^[\d.,/\-\s€$£]+(?:EUR)?$"
CODE = r"(?i)^(Q|D|P|A)0{1,3}$"
STAMP = r"(?i)\[\s*DOCUMENT\s+(SOURCE|CIBLE).*?\]"
SPLIT_TOKEN = r"^(?:\(?\d{1,2}[./\-]\d{1,2}(?:[./\-]\d{2,4})?[.,;:)]?|0\d{3}\.\d{3}\.\d{3}[.,;:)]?)$"
# Copy mentions at the foot of a page and the words that make them part of a sentence.
COPY_HEADS = ["exemplaires", "exemplaire", "exemplaren", "exemplaar", "exemplare", "exemplar", "ausfertigungen",
              "ausfertigung", "esemplari", "esemplare", "ejemplares", "ejemplar"]
COPY_WORDS = ["copie", "kopie", "copy"]
COUNT_WORDS = ["1", "2", "3", "4", "5", "un", "une", "d'un", "d’un", "deux", "trois", "quatre", "en", "een", "twee",
               "drie", "vier", "in", "ein", "eine", "einen", "einem", "zwei", "drei", "one", "two", "three"]
CONTRACT_NOUNS = ["conditions", "voorwaarden", "bedingungen", "terms", "contrat", "contrats", "overeenkomst", "vertrag",
                  "règlement", "reglement", "clause", "clauses"]


def filter_visible_words(words: DataFrame, min_font: float = 1.8, ignore_white: bool = True) -> DataFrame:
    off_page = (F.col("x1") < 0) | (F.col("x0") > F.col("page_w")) | (F.col("y1") < 0) | (F.col("y0") > F.col("page_h"))
    margin = ~F.col("horizontal") & ((F.col("x1") <= 28) | (F.col("x0") >= F.col("page_w") - 24))
    tiny = (F.col("font_size") < max(1.8, min_font)) | (F.col("glyph_span") <= 0.1)
    hidden = off_page | margin | tiny | (F.col("n_letters") == 0) | (F.trim("text") == "")
    if ignore_white:
        hidden = hidden | (F.col("grey") >= 0.94)
    return words.where(~hidden)


def is_watermark(text: Column, font: Column, exact: list[str] = WATERMARK_WORDS,
                 fragments: list[str] = WATERMARK_FRAGMENTS, fragment_font: float = 16.0, max_font: float = 42.0) -> Column:
    text = F.trim(text)
    holds = F.lit(False)
    for f in fragments:
        holds = holds | F.upper(text).contains(f.upper())
    # A test for one letter or the length spares most words the pattern.
    return (F.when(text.contains("#") & text.rlike(ANCHOR), True).when(text.rlike(PROTECTED), False)
            .when((F.length(text) <= 6) & text.rlike(CODE), True)
            .when(F.upper(text).isin([w.upper() for w in exact]), True)
            .when((font >= fragment_font) & holds, True).otherwise(font > max_font))


def filter_watermark_words(words: DataFrame, **options) -> DataFrame:
    return words.where(~is_watermark(F.col("text"), F.col("font_size"), **options))


def clean_raw(text: Column, exact: list[str] = WATERMARK_WORDS) -> Column:
    words = r"(?i)\b(?:" + "|".join(exact + WATERMARK_CODES) + r")\b"
    # Most words hold no anchor and no stamp, which a test for their first letter tells.
    inner = F.regexp_replace(F.when(text.contains("#"), F.regexp_replace(text, ANCHOR, "")).otherwise(text), words, "")
    return F.when(text.contains("["), F.regexp_replace(inner, STAMP, "")).otherwise(inner)


def clean_raw_token(words: DataFrame, **options) -> DataFrame:
    return words.withColumn("text", clean_raw(F.col("text"), **options)).where(F.trim("text") != "")


def visual_lines(words: DataFrame, keys: list[str], tolerance: Column | None = None, touching: bool = True) -> DataFrame:
    """Adds `line_no` (0.. per page, top down): a new line starts where the gap to the word above exceeds the tolerance.

    `touching`: a gap equal to the tolerance stays on the line (scan form); otherwise it starts a new one.
    """
    tol = F.lit(3.0) if tolerance is None else tolerance
    page = W.partitionBy(*keys, "page").orderBy(F.desc("y0"), "x0", "pos", *(["sub"] if "sub" in words.columns else []))
    gap = F.lag("y0").over(page) - F.col("y0")
    brk = F.when((gap > tol) if touching else (gap >= tol), 1).otherwise(0)
    return words.withColumn("_brk", brk).withColumn(
        "line_no", F.sum("_brk").over(page.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_brk")


def sanitizer_lines(words: DataFrame, keys: list[str], keep: Column | None = None) -> DataFrame:
    """Adds `line_no` (0.. per page, top down): a word joins the line whose running mean height is nearest, if that is nearer
    than the word's tolerance (4.5, or 0.48 of its font size if that is more); else it starts a line. The mean takes in each word that joins.

    Words come from the top down (ties: left to right, then by position), so no mean is below a word that is still to come, and a line that a word
    starts lies below all others and stays there, as only it takes words from then on. The nearest line is thus always the
    last one, and the fold over the words of a page carries one sum and one count, whatever the number of lines; only words
    that the word before and the first one of the line leave open are folded. A document is one array meanwhile; `mean_y` is the mean of the whole line. Words without a height make lines of their own.
    Words for which `keep` does not hold are left out.
    """
    return P.lined_by_mean(words, keys, keep)


def _line(keys: list[str]) -> W:
    return W.partitionBy(*keys, "page", "line_no").orderBy("x0", "pos", "sub")


def _glue(words: DataFrame, keys: list[str], glued: Column, keep: list[str]) -> DataFrame:
    """Merge runs of glued words of a line into one word.

    Nearly every run is a single word. Runs are read by a window, whose rows are sorted by document already; a hash aggregate
    would hold a state for each word.
    """
    line = _line(keys)
    runs = words.withColumn("_new", F.when(glued, 0).otherwise(1)).withColumn(
        "_run", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    group = [*keys, "page", "line_no"]
    run = W.partitionBy(*group, "_run").orderBy("x0", "pos", "sub")
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    text = F.collect_list("text").over(whole)
    every = runs.select(
        *group, F.row_number().over(run).alias("_k"), text.alias("_text"), F.min("x0").over(whole).alias("x0"),
        F.min("y0").over(whole).alias("y0"), F.max("x1").over(whole).alias("x1"), F.max("y1").over(whole).alias("y1"), *keep)
    return every.where("_k = 1").select(
        *group, F.when(F.size("_text") > 0, F.array_join("_text", "")).alias("text"), "x0", "y0", "x1", "y1", *keep)


def _glued_step(words: DataFrame, keys: list[str], run, keep: list[str]) -> DataFrame:
    """`_glue` as a step on the arrays of documents."""
    kept = list(dict.fromkeys(["page", "line_no", "text", "x0", "y0", "x1", "y1", *keep]))

    def fields(before: list[T.StructField]) -> list[T.StructField]:
        kinds = {f.name: f.dataType for f in before}
        return [T.StructField(c, kinds[c]) for c in kept]

    return P.with_step(words, keys, run, fields, [*keys, *kept])


def merge_touching(words: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Skip exact overprints, then glue touching fragments and the halves of a split date or number."""
    line = _line(keys)
    prev = lambda c: F.lag(c).over(line)
    dy = lambda: F.abs(F.col("y0") - prev("y0"))
    copy = (dy() <= 1.5) & (F.abs(F.col("x0") - prev("x0")) <= 0.8) & (F.col("text") == prev("text"))
    single = words.withColumn("_copy", F.coalesce(copy, F.lit(False))).where("not _copy").drop("_copy")
    gap = F.col("x0") - prev("x1")
    bound = (prev("text").rlike(r"[./]$") | F.col("text").rlike(r"^[./]")) & prev("text").rlike(r"\d") & F.col("text").rlike(r"\d")
    half = bound & F.concat(prev("text"), F.col("text")).rlike(SPLIT_TOKEN)
    glued = (dy() <= 2.4) & (gap >= -1.2) & ((gap <= 0.75) | ((gap <= 2.6) & half))
    return _glue(single, keys, F.coalesce(glued, F.lit(False)), keep)


def dedupe_overprint_words(words: DataFrame, keys: list[str]) -> DataFrame:
    if P.waits(words, keys):
        return P.with_step(words, keys, P.without_overprints, list, words.columns)
    line = _line(keys)
    prev = lambda c: F.lag(c).over(line)
    copy = ((F.col("x0") < prev("x1") - 0.5) & (F.abs(F.col("x0") - prev("x0")) <= F.greatest(F.lit(1.5), prev("font_size") * 0.18))
            & (F.col("text") == prev("text")))
    return words.withColumn("_copy", F.coalesce(copy, F.lit(False))).where("not _copy").drop("_copy")


def merge_kerning_and_numbers(words: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Glue kerning splits and digits followed by digits or a currency sign."""
    if P.waits(words, keys):
        return _glued_step(words, keys, P.kerning(keep), keep)
    line = _line(keys)
    prev = lambda c: F.lag(c).over(line)
    gap, font = F.col("x0") - prev("x1"), prev("font_size")
    number = prev("text").rlike(r"^\d{1,12}$") & F.col("text").rlike(r"^[\d€$£%]+$")
    glued = (gap >= -1.5) & ((gap <= F.greatest(F.lit(1.8), font * 0.22)) | ((gap <= F.greatest(F.lit(5.0), font * 0.7)) & number))
    return _glue(words, keys, F.coalesce(glued, F.lit(False)), keep)


def dedupe_overprint_glyphs(words: DataFrame, letters: str = "letters") -> DataFrame:
    """Drop a letter printed again at the same place (fake bold): letters are array<struct<ch, x0, x1, y, size>>.

    A letter repeats its left neighbour when both sit within the tolerances; neighbours are compared as
    given, so a letter printed three times still collapses to one.
    """
    at = lambda i: F.element_at(letters, i)
    same = lambda a, b: ((a.ch == b.ch) & (F.abs(a.y - b.y) <= F.greatest(F.lit(0.8), b.size * 0.1))
                         & (F.abs(a.x0 - b.x0) <= F.greatest(F.lit(0.45), b.size * 0.06))
                         & ((a.x1 - a.x0 <= 0.2) | (b.x0 < a.x1 - (a.x1 - a.x0) * 0.4)))
    index = F.filter(F.sequence(F.lit(1), F.size(letters)), lambda i: F.when(i == 1, True).otherwise(
        ~same(F.element_at(letters, F.greatest(i - 1, F.lit(1))), at(i))))
    return words.withColumn(letters, F.when(F.size(letters) > 0, F.transform(index, at)).otherwise(F.col(letters)))


def strip_footer_mentions(words: DataFrame, keys: list[str]) -> DataFrame:
    """Cut copy mentions ("copy for the customer ...") off the lines at the foot of a page. Needs `line_no`."""
    line = W.partitionBy(*keys, "page", "line_no").orderBy("x0", "pos")
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"^[.,;:()\[\]\"«»]+|[.,;:()\[\]\"«»]+$", ""))
    w = (words.withColumn("_k", F.row_number().over(line) - 1).withColumn("_n", F.count("*").over(whole))
         .withColumn("_norm", norm(F.col("text")))
         .withColumn("_first_y", F.first("y0").over(whole)).withColumn("_last", F.last("_norm").over(whole)))
    # The word before the first one of a line is the last one of the line above. Words without a page or document have no foot.
    page = W.partitionBy(*keys, "page").orderBy("line_no", "x0", "pos")
    w = w.where(" and ".join(f"`{c}` is not null" for c in (*keys, "page", "line_no"))).withColumn(
        "_above_y", F.lag("_first_y").over(page)).withColumn("_above_last", F.lag("_last").over(page))
    head = F.regexp_replace(F.trim("text"), r"^[()\[\]\-–•:;,.]+|[()\[\]\-–•:;,.]+$", "")
    heads_rx = "|".join(COPY_HEADS)
    left = F.col("_n") - F.col("_k")
    is_head = (F.length(head) >= 4) & (
        head.rlike(rf"(?i)^(?:{heads_rx})(?:$|[^\p{{L}}])") | (head.rlike(rf"(?i)^(?:{heads_rx})") & head.contains("/"))
        | (F.lower(head).isin(COPY_WORDS) & (left >= 2)))
    starts = ((F.col("_k") == 0) | (F.col("x0") - F.lag("x1").over(line) >= 16.0) | F.lag("text").over(line).endswith("."))
    before = F.when(F.col("_k") > 0, F.lag("_norm").over(line)).when(
        F.abs(F.col("_above_y") - F.col("_first_y")) <= 24.0, F.col("_above_last"))
    later = line.rowsBetween(1, W.unboundedFollowing)
    noun = F.max(F.when(F.col("_norm").isin(CONTRACT_NOUNS), 1).otherwise(0)).over(later)
    foot = F.col("_first_y") <= F.greatest(F.lit(140.0), F.col("page_h") * 0.17)
    cut = F.when(foot & (left <= 9) & starts & is_head & ~F.coalesce(before.isin(COUNT_WORDS), F.lit(False))
                 & (F.coalesce(noun, F.lit(0)) == 0), F.col("_k"))
    w = w.withColumn("_cut", cut).withColumn("_from", F.min("_cut").over(whole))
    return w.where("_from is null or _k < _from").drop("_k", "_n", "_norm", "_first_y", "_last", "_above_y", "_above_last",
                                                       "_cut", "_from")


def _breaks(keys: list[str], y: str = "y0") -> Column:
    """Separator before a word: nothing for the first one, a new line on a page change or a step of more than 5 pt."""
    doc = W.partitionBy(*keys).orderBy("pos")
    prev = lambda c: F.lag(c).over(doc)
    return F.when(prev("page").isNull(), "").when(
        (prev("page") != F.col("page")) | (F.abs(prev(y) - F.col(y)) > 5.0), "\n").otherwise(" ")


def char_offsets(words: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `sep`, `start` and `stop`: the place of each word in the document text (0-based)."""
    doc = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    w = words.withColumn("sep", _breaks(keys))
    stop = F.sum(F.length("sep") + F.length("text")).over(doc)
    return w.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("text"))


def masked_text(words: DataFrame, keys: list[str]) -> DataFrame:
    """One text per document: words in order, new lines where the page or the height changes."""
    return words.withColumn("_piece", F.concat(_breaks(keys), F.col("text"))).groupBy(*keys).agg(
        F.expr("listagg(_piece, '') within group (order by pos)").alias("text"))


def page_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, line_on_page, y0, line_text) from words that carry their line."""
    return words.groupBy(*keys, "page", "line_on_page").agg(
        F.expr("listagg(text, ' ') within group (order by pos)").alias("line_text"), F.max("y0").alias("y0"),
        F.count("*").alias("n_words"))
