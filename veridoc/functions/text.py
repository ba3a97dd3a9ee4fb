"""Text expressions: normalisation, cleaning, splitting, dates. All run in the JVM except `nfkc`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Characters mapped one by one.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "œ": "oe", "æ": "ae",
             "Œ": "OE", "Æ": "AE", "ĳ": "ij", "Ĳ": "IJ"}
BULLETS = "•·▪●○◦\uf0a7\uf0b7\u2023\u2043"
DASHES = "–—−\u2010\u2011\u2012"
APOSTROPHES = "’‘´`ʼ"
QUOTES = "“”«»„"
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\ufeff"
WIDE_SPACES = "\u00a0\u202f\u2009"
# Abbreviations that do not end a sentence.
ABBREVIATIONS = ("M Mr Mme Mlle Dr Pr Me St Ste Art cf etc ex env réf Ref No N° p fig vol ch inc ltd co corp v al av bd "
                 "imp sq pl all hab tel tél fax max min approx").split()
DATE = r"\b\d{1,2}[./\-\s]+\d{1,2}[./\-\s]+\d{2,4}\b"
ISSUED_AT = (r"(?i)\b(?:Opgemaakt\b[^\r\n]{0,75}?\bop|Gedaan\b[^\r\n]{0,65}?\bop|Ausgefertigt\b[^\r\n]{0,65}?\bam"
             r"|Erstellt\b[^\r\n]{0,55}?\bam|Fait\b[^\r\n]{0,75}?\ble)\s+(\d{1,2}[./\-\s]+\d{1,2}[./\-\s]+\d{2,4})\b")


def fold(text: Column) -> Column:
    """Upper case, one character to one character (the sharp s keeps its own form)."""
    return F.upper(F.replace(text, F.lit("ß"), F.lit("ẞ")))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Only values outside the range where it changes nothing travel to Python."""
    odd = text.rlike(r"[^\x00-\x7eÀ-ıĴ-ľŁ-ňŊ-ž€–—‘’“”„•]")
    return F.coalesce(_nfkc(F.when(odd, text)), text)


def map_glyphs(text: Column) -> Column:
    """Ligatures spelled out; bullets, dashes, apostrophes and quotes unified."""
    for glyph, plain in LIGATURES.items():
        text = F.replace(text, F.lit(glyph), F.lit(plain))
    src = BULLETS + DASHES + APOSTROPHES + QUOTES
    dst = " " * len(BULLETS) + "-" * len(DASHES) + "'" * len(APOSTROPHES) + '"' * len(QUOTES)
    return F.translate(text, src, dst)


def clean_line(text: Column) -> Column:
    out = F.regexp_replace(map_glyphs(text), f"[{ZERO_WIDTH}]", "")
    return F.when(F.trim(text) == "", "").otherwise(nfkc(F.translate(out, WIDE_SPACES, "   ")))


def clean_word(text: Column) -> Column:
    """Letters, digits and currency or percent signs, in lower case (expects NFKC text)."""
    return F.lower(F.regexp_replace(map_glyphs(text), r"[^\p{L}\p{Nd}€$£%]", ""))


def clean_raw_word(text: Column) -> Column:
    """`clean_word` of a word that is not in NFKC yet; for columns only, not inside array functions."""
    return F.lower(F.regexp_replace(nfkc(map_glyphs(text)), r"[^\p{L}\p{Nd}€$£%]", ""))


def normalize_text(text: Column) -> Column:
    """Blanks collapsed, bullets and sentences on their own lines."""
    blank = r"[\s&&[^\r\n]]"
    broken = F.regexp_replace(F.regexp_replace(text, rf"(?U){blank}+[\r\n][\s]*", " \n"), r"(?U)[\r\n]\s*", "\n")
    out = F.when(text.rlike(r"[\r\n]"), broken).otherwise(text)
    out = F.regexp_replace(out, rf"(?U){blank}+", " ")
    out = F.replace(F.replace(out, F.lit(" • "), F.lit("\n• ")), F.lit(" - "), F.lit("\n- "))
    # The sign comes first, so that only signs and not all letters look back for an abbreviation.
    out = F.regexp_replace(out, r"(?U)([.?!])(?<!\b(?:" + "|".join(ABBREVIATIONS) + r")[.?!])\s+(?=[A-ZÀ-ÖØ-Þ•\-])", "$1\n")
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n")


def split_compound(text: Column) -> Column:
    """Parts of a word glued by : ; ( ) [ ] - a colon between digits does not split."""
    return F.filter(F.split(text, r"[;()\[\]]|(?<![0-9]):|:(?![0-9])"), lambda p: p != "")


def is_masked(text: Column) -> Column:
    return ((text.startswith("[") & text.contains("]")) | text.contains("_IGNORE]") | text.contains("[IGNORED")
            | text.contains("[MASKED]"))


def is_date(text: Column) -> Column:
    return text.rlike(DATE)


def date_token(text: Column) -> Column:
    """Comparison form of a match: separators of dates become dots, other text upper case."""
    dots = F.regexp_replace(F.regexp_replace(text, r"[^0-9]+", "."), r"^\.+|\.+$", "")
    return F.when(is_date(text), dots).otherwise(fold(F.trim(text)))


def issuance_dates(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ISSUED_AT), 1), date_token)


def one_line(text: Column, limit: int, empty: str = "(vide)") -> Column:
    flat = F.trim(F.regexp_replace(text, r"\r?\n", " "))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", empty).when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.substring(flat, 1, limit), F.lit("…")))


def strip_badge(name: Column) -> Column:
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "Document.pdf").otherwise(
        F.trim(F.regexp_replace(name, r"^\[[^\]]*\](?=.)", "")))


def flexible_pattern(text: Column, longest: int | None = None) -> Column:
    """Regex for a text: words escaped, blanks flexible, an ellipsis stands for 1 to 25 words.

    `longest` gives the number of leading characters that are used; all of them if it is None.
    """
    cut = F.trim(text) if longest is None else F.trim(F.substring(F.trim(text), 1, longest))
    escape = lambda w: F.regexp_replace(w, r"([\\*+?|{\[()^$.#])", r"\\$1")
    seg = lambda s: F.array_join(F.transform(F.filter(F.split(F.trim(s), r"(?U)\s+"), lambda w: w != ""), escape), r"\s+")
    parts = F.filter(F.transform(F.split(cut, "…"), seg), lambda s: s != "")
    core = F.array_join(parts, r"(?:\s+\S+){1,25}\s+")
    alnum = r"[\p{L}\p{Nd}]"
    head = F.when(cut.rlike("^" + alnum), r"(?<![\p{L}\p{N}])").otherwise("")
    tail = F.when(cut.rlike(alnum + "$"), r"(?![\p{L}\p{N}])").otherwise("")
    return F.when(F.size(parts) == 0, "").otherwise(F.concat(head, core, tail))
