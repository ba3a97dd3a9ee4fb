"""File name and folder expressions: match keys, product, channel, release."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

# Parts of a file name that vary between runs (dates, time stamps, releases).
VARIABLE_PART = (
    r"(?:[-_.\s]*\b20\d{2}[-_.]?(?:0[1-9]|1[0-2])[-_.]?(?:0[1-9]|[12]\d|3[01])(?:[-_.\s]?\d{4,6})?\b"
    r"|[-_.\s]*\b(?:0[1-9]|[12]\d|3[01])[-_.](?:0[1-9]|1[0-2])[-_.]20\d{2}\b"
    r"|[-_.\s]*\b20\d{2}_R\d{1,2}\b)")
# Words that name the role of a file.
ROLE_WORDS = ["source", "target", "cible", "attendu", "obtenu", "ref", "reference", "cand", "candidat", "old", "new",
              "avant", "apres", "apr[eè]s", "prod", "uat", "recette", r"v\d+"]
# Fixed value: default match key in a file name.
DEFAULT_KEY = r"([A-Z]{2}_\d+_\d+)\.pdf$"
# Folder names by role.
SOURCE_FOLDERS = ["Source", "Sources", "Src", "Attendu", "Ref", "Reference", "Old", "Avant", "Prod"]
TARGET_FOLDERS = ["Target", "Targets", "Trg", "Cible", "Obtenu", "Cand", "Candidat", "New", "Apres", "Après",
                  "Recette", "UAT"]
OUTPUT_FOLDERS = ["Output", "Outputs", "Rapport", "Rapports"]
STRUCTURAL_FOLDERS = [
    "Bank", "Banque", "Broker", "Brokers", "Courtier", "Life", "NonLife", "Non-Life", "Users", "Utilisateurs",
    "Downloads", "Téléchargements", "Telechargements", "Desktop", "Bureau", "Documents", "AppData", "Local", "Roaming",
    "Temp", "Tmp", "Standard", "Lot Principal", "Général", "General", "Lot", "Dossier", "Auto", "Docs", "PDF", "PDFs"]
GLOBAL_SCOPES = ["*", "Global", "Globale", "Tous", "All"]
RELEASE_FOLDER = r"(?i)^(?:20\d{2}[_-]?R0?\d{1,2}|R0?\d{1,2})$"


@dataclass(frozen=True)
class Channels:
    """Channel names with their folder aliases; the first one is the default.

    File name patterns and product names that tell a channel, and the pattern of product codes in file names, belong to an
    organisation and are given by it.
    """
    aliases: dict[str, list[str]] = field(default_factory=lambda: {
        "Bank": ["Bank", "Banque"], "Broker": ["Broker", "Brokers", "Courtier"]})
    file_marks: dict[str, list[str]] = field(default_factory=dict)
    known_products: dict[str, list[str]] = field(default_factory=dict)
    product_code: str = r"(?i)(?<![A-Za-z0-9])(PR\.[A-Za-z0-9.]+)(?![A-Za-z0-9.])"

    @property
    def default(self) -> str:
        return next(iter(self.aliases))


def among(text: Column, values: list[str]) -> Column:
    return F.upper(F.trim(text)).isin([v.upper() for v in values])


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def exact_key(path: Column) -> Column:
    return collapse(stem(path))


def canonical_stem(path: Column, strip_roles: bool) -> Column:
    out = F.regexp_replace(exact_key(path), "(?i)" + VARIABLE_PART, "")
    if strip_roles:
        out = F.regexp_replace(out, r"(?i)(?:^|[-_.\s]+)(?:" + "|".join(ROLE_WORDS) + r")(?=$|[-_.\s]+)", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^[ _.-]+|[ _.-]+$", "")


def regex_key(path: Column, pattern: str) -> Column:
    """Group 1 (or the whole match) on the file name, else on the full path; null when nothing matches."""
    group = 1 if "(" in pattern.replace("(?:", "").replace("(?i)", "").replace(r"\(", "") else 0
    rx = "(?i)" + pattern
    hit = F.when(file_name(path).rlike(rx), F.regexp_extract(file_name(path), rx, group)).when(
        path.rlike(rx), F.regexp_extract(path, rx, group))
    return F.when(hit != "", F.upper(hit))


def shared_ids(path: Column) -> Column:
    """Identifiers of a file name: at least 5 characters with at least 4 digits, dates removed."""
    plain = F.regexp_replace(stem(path), "(?i)" + VARIABLE_PART, " ")
    found = F.transform(F.regexp_extract_all(plain, F.lit("([A-Za-z0-9]{4,})"), 1), F.upper)
    return F.filter(found, lambda t: (F.length(t) >= 5) & (F.length(F.regexp_replace(t, "[^0-9]", "")) >= 4))


def display_key(source: Column, target: Column) -> Column:
    s, t = exact_key(source), exact_key(target)
    cut = lambda x: F.when(F.length(x) > 42, F.concat(F.substring(x, 1, 39), F.lit("…"))).otherwise(x)
    return F.when(F.upper(s) == F.upper(t), s).otherwise(F.concat(cut(s), F.lit(" ➔ "), cut(t)))


def safe_key(key: Column) -> Column:
    """File-system safe key of at most 85 characters (long keys end in a SHA-256 prefix)."""
    out = F.regexp_replace(key, r"[<>:\"/\\|?*\x00-\x1f\[\]•]", "_")
    out = F.regexp_replace(F.regexp_replace(out, "^_+|_+$", ""), "__+", "_")
    out = F.replace(out, F.lit(" "), F.lit("_"))
    out = F.when(F.length(out) > 85, F.concat(F.substring(out, 1, 74), F.lit("_"),
                                               F.upper(F.substring(F.sha2(key, 256), 1, 8)))).otherwise(out)
    return F.when(F.trim(out) == "", "Doc").otherwise(out)


# --- folders -------------------------------------------------------------------------------------

def segments(path: Column) -> Column:
    """Folder names of a path (a trailing file name is dropped); empty for a plain label."""
    clean = F.trim(F.regexp_replace(F.trim(path), '^"|"$', ""))
    folder = F.when(clean.rlike(r"(?i)\.(pdf|html|csv|json)$"), F.regexp_replace(clean, r"[/\\][^/\\]*$", "")
                    ).otherwise(clean)
    parts = F.filter(F.split(folder, r"[/\\]+"), lambda s: s != "")
    return F.when(clean.rlike(r"[/\\]"), parts).otherwise(F.array().cast("array<string>"))


def is_unc(path: Column) -> Column:
    return F.coalesce(F.trim(path).rlike(r"^(\\\\|//)"), F.lit(False))


def is_release(seg: Column) -> Column:
    return F.coalesce(F.trim(seg).rlike(RELEASE_FOLDER), F.lit(False))


def is_role(seg: Column) -> Column:
    return F.coalesce(among(seg, SOURCE_FOLDERS + TARGET_FOLDERS + OUTPUT_FOLDERS), F.lit(False))


def is_structural(seg: Column) -> Column:
    return F.trim(seg).endswith(":") | among(seg, STRUCTURAL_FOLDERS)


def is_generic(name: Column) -> Column:
    return (F.coalesce(F.trim(name), F.lit("")) == "") | is_structural(name) | is_release(name) | is_role(name)


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def _above(segs: Column, unc: Column, marked, skip) -> Column:
    """Bottom-up: for each marked folder, the nearest folder above that is not skipped, unless structural."""
    index = F.when(F.size(segs) >= 2, F.reverse(F.sequence(F.lit(2), F.size(segs))))
    index = F.filter(index, lambda i: marked(F.element_at(segs, i)))
    at = F.transform(index, lambda i: F.coalesce(F.array_max(F.filter(
        F.sequence(F.lit(1), i - 1), lambda k: ~skip(F.element_at(segs, k)))), F.lit(0)))
    good = F.filter(at, lambda k: F.when(k > 0, ~(is_structural(F.try_element_at(segs, k)) | (unc & (k == 1)))
                                         ).otherwise(F.lit(False)))
    return F.trim(F.try_element_at(segs, F.coalesce(_first(good), F.size(segs) + 1)))


def product_from_tree(source: Column, target: Column, channels: Channels = Channels()) -> Column:
    """Product folder found by walking both paths; null when no rule applies."""
    s, t = segments(source), segments(target)
    same = F.zip_with(s, t, lambda a, b: F.coalesce(F.upper(a) == F.upper(b), F.lit(False)))
    stop = F.array_position(same, False)
    common = F.when(stop > 0, stop - 1).otherwise(F.size(s)).cast("int")
    lca = F.try_element_at(s, F.greatest(common, F.lit(1)))
    s_next, t_next = F.try_element_at(s, common + 1), F.try_element_at(t, common + 1)
    branch = lambda b: among(b, SOURCE_FOLDERS + TARGET_FOLDERS) | is_release(b)
    by_lca = F.when((common >= 1) & (F.size(s) > common) & (F.size(t) > common) & (branch(s_next) | branch(t_next))
                    & ~is_structural(lca) & ~(is_unc(source) & (common == 1)) & ~is_release(lca) & ~is_role(lca),
                    F.trim(lca))
    steps = [by_lca]
    channel_names = [a for v in channels.aliases.values() for a in v]
    for path, segs in ((target, t), (source, s)):
        unc = is_unc(path)
        role_or_release = lambda x: is_role(x) | is_release(x)
        steps.append(_above(segs, unc, is_release, role_or_release))
        steps.append(_above(segs, unc, is_role, role_or_release))
        below = F.transform(
            F.filter(F.reverse(F.sequence(F.lit(1), F.greatest(F.size(segs), F.lit(1)))),
                     lambda i: F.coalesce(among(F.try_element_at(segs, i), channel_names), F.lit(False)) & (i < F.size(segs))),
            lambda i: F.when(among(F.element_at(segs, i + 1), ["Life", "NonLife"]) & (i + 2 <= F.size(segs)), i + 2
                             ).otherwise(i + 1))
        below = F.filter(below, lambda i: ~(is_structural(F.element_at(segs, i)) | role_or_release(F.element_at(segs, i))))
        steps.append(F.trim(F.try_element_at(segs, F.coalesce(_first(below), F.size(segs) + 1))))
    return F.coalesce(*steps)


def resolve_product(explicit: Column, source: Column, target: Column, channels: Channels = Channels()) -> Column:
    steps = [product_from_tree(source, target, channels),
             F.when(~is_generic(explicit) & ~explicit.contains(" / "), F.trim(explicit))]
    for path in (target, source):
        segs = segments(path)
        at = F.filter(F.reverse(F.sequence(F.lit(1), F.greatest(F.size(segs), F.lit(1)))), lambda i: F.coalesce(
            ~(is_structural(F.try_element_at(segs, i)) | (is_unc(path) & (i == 1))
              | is_release(F.try_element_at(segs, i)) | is_role(F.try_element_at(segs, i))), F.lit(False)))
        steps.append(F.when(~F.exists(segs, lambda x: among(x, ["Temp", "Tmp"])),
                            F.trim(F.try_element_at(segs, F.coalesce(_first(at), F.size(segs) + 1)))))
    for path in (target, source):
        code = F.regexp_extract(stem(path), channels.product_code, 1)
        steps.append(F.when(code != "", code))
    return F.coalesce(*steps, F.when(~is_generic(explicit), F.trim(explicit)), F.lit(""))


def resolve_channel(explicit: Column, source: Column, target: Column, product: Column,
                    channels: Channels = Channels()) -> Column:
    def named(x):
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, aliases in channels.aliases.items():
            out = out.when(among(x, aliases), name)
        return out

    steps = [_first(F.filter(F.transform(F.reverse(segments(p)), named), lambda x: x.isNotNull()))
             for p in (target, source)]
    steps.append(named(explicit))
    for path in (target, source):
        for name, marks in channels.file_marks.items():
            steps.append(F.when(file_name(path).rlike("|".join(f"(?:{m})" for m in marks)), F.lit(name)))
    hint = F.coalesce(F.when(F.trim(product) != "", F.trim(product)), product_from_tree(source, target, channels))
    for name, products in channels.known_products.items():
        steps.append(F.when(among(hint, products), F.lit(name)))
    return F.coalesce(*steps, F.lit(channels.default))


# --- releases and templates ------------------------------------------------------------------------

RELEASE_NAME = r"(?i)^(20\d{2})_R0?(\d{1,2})$"


def release_name(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("_R"), month.cast("string"))


def release_order(name: Column) -> Column:
    """year * 100 + month, 0 when the name is no release."""
    return F.when(name.rlike(RELEASE_NAME), F.regexp_extract(name, RELEASE_NAME, 1).cast("int") * 100
                  + F.regexp_extract(name, RELEASE_NAME, 2).cast("int")).otherwise(0)


def expand_template(template: Column, release: Column) -> Column:
    return F.regexp_replace(F.replace(F.regexp_replace(template, r"(?i)\{Release\}", "\u0001"), F.lit("\u0001"), release),
                            r"^[/\\]+|[/\\]+$", "")


def first_segment(path: Column) -> Column:
    return F.coalesce(_first(F.filter(F.split(path, r"[/\\]"), lambda s: s != "")), F.lit(""))


def csv_set(csv: Column, defaults: list[str]) -> Column:
    parts = F.array_distinct(F.transform(F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), "[,;]"), lambda x: F.trim(x)),
                                                  lambda x: x != ""), F.upper))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(*[F.lit(d.upper()) for d in defaults]))
