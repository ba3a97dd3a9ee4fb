"""Steps on the words of whole documents, as Arrow kernels: every document is one array of words while its steps run.

A step takes the words of a batch of documents as columns and returns them changed. Operators add their step to the table they
get: if that table comes straight from another step, both run on the same arrays, and words become rows once, after the last one.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from veridoc.functions import text as X

# Heights nearer to a bound than this are folded one by one, as the rounding of a mean may decide.
ROUNDING = 1e-6
Columns = dict[str, pa.Array]
Step = tuple[Callable[[Columns, np.ndarray], tuple[Columns, np.ndarray]], list[T.StructField]]


def gathered(words: DataFrame, keys: list[str], keep: Column | None = None) -> tuple[DataFrame, list[T.StructField], list[Step]]:
    """(documents with their words as array `_w`, fields of a word, steps that wait to be run on it)."""
    known = getattr(words, "_pages", None)
    if known and known[0] == keys and keep is None:
        return known[1:]
    fields = [f for f in words.schema.fields if f.name not in keys]
    word = F.struct(*[f.name for f in fields])
    return words.groupBy(*keys).agg(F.collect_list(word if keep is None else F.when(keep, word)).alias("_w")), fields, []


def waits(words: DataFrame, keys: list[str]) -> bool:
    """Does the table come straight from a step on documents?"""
    known = getattr(words, "_pages", None)
    return known is not None and known[0] == keys


def with_step(words: DataFrame, keys: list[str], run: Callable, fields: Callable[[list[T.StructField]], list[T.StructField]],
              columns: list[str] | None = None, keep: Column | None = None) -> DataFrame:
    """Words after a further step; `fields` gives the fields of a word from those before it, `columns` their order in the table."""
    docs, first, steps = gathered(words, keys, keep)
    return stepped(docs, keys, first, [*steps, (run, fields(steps[-1][1] if steps else first))], columns)


def _kernel(runs: list[Callable], kind: T.DataType, more: Callable | None = None) -> Callable:
    """Array of words -> array of words after the steps, as a column function. With `more`, what it makes of the words beside them."""
    item = to_arrow_type(kind)
    words = item.field("_w").type if more else item

    def lists(n: int, cols: Columns, doc: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        ends = np.zeros(n + 1, np.int32)
        np.cumsum(np.bincount(doc, minlength=n), out=ends[1:])
        parts = [cols[f.name].cast(f.type) for f in kind.value_type]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(kind.value_type)), type=kind)

    def flat(docs: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return docs.flatten(), np.repeat(np.arange(len(docs)), pc.fill_null(pc.list_value_length(docs), 0).to_numpy(zero_copy_only=False))

    def run_all(docs: pa.Array, *starts: pa.Array) -> pa.Array:
        flattened, doc = flat(docs)
        cols = dict(zip([f.name for f in flattened.type], flattened.flatten()))
        for k, run in enumerate(runs):
            cols, doc = run(cols, doc, *map(flat, starts)) if k == 0 else run(cols, doc)
        out = lists(len(docs), cols, doc, words)
        if more is None:
            return out
        return pa.StructArray.from_arrays([out, lists(len(docs), *more(cols, doc), item.field(1).type)], fields=list(item))

    return run_all


def _arrow(run_all: Callable, kind: T.DataType, *columns: str) -> Column:
    def one(docs: pa.Array) -> pa.Array:
        return run_all(docs)

    def two(docs: pa.Array, starts: pa.Array) -> pa.Array:
        return run_all(docs, starts)

    one.__annotations__ = {"docs": pa.Array, "return": pa.Array}
    two.__annotations__ = {"docs": pa.Array, "starts": pa.Array, "return": pa.Array}
    # Called what it is not, so that the optimiser does not put the call, and the gathering below it, in each place that reads the result.
    return F.arrow_udf(one if len(columns) == 1 else two, kind).asNondeterministic()(*columns)


def _array(fields: list[T.StructField]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def stepped(docs: DataFrame, keys: list[str], first: list[T.StructField], steps: list[Step], columns: list[str] | None = None) -> DataFrame:
    """The words of documents after all steps, a row each; the table knows the arrays it comes from.

    The first step also gets `_s` of each document, if `docs` has that.
    """
    last = steps[-1][1]
    kind, given = _array(last), ["_w", "_s"] if "_s" in docs.columns else ["_w"]
    # The outer form, as `explode` would have the optimiser ask for non-empty arrays and run the kernel again for that.
    each = docs.select(*keys, _arrow(_kernel([run for run, _ in steps], kind), kind, *given).alias("_w")).select(
        *keys, F.explode_outer("_w").alias("_w")).where("_w is not null")
    out = each.select(*[F.col(c) if c in keys else F.col("_w")[c].alias(c) for c in columns or [*keys, *[f.name for f in last]]])
    out._pages = (keys, docs, first, steps)
    return out


def lined_by_mean(words: DataFrame, keys: list[str], keep: Column | None = None) -> DataFrame:
    """Lines by the running mean, see `words.sanitizer_lines`: most words are settled by the word before and the first one of their
    line; lines with others are folded, and only their words."""
    docs, first, steps = gathered(words, keys, keep)
    before = steps[-1][1] if steps else first
    ready = [*before, T.StructField("_brk", T.BooleanType()), T.StructField("_held", T.BooleanType())]
    narrow = [T.StructField("brk", T.BooleanType()), T.StructField("y", T.DoubleType()), T.StructField("tol", T.DoubleType())]
    kind = T.StructType([T.StructField("_w", _array(ready)), T.StructField("_w_open", _array(narrow))])
    runs = [*(run for run, _ in steps), sure_lines]
    given = ["_w", "_s"] if "_s" in docs.columns else ["_w"]
    docs = docs.select(*keys, _arrow(_kernel(runs, kind, open_words), kind, *given).alias("_words")).select(
        *keys, F.col("_words._w").alias("_w"), F.col("_words._w_open").alias("_w_open"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, w: Column) -> Column:
        joins = F.coalesce(~w["brk"], state["sum"] / state["n"] - w["y"] < w["tol"], F.lit(False))
        return F.struct(F.when(joins, state["sum"] + w["y"]).otherwise(w["y"]).cast("double").alias("sum"),
                        F.when(joins, state["n"] + 1).otherwise(1).alias("n"), (state["at"] + 1).alias("at"),
                        F.when(joins, state["starts"]).otherwise(F.array_append(state["starts"], state["at"])).alias("starts"))

    docs = docs.select(*keys, "_w", F.aggregate("_w_open", start, step)["starts"].alias("_s"))
    lined = [*before, T.StructField("line_no", T.IntegerType()), T.StructField("mean_y", T.DoubleType())]
    return stepped(docs, keys, ready, [(mean_lines, lined)], [*words.columns, "line_no", "mean_y"] if not steps or set(words.columns) >= {f.name for f in before} else None)


# --- columns ----------------------------------------------------------------------------------------

def _numbers(a: pa.Array) -> np.ndarray:
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _nulls(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=np.isnan(x))


def _rank(a: pa.Array) -> np.ndarray:
    """A column to sort by, nulls first."""
    if pa.types.is_integer(a.type) and not a.null_count:
        return a.to_numpy(zero_copy_only=False)
    if pa.types.is_boolean(a.type):
        a = a.cast(pa.int8())
    if pa.types.is_integer(a.type) or pa.types.is_floating(a.type):
        x = _numbers(a)
        return np.where(np.isnan(x), -np.inf, x)
    if pa.types.is_nested(a.type):
        return np.zeros(len(a))
    return np.asarray(pc.rank(a, sort_keys="ascending", null_placement="at_start", tiebreaker="dense"))


def _taken(cols: Columns, doc: np.ndarray, at: np.ndarray) -> tuple[Columns, np.ndarray]:
    where = pa.array(at)
    return {k: v.take(where) for k, v in cols.items()}, doc[at]


def _sorted(cols: Columns, doc: np.ndarray, keys: list[np.ndarray], rest: Callable[[], list[np.ndarray]] = list) -> tuple[Columns, np.ndarray]:
    """Words in the order of the keys; `rest` decides between equal ones."""
    keys, order = [doc, *keys], None
    equal, fine = np.ones(max(0, len(doc) - 1), bool), True
    for k in keys:
        fine = fine and not (equal & (k[1:] < k[:-1])).any()
        equal &= k[1:] == k[:-1]
    if not fine:
        order = np.lexsort(keys[::-1])
        equal = np.all([k[order][1:] == k[order][:-1] for k in keys], axis=0)
    if equal.any() and (more := rest()):
        order = np.lexsort([*keys, *more][::-1])
    return (cols, doc) if order is None else _taken(cols, doc, order)


def _starts(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Is a word the first one of its document and keys?"""
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = doc[1:] != doc[:-1]
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _before(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The value of the word before on the line."""
    out = np.full(len(x), np.nan)
    out[1:] = x[:-1]
    out[new] = np.nan
    return out


def _since(flags: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Flags counted from the start of each group on, that of the start left out."""
    n = np.cumsum(flags)
    first = np.flatnonzero(new)
    return n - np.repeat(n[first], np.diff(np.r_[first, len(new)]))


def _line_order(cols: Columns) -> list[np.ndarray]:
    return [_rank(cols[k]) for k in ("page", "line_no", "x0", "pos", "sub") if k in cols]


def _by_line(cols: Columns, doc: np.ndarray) -> tuple[Columns, np.ndarray, np.ndarray]:
    cols, doc = _sorted(cols, doc, _line_order(cols))
    return cols, doc, _starts(doc, _rank(cols["page"]), _rank(cols["line_no"]))


# --- steps ------------------------------------------------------------------------------------------

def _tolerance(cols: Columns) -> np.ndarray:
    return np.fmax(4.5, _numbers(cols["font_size"]) * 0.48)


def sure_lines(cols: Columns, doc: np.ndarray, *none: object) -> tuple[Columns, np.ndarray]:
    """Words from the top down with `_brk`: starts a line, does not, or null on lines where that is open.

    No mean is below the word before or above the first word of the line, so either may settle it.
    """
    order = [k for k in ("x0", "pos", "sub") if k in cols]
    down = _numbers(cols["y0"])
    down = np.where(np.isnan(down), -np.inf, -down)
    rest = [k for k in cols if k not in (*order, "page")]
    cols, doc = _sorted(cols, doc, [_rank(cols["page"]), down, *(_rank(cols[k]) for k in order)],
                        lambda c=cols: [_tolerance(c), *(_rank(c[k]) for k in rest)])
    y, tol, new = _numbers(cols["y0"]), _tolerance(cols), _starts(doc, _rank(cols["page"]))
    brk = ~(_before(y, new) - y < tol + ROUNDING)
    at = np.flatnonzero(brk)
    size = np.diff(np.r_[at, len(y)])
    unsure = ~(np.repeat(y[at], size) - y < tol - ROUNDING) & ~brk
    line = np.cumsum(brk) - 1
    held = np.bincount(line, weights=unsure)[line] > 0 if len(line) else unsure
    return cols | {"_brk": pa.array(brk, mask=held & ~brk), "_held": pa.array(held)}, doc


def open_words(cols: Columns, doc: np.ndarray) -> tuple[Columns, np.ndarray]:
    """The words of lines that hold an open one."""
    at = np.flatnonzero(cols["_held"].to_numpy(zero_copy_only=False))
    few, doc = _taken({k: cols[k] for k in ("_brk", "y0", "font_size")}, doc, at)
    return {"brk": few["_brk"], "y": few["y0"], "tol": pa.array(_tolerance(few))}, doc


def mean_lines(cols: Columns, doc: np.ndarray, starts: tuple[pa.Array, np.ndarray]) -> tuple[Columns, np.ndarray]:
    """`line_no` and `mean_y` of words with `_brk`; `starts` tells, for each document, which of its words on open lines start a line."""
    brk = pc.fill_null(cols.pop("_brk"), False).to_numpy(zero_copy_only=False).copy()
    starts, owner = np.asarray(starts[0]), starts[1]
    y, new = _numbers(cols["y0"]), _starts(doc, _rank(cols["page"]))
    if len(starts):
        held = np.flatnonzero(cols["_held"].to_numpy(zero_copy_only=False))
        first = np.searchsorted(doc[held], owner)
        brk[held[first + starts]] = True
    line = np.cumsum(brk) - 1
    sums = np.bincount(line, weights=np.where(np.isnan(y), 0.0, y))
    return cols | {"line_no": pa.array(_since(brk, new).astype(np.int32)), "mean_y": pa.array((sums / np.bincount(line))[line])}, doc


def _same_text(cols: Columns, at: np.ndarray) -> np.ndarray:
    """Which of these words have the text of the word before?"""
    text = cols["text"]
    return pc.fill_null(pc.equal(text.take(pa.array(at)), text.take(pa.array(at - 1))), False).to_numpy(zero_copy_only=False)


def _without_copies(cols: Columns, doc: np.ndarray, new: np.ndarray, copy: np.ndarray) -> tuple[Columns, np.ndarray]:
    at = np.flatnonzero(copy & ~new)
    at = at[_same_text(cols, at)]
    return _taken(cols, doc, np.delete(np.arange(len(doc)), at)) if len(at) else (cols, doc)


def without_overprints(cols: Columns, doc: np.ndarray) -> tuple[Columns, np.ndarray]:
    cols, doc, new = _by_line(cols, doc)
    x, before = _numbers(cols["x0"]), lambda k: _before(_numbers(cols[k]), new)
    copy = (x < before("x1") - 0.5) & (np.abs(x - before("x0")) <= np.fmax(1.5, before("font_size") * 0.18))
    return _without_copies(cols, doc, new, copy)


# A line end may follow where `$` stands in the patterns of the JVM.
END = "(?:\r\n|[\n\r\u0085\u2028\u2029])?"
DIGITS, NUMBER_TAIL = re.compile(r"[0-9]{1,12}" + END), re.compile(r"[0-9€$£%]+" + END)


def _number(a: str | None, b: str | None) -> bool:
    return a is not None and b is not None and bool(DIGITS.fullmatch(a) and NUMBER_TAIL.fullmatch(b))


def _where_texts(cols: Columns, sure: np.ndarray, maybe: np.ndarray, test: Callable[[str | None, str | None], bool]) -> np.ndarray:
    """Words glued for sure, and those of `maybe` whose text passes the test with the one before."""
    glued, at, text = sure.copy(), np.flatnonzero(maybe & ~sure), cols["text"]
    for i, a, b in zip(at, text.take(pa.array(at - 1)).to_pylist(), text.take(pa.array(at)).to_pylist()):
        glued[i] = test(a, b)
    return glued


def _glued(cols: Columns, doc: np.ndarray, glued: np.ndarray, keep: list[str]) -> tuple[Columns, np.ndarray]:
    cols = {k: cols[k] for k in dict.fromkeys(["page", "line_no", "text", "x0", "y0", "x1", "y1", *keep])}
    if not glued.any():
        return cols, doc
    first = np.flatnonzero(~glued)
    size = np.diff(np.r_[first, len(doc)])
    box = {k: _nulls(f.reduceat(_numbers(cols[k]), first)) for k, f in (("x0", np.fmin), ("y0", np.fmin), ("x1", np.fmax), ("y1", np.fmax)) if k not in keep}
    text, long = cols["text"], np.flatnonzero(size > 1)
    out, doc = _taken(cols, doc, first)
    parts = ([t for t in text.slice(int(first[i]), int(size[i])).to_pylist() if t is not None] for i in long)
    joined = pa.array(["".join(p) if p else None for p in parts], out["text"].type)
    return out | box | {"text": pc.replace_with_mask(out["text"], pa.array(size > 1), joined)}, doc


def kerning(keep: list[str]) -> Callable:
    def run(cols: Columns, doc: np.ndarray) -> tuple[Columns, np.ndarray]:
        cols, doc, new = _by_line(cols, doc)
        before = lambda k: _before(_numbers(cols[k]), new)
        gap, font = _numbers(cols["x0"]) - before("x1"), before("font_size")
        near = (gap >= -1.5) & ~new
        glued = _where_texts(cols, near & (gap <= np.fmax(1.8, font * 0.22)), near & (gap <= np.fmax(5.0, font * 0.7)), _number)
        return _glued(cols, doc, glued, keep)
    return run


def numbered(cols: Columns, doc: np.ndarray) -> tuple[Columns, np.ndarray]:
    """`line_idx` (0.. per document) and `idx` (0.. per line)."""
    cols, doc, new = _by_line(cols, doc)
    one = np.ones(len(doc), int)
    return cols | {"line_idx": pa.array(_since(new, _starts(doc)).astype(np.int32)), "idx": pa.array(_since(one, new).astype(np.int32))}, doc


GLYPHS = {ord(a): b for a, b in reversed([*zip(X.BULLETS, " " * len(X.BULLETS)), *zip(X.DASHES, "-" * len(X.DASHES)),
                                           *zip(X.APOSTROPHES, "'" * len(X.APOSTROPHES)), *zip(X.QUOTES, '"' * len(X.QUOTES))])}
LIGATURES = X.LIGATURES
COMPOUND, BLANKS = re.compile(r"[;()\[\]]|(?<![0-9]):|:(?![0-9])"), re.compile("[ \t\n\x0b\f\r]+")


def clean(word: str) -> str:
    """`text.clean_raw_word` of one word."""
    if not word.isascii():
        for glyph, plain in LIGATURES.items():
            word = word.replace(glyph, plain)
        word = unicodedata.normalize("NFKC", word.translate(GLYPHS))
    if not word.isalnum() or not word.isascii():
        word = "".join(c for c in word if c in "€$£%" or (k := unicodedata.category(c))[0] == "L" or k == "Nd")
    return word.lower()


def cleaned_parts(raw: str, masked: bool) -> tuple[tuple[int, float, float, str], ...]:
    """(number, start, width, clean text) of the parts of a word that do not end empty; places as shares of the word."""
    if masked or raw.startswith("[") and "]" in raw or "_IGNORE]" in raw or "[IGNORED" in raw or "[MASKED]" in raw:
        parts = BLANKS.split(raw)
    else:
        parts = [p for p in COMPOUND.split(raw) if p]
    n = max(len(raw), 1)
    return tuple((i, max(raw.find(p), 0) / n, len(p) / n, c) for i, p in enumerate(parts) if (c := clean(p)))


def split_words(cols: Columns, doc: np.ndarray, *none: object) -> tuple[Columns, np.ndarray]:
    """Words cut into their parts and cleaned, see `linediff.diff_tokens`."""
    known = cols["text"].dictionary_encode()
    words, codes = known.dictionary.to_pylist(), pc.fill_null(known.indices, len(known.dictionary)).to_numpy(zero_copy_only=False)
    # Words known to be masked have a second set of parts; words that are null have none.
    masked = pc.fill_null(cols["is_masked"], False).to_numpy(zero_copy_only=False) if "is_masked" in cols else np.zeros(len(doc), bool)
    every = [cleaned_parts(w, False) for w in words] + [()]
    if masked.any():
        codes = np.where(masked, codes + len(every), codes)
        every += [cleaned_parts(w, True) for w in words] + [()]
    counts = np.array([len(p) for p in every])
    first = np.cumsum(counts) - counts
    sub, start, width, text = zip(*(p for parts in every for p in parts)) if counts.any() else ((), (), (), ())
    n = counts[codes]
    at = np.repeat(np.arange(len(doc)), n)
    part = np.repeat(first[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    cols, doc = _taken({k: v for k, v in cols.items() if k not in ("text", "is_masked")}, doc, at)
    x0, wide = _numbers(cols["x0"]), _numbers(cols["x1"]) - _numbers(cols["x0"])
    start, width = np.array(start, float)[part], np.array(width, float)[part]
    return cols | {"x0": _nulls(x0 + wide * start), "x1": _nulls(x0 + wide * (start + width)), "sub": pa.array(np.array(sub, np.int32)[part]),
                   "text": pa.array(text, pa.string()).take(pa.array(part))}, doc


# Workers get the steps with the plan, so that they need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
