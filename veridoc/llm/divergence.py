"""How far the sources of a language differ in their words, by hash-consed segment trees over term ids.

Each (language, source) group counts the language's terms. The counts of a group are the leaves of a segment tree over term
ids, WIDTH children to a node, and a node is named by a digest of its children: equal subtrees are one node, in one tree or
in many, and a subtree without any count is no node at all. Two groups are compared by walking both trees at once from the
roots; equal pairs of nodes are put together at every level with their number, so each is priced once. Terms that neither
group holds all cost the same and are priced together, by their number.

Term ids are any numbering without gaps. Terms that the same sources use equally often get neighbouring ids, which makes
equal and missing subtrees frequent.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veridoc.llm.common import BROADCAST_LIMIT, small, store, to_python
from veridoc.session import plan_bytes

#: Documents of the language that a kept term occurs in; ranks of terms reported; scale of the shares.
LEAST_DOCS, TERM_RANKS, SCALE = 3, 200, 1_000_000_000
#: Children of a node, and counts of a leaf.
WIDTH = 16
#: Distinct terms that a counting task holds before it puts them out.
HELD_TERMS = 500_000
#: From this count on, its product with SCALE leaves 64 bits.
WIDE = 9_000_000_000

_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _counting(most: int):
    """Sums of the terms of each group; they are put out whenever a task holds more than `most`."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                # Lower-casing bytes changes the letters A-Z only.
                found = _TERM.findall(text.lower())
                n.update(found)
                docs.update(set(found))
            if sum(len(n) for n, _ in held.values()) > most:
                yield from _held_rows(held)
                held = {}
        yield from _held_rows(held)
    return count


def _held_rows(held: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()),
             pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
            names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a null text, language or source is the empty text."""
    part = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = to_python(docs).select(part(lang).alias("lang"), part(source).alias("source"), part(text).cast("binary").alias("text"))
    found = rows.mapInArrow(_counting(HELD_TERMS), "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, id): terms in enough documents of the language, numbered 0.. in it.

    `counts` have the number `g` of the source in its language. Terms are ordered by range partitions, frequent ones first,
    then by the sources that use them and by their counts, and numbered by position, so a large language is many tasks. What
    a group does not use then lies together and is no node of its tree.
    """
    uses = F.bit_or(F.expr("shiftleft(1L, 62 - cast((g - 1) % 63 as int))"))
    vector = F.sum(F.shiftright(F.xxhash64("g", "n"), 8))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), uses.alias("uses"),
                                              vector.alias("vector")).filter(F.col("docs") >= least_docs)
    level = F.floor(F.log2(F.col("total").cast("double"))).cast("int")
    kept = store(kept.select("lang", "term", "total", level.alias("level"), "uses", "vector"), "divergence-terms")
    by = [F.col("lang"), F.col("level").desc(), F.col("uses").desc(), F.col("vector"), F.col("term")]
    ranges = store(kept.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "lang", "term", "total", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "divergence-ranges")
    ahead = W.partitionBy("lang").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.groupBy("lang", "range").agg(F.count("*").alias("held"), F.min("at").alias("first")).select(
        "lang", "range", (F.coalesce(F.sum("held").over(ahead), F.lit(0)) - F.col("first")).alias("shift"))
    return ranges.join(small(store(starts, "divergence-starts")), ["lang", "range"]).select(
        "lang", "term", "total", (F.col("at") + F.col("shift")).alias("id"))


def _children(rows: DataFrame, value: str) -> list[Column]:
    return [F.max(F.when(F.col("id") % WIDTH == k, F.col(value))) for k in range(WIDTH)]


def trees(counts: DataFrame, groups: list[str], terms: int) -> tuple[list[DataFrame], DataFrame]:
    """Node tables from the leaves up, (node, children) each, and the root of every group that has counts.

    `counts` hold groups, id and n. A leaf's children are counts; a missing child is a subtree without counts.
    """
    leaf = counts.groupBy(*groups, F.floor(F.col("id") / WIDTH).alias("up")).agg(
        F.array(*(F.coalesce(c, F.lit(0)) for c in _children(counts, "n"))).alias("children"))
    level, levels, width = leaf, [], -(-max(1, terms) // WIDTH)
    while True:
        whole = F.concat_ws(",", F.transform("children", lambda c: F.coalesce(
            F.hex(c) if levels else c.cast("string"), F.lit("-"))))
        level = store(level.select(*groups, F.col("up").alias("id"), F.unhex(F.md5(whole.cast("binary"))).alias("node"), "children"),
                      "divergence-level")
        levels.append(store(level.groupBy("node").agg(F.first("children").alias("children")), "divergence-nodes"))
        if width == 1:
            return levels, level.select(*groups, F.col("node").alias("root"))
        width = -(-width // WIDTH)
        level = level.groupBy(*groups, F.floor(F.col("id") / WIDTH).alias("up")).agg(F.array(*_children(level, "node")).alias("children"))


def _built(table: DataFrame) -> DataFrame:
    """The side of a join that a hash table is built of: broadcast if small, else each partition's part of it. Its keys are
    distinct, so no part is much larger than others, and the long side need not be sorted."""
    return F.broadcast(table) if plan_bytes(table) <= BROADCAST_LIMIT else table.hint("shuffle_hash")


def _opened(pairs: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """The children of one side. A missing node meets nothing; its rows are dealt out by the node of the other side."""
    other = "b" if side == "a" else "a"
    key = F.coalesce(F.col(side), F.concat(F.lit(b"-"), F.col(other)))
    table = nodes.select(F.col("node").alias("_node"), F.col("children").alias(f"{side}_children"))
    return pairs.join(_built(table), key == F.col("_node"), "left").drop("_node")


def share(n, total):
    """The share of a count in units of 1/SCALE, one count added everywhere: whole numbers only."""
    return 1 + SCALE * (n + 1) // total


def _pricing(width: int):
    """Cost of each leaf pair in both directions, times its number, and the terms that it covers."""
    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_leaf_counts(batch.column(c), width) for c in ("a_children", "b_children"))
            ta, tb, times = (np.asarray(batch.column(c)) for c in ("a_total", "b_total", "times"))
            if batch.num_rows and max(a.max(), b.max()) >= WIDE:
                a, b = a.astype(object), b.astype(object)
            used = (a > 0) | (b > 0)
            p, q = share(a, ta[:, None]), share(b, tb[:, None])
            square = (p - q) ** 2
            forth, back = (np.where(used, square // x, 0).sum(axis=1) * times for x in (q, p))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("ga"), batch.column("gb"), pa.array(forth.astype(np.int64)),
                 pa.array(back.astype(np.int64)), pa.array(used.sum(axis=1) * times)],
                names=["lang", "ga", "gb", "forth", "back", "covered"])
    return price


def _leaf_counts(leaves: pa.Array, width: int) -> np.ndarray:
    """Counts of a row's leaf; a row without a leaf has zeros."""
    out = np.zeros((len(leaves), width), dtype=np.int64)
    out[np.asarray(leaves.is_valid())] = np.asarray(leaves.flatten()).reshape(-1, width)
    return out


def group_distances(counts: DataFrame, groups: DataFrame, terms: int) -> DataFrame:
    """(lang, ga, gb, a_total, b_total, v, forth, back) of all group pairs of a language, ga < gb.

    `counts` (lang, g, id, n) are counts above zero, `groups` (lang, g, total, v) all groups, numbered in their language.
    `forth` prices ga against gb, `back` gb against ga. Sums stay within 64 bits up to two billion terms of a language.
    """
    levels, roots = trees(counts, ["lang", "g"], terms)
    known = store(groups.join(small(roots), ["lang", "g"], "left"), "divergence-groups")
    side = lambda s: known.select("lang", F.col("g").alias(f"g{s}"), F.col("total").alias(f"{s}_total"), F.col("root").alias(s),
                                  *([F.col("v")] if s == "a" else []))
    meet = store(side("a").join(small(side("b")), "lang").filter("ga < gb"), "divergence-pairs")
    pairs = meet.filter("a is not null or b is not null").select("lang", "ga", "gb", "a", "b", F.lit(1).cast("long").alias("times"))
    for nodes in levels[:0:-1]:
        both = _opened(_opened(pairs, nodes, "a"), nodes, "b")
        empty = F.array_repeat(F.lit(None).cast("binary"), WIDTH)
        below = F.arrays_zip(F.coalesce("a_children", empty).alias("a"), F.coalesce("b_children", empty).alias("b"))
        pairs = both.select("lang", "ga", "gb", "times", F.explode(below).alias("c")).filter("c.a is not null or c.b is not null")
        pairs = pairs.groupBy("lang", "ga", "gb", F.col("c.a").alias("a"), F.col("c.b").alias("b")).agg(F.sum("times").alias("times"))
    totals = meet.select("lang", "ga", "gb", (F.col("a_total") + F.col("v")).alias("a_total"), (F.col("b_total") + F.col("v")).alias("b_total"))
    leaves = _opened(_opened(pairs, levels[0], "a"), levels[0], "b").join(small(totals), ["lang", "ga", "gb"])
    priced = leaves.select("lang", "ga", "gb", "times", "a_total", "b_total", "a_children", "b_children").mapInArrow(
        _pricing(WIDTH), "lang string, ga int, gb int, forth long, back long, covered long")
    sums = priced.groupBy("lang", "ga", "gb").agg(*(F.sum(c).alias(c) for c in ("forth", "back", "covered")))
    out = meet.join(sums, ["lang", "ga", "gb"], "left").na.fill(0, ["forth", "back", "covered"])
    bare = lambda t: F.expr(f"1 + {SCALE}L div (greatest({t} + v, 1))")
    square, left = (bare("a_total") - bare("b_total")) * (bare("a_total") - bare("b_total")), F.col("v") - F.col("covered")
    cost = lambda q: F.when(left > 0, F.call_function("div", square, q) * left).otherwise(F.lit(0))
    return out.select("lang", "ga", "gb", (F.col("forth") + cost(bare("b_total"))).alias("forth"),
                      (F.col("back") + cost(bare("a_total"))).alias("back"))


def exact_share(n: Column, total: Column) -> Column:
    """`share` in SQL; counts whose product leaves 64 bits go through decimals."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.lit(1) + F.when(n < WIDE, F.call_function("div", F.lit(SCALE).cast("long") * F.when(n < WIDE, n + 1), total)).otherwise(
        F.call_function("div", wide, total.cast("decimal(19,0)")))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS,
          term_ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of a language and a source.

    Part `pair`: every other source of the language with the cost of this group's shares against the other's, all ranks.
    Part `term`: terms that the group uses more than the language, up to rank `term_ranks`. Null texts, languages and sources
    are the empty text; a group without kept terms has counts of zero; a language without kept terms prices every pair 0; a
    language with one source has no pairs. Repeated rows count as often as they occur. An empty table gives an empty one.
    Other columns are not read.
    """
    part = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    named = W.partitionBy("lang").orderBy("source")
    seen = docs.select(part(lang).alias("lang"), part(source).alias("source")).distinct()
    seen = store(seen.withColumn("g", F.row_number().over(named)), "divergence-seen")
    counts = store(term_counts(docs, text, lang, source).join(small(seen), ["lang", "source"]).drop("source"), "divergence-counts")
    terms = store(kept_terms(counts, least_docs), "divergence-ids")
    sizes = store(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total")), "divergence-sizes")
    held = store(counts.join(_built(terms), ["lang", "term"]).select("lang", "g", "term", "id", "n", "total"), "divergence-held")
    totals = held.groupBy("lang", "g").agg(F.sum("n").alias("total"))
    groups = seen.join(small(totals), ["lang", "g"], "left").join(small(sizes), "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = store(groups, "divergence-totals")
    most = sizes.agg(F.max("v")).first()[0] or 0
    apart = store(group_distances(held.select("lang", "g", "id", "n"), groups.select("lang", "g", "total", "v"), most), "divergence-apart")
    both = apart.select("lang", F.col("ga").alias("g"), F.col("gb").alias("o"), F.col("forth").alias("value")).union(
        apart.select("lang", "gb", "ga", "back"))
    name = lambda a, b: small(seen.select("lang", F.col("g").alias(a), F.col("source").alias(b)))
    pairs = both.join(name("g", "source"), ["lang", "g"]).join(name("o", "item"), ["lang", "o"])
    order = [F.col("value").desc(), F.col("item")]
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order)))
    use = held.join(small(groups.select("lang", "source", "g", F.col("total").alias("g_total"), "v", "lang_total")), ["lang", "g"])
    use = use.withColumn("p", exact_share(F.col("n"), F.col("g_total") + F.col("v"))).withColumn(
        "q", exact_share(F.col("total"), F.col("lang_total") + F.col("v"))).filter("p > q")
    use = use.select("lang", "source", F.col("term").cast("string").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    use = use.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order))).filter(F.col("rank") <= term_ranks)
    whole = lambda df, kind: df.select("lang", "source", F.lit(kind).alias("part"), "item", "value", "rank")
    return whole(pairs, "pair").unionByName(whole(use, "term"))
