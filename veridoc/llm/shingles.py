"""Near copies by word shingles: all pairs of texts whose sets of shingles have a given Jaccard similarity, exactly.

At a similarity of 0.8 fingerprints of 64 bits differ in about ten bits, which no covering code of usable size reaches, so
candidates come from the sets themselves. Shingles have one total order, rare ones first; two sets of that similarity share
a shingle among the first fifth of each (prefix filter), and its places bound their overlap. For the order the shingles of all texts
are counted in buckets of their hashes, so that the counts take the same room whatever the number of texts. Candidates are
compared first by bit sketches, which bound the overlap from above, then by whole sets.

A group of copies is not compared pair by pair: each set is compared with one that it shares a shingle with, then at each
shingle with one of another component. At crowded shingles that is repeated with other sets, drawn by a hash, as long as it joins
components. Only sets that are not in one component after that are compared with each other, mostly once: not at a shingle
if they share one of those just before it. Links that are known before (SimHash fingerprints) make the first components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from veridoc.llm import simhash
from veridoc.llm.common import discard, place, slices, small, store, stored, sweep, to_python, without_places
from veridoc.llm.components import connected_components

SEED = 42
WORDS = 5
SIMILARITY = 0.8
#: Buckets in which shingles are counted for the order, those that travel as one row, and the count from which a bucket is common.
BUCKETS = 1 << 22
BLOCK = 1 << 16
COMMON = 3
#: Longs of a sketch.
SKETCH = 16
#: Sets at a shingle that are compared pair by pair without further rounds, heads that a round draws there, and the share of the
#: components that a round may leave if another is to follow.
CROWD = 64
HEADS = 8
WORTH = 0.9
#: Shingles before one that are looked at, so that two sets which share many are one candidate and not one for each.
BEFORE = 8


def shingle_set(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z are lower-cased, a text of fewer words is one shingle, a blank one none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.int64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts])
    last = ends[words - 1:] - 1 if len(parts) >= words else ends[-1:] - 1
    starts = np.r_[0, ends[:-1]].tolist()
    return np.unique(np.array([digest(joined[i:j], seed) for i, j in zip(starts, last.tolist())], dtype=np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def _sketch(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * SKETCH, np.uint8)
    bits[hashes & (64 * SKETCH - 1)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(c, shingles) for (c, t)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found)], ["c", "shingles"])

    return to_python(texts.select("c", "t")).mapInArrow(run, "c long, shingles array<long>")


def common_shingles(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """How common the shingles of each bucket are in all texts (file, row, t): 0, or a number that grows with the logarithm of their count."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int32)
        for batch in slices(batches):
            found = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            at, n = np.unique(np.concatenate(found) & (BUCKETS - 1), return_counts=True)
            counts[at] += n.astype(np.int32)
        for block, part in enumerate(counts.reshape(-1, BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[block] = sums.get(block, 0) + np.frombuffer(part.as_buffer(), np.int32).astype(np.int64)
        for block, total in sums.items():
            weight = np.where(total >= COMMON, np.minimum(255, 8 * np.log2(1 + total)), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([weight.tobytes()], pa.binary())], ["block", "weights"])

    # A task's counts have the size of the buckets, so there are a few tasks for each core and not more with more texts.
    few = to_python(texts.select("t")).coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, weights binary")
    out = np.zeros((BUCKETS // BLOCK, BLOCK), np.uint8)
    for block, weights in parts.collect():
        out[block] = np.frombuffer(weights, np.uint8)
    return out.reshape(-1)


def prefixes(rows: DataFrame, similarity: Fraction, words: int, common: np.ndarray, bits: bool = False) -> DataFrame:
    """`rows` (id, file, row, t) without the text, and with c, the digest of its set, the set's size, prefix and sketch.

    `bits`: also with the text's SimHash fingerprint `fp`, null otherwise.
    """
    shared = rows.sparkSession.sparkContext.broadcast(common)
    p, q = similarity.numerator, similarity.denominator

    def first(hashes: np.ndarray) -> np.ndarray:
        n, weight = len(hashes), shared.value[hashes & (BUCKETS - 1)]
        return hashes[np.lexsort((hashes, weight))[:n + (n * p) // -q + 1 if n else 0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(3).to_pylist()
            found = [shingle_set(t, words) for t in texts]
            prints = pa.array(np.array([simhash.fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)) if bits else pa.nulls(len(texts), pa.int64())
            digest = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(digest), pa.array([len(x) for x in found], pa.int32()), _lists([first(x) for x in found]),
                 _lists([_sketch(x) for x in found]), prints], ["id", "file", "row", "c", "n", "prefix", "sketch", "fp"])

    return to_python(rows.select("id", "file", "row", "t")).mapInArrow(
        run, "id long, file string, row long, c long, n int, prefix array<long>, sketch array<long>, fp long")


def _enough(overlap: Column, n: Column, m: Column, similarity: Fraction) -> Column:
    """Sets of n and m members with that overlap have the similarity."""
    p, q = similarity.numerator, similarity.denominator
    return overlap.cast("long") * (p + q) >= (n + m).cast("long") * p


def _verified(pairs: DataFrame, one: DataFrame, source: DataFrame, similarity: Fraction, words: int) -> DataFrame:
    """The pairs (a, b) that have the similarity, stored."""
    def with_(df: DataFrame, side: DataFrame, at: str, **names: str) -> DataFrame:
        return df.join(side.select(F.col("c").alias(at), *(F.col(k).alias(v) for k, v in names.items())), at)

    near = with_(with_(pairs, one, "a", n="n", sketch="x"), one, "b", n="m", sketch="y")
    missing = sum((F.bit_count(F.col("x")[i].bitwiseAND(F.bitwise_not(F.col("y")[i]))) for i in range(SKETCH)), F.lit(0))
    extra = sum((F.bit_count(F.col("y")[i].bitwiseAND(F.bitwise_not(F.col("x")[i]))) for i in range(SKETCH)), F.lit(0))
    near = store(near.filter(_enough(F.least(F.col("n") - missing, F.col("m") - extra), F.col("n"), F.col("m"), similarity)).select(
        "a", "b", "n", "m"), "near")
    nodes = near.select(F.col("a").alias("c")).union(near.select("b")).distinct()
    places = small(store(one.join(nodes, "c", "left_semi").select("c", F.col("file").alias("at_file"), F.col("row").alias("at_row")), "nodes"))
    texts = source.join(places, (F.col("file") == F.col("at_file")) & (F.col("row") == F.col("at_row"))).select("c", "t")
    found = store(sets(texts, words), "sets")
    both = with_(with_(near, found, "a", shingles="x"), found, "b", shingles="y")
    out = store(both.filter(_enough(F.size(F.array_intersect("x", "y")), F.col("n"), F.col("m"), similarity)).select("a", "b"), "verified")
    discard(found, near)
    sweep(out.sparkSession)
    return out


def _parts(found: DataFrame) -> DataFrame:
    return small(store(connected_components(found).select(F.col("node").alias("c"), "component"), "parts"))


def links(one: DataFrame, source: DataFrame, similarity: Fraction, words: int, known: DataFrame | None = None) -> DataFrame:
    """(a, b): links between sets of the similarity and the `known` ones, with the components that all such pairs have.

    `one` has one stored row of each set, `source` (file, row, t) the texts.
    """
    rows = one.select("c", "n", F.posexplode("prefix").alias("pos", "s"))
    heads = store(rows.groupBy("s").agg(F.count("*").alias("sets"), F.min(F.struct("c", "n", "pos")).alias("head")).filter("sets > 1"), "heads")
    sweep(one.sparkSession)
    met = store(rows.join(heads.drop("sets"), "s"), "met")
    discard(heads)
    sweep(one.sparkSession)

    # At the first shingle that two sets share, what is left of either bounds their overlap.
    def may(n: Column, pos: Column, m: Column, at: Column) -> Column:
        return _enough(F.least(n - pos, m - at), n, m, similarity)

    # Each set with one head; most of a group of near copies is one component after that.
    others = met.filter(F.col("c") != F.col("head.c"))
    starred = others.filter(may(F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos")))
    first = _verified(starred.groupBy(F.col("c").alias("b")).agg(F.min("head.c").alias("a")).select("a", "b"), one, source, similarity, words)
    found = first if known is None else first.union(known)
    # Then with the heads of other components.
    parts = _parts(found)
    tops = parts.select(F.col("c").alias("top"), F.col("component").alias("above"))
    apart = starred.select("c", F.col("head.c").alias("top")).join(parts, "c", "left").join(tops, "top", "left").filter(
        F.coalesce("component", "c") != F.coalesce("above", "top"))
    found = found.union(_verified(apart.select(F.col("top").alias("a"), F.col("c").alias("b")).distinct(), one, source, similarity, words))
    met_by = others.select("s", "c", "n", "pos")
    left = _mixed(met_by, found)
    discard(met)
    before = None
    # At crowded shingles with ever other heads, while that joins components.
    for turn in itertools.count():
        crowd = left.join(small(store(left.groupBy("s").count().filter(F.col("count") > CROWD).select("s"), "crowd")), "s", "left_semi")
        parts = crowd.select("part").distinct().count()
        if not parts or before is not None and parts > before * WORTH:
            break
        before = parts
        draw = F.struct(F.xxhash64("c", "s", F.lit(turn)).alias("draw"), "c", "n", "pos", "part")
        lane = F.pmod(F.xxhash64("c", F.lit(turn)), F.lit(HEADS))
        drawn = crowd.groupBy("s", lane.alias("lane")).agg(F.min(draw).alias("head")).drop("lane")
        tried = crowd.join(drawn, "s").filter((F.col("part") != F.col("head.part")) & may(F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos")))
        found = found.union(_verified(tried.select(F.least("c", "head.c").alias("a"), F.greatest("c", "head.c").alias("b")).distinct(),
                                      one, source, similarity, words))
        was, left = left, _mixed(left.drop("part"), found)
        discard(was)
    was, left = left, store(_with_before(left), "before")
    discard(was)
    right = left.select("s", *(F.col(x).alias(f"{x}_") for x in ("c", "n", "pos", "part", "before")))
    rest = left.join(right, "s").filter((F.col("part") < F.col("part_")) & may(F.col("n"), F.col("pos"), F.col("n_"), F.col("pos_")) &
                                        ~F.arrays_overlap("before", "before_"))
    return found.union(_verified(rest.select(F.least("c", "c_").alias("a"), F.greatest("c", "c_").alias("b")).distinct(), one, source, similarity, words))


def _mixed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` (s, c, n, pos) of the shingles that more than one component has, stored, with the component as `part`."""
    told = store(rows.join(_parts(found), "c", "left").select("s", "c", "n", "pos", F.coalesce("component", "c").alias("part")), "told")
    mixed = told.groupBy("s").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("s")
    out = store(told.join(mixed, "s", "left_semi"), "mixed")
    discard(told)
    sweep(rows.sparkSession)
    return out


def _with_before(rows: DataFrame) -> DataFrame:
    """`rows` (s, c, n, pos, part) with `before`, the shingles of a set's rows that come just before.

    Two sets that meet at one of those have been compared there or earlier, so they need not be at `s`. All have one order of
    shingles, so nothing of it comes before the first shingle that two sets share, the one that bounds their overlap.
    """
    lists = rows.groupBy("c").agg(F.first("n").alias("n"), F.first("part").alias("part"), F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("all"))
    each = lists.select("c", "n", "part", F.col("all.s").alias("order"), F.posexplode("all").alias("k", "at"))
    start = F.greatest(F.col("k") - BEFORE, F.lit(0))
    return each.select(F.col("at.s").alias("s"), "c", "n", F.col("at.pos").alias("pos"), "part", F.slice("order", start + 1, F.col("k") - start).alias("before"))


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
                        bits: bool = False) -> DataFrame:
    """The rows of `docs` that stay, one of each group: the smallest id, null ids last; of rows with that id the one stored first.

    A group is what can be reached over pairs of texts whose sets of `words`-word shingles have a Jaccard similarity of
    `similarity` or more; blank and null texts are equal. Shingles are compared by hashes of 64 bits. With `bits`, pairs whose SimHash
    fingerprints differ in at most `simhash.THRESHOLD` bits count too.
    """
    share = Fraction(str(similarity))
    if not 0 < share <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    source = stored(docs)
    rows = source.select(F.col(f"`{key}`").cast("long").alias("id"), *place(source), F.col(f"`{text}`").cast("string").alias("t"))
    prints = store(prefixes(rows, share, words, common_shingles(rows, words), bits), "prefixes")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "file", "row")
    ranked = prints.select("c", rank.alias("rank"))
    least = store(ranked.groupBy("c").agg(F.min("rank").alias("least")), "least")
    firsts = small(least.select(F.col("least.file").alias("at_file"), F.col("least.row").alias("at_row")))
    one = prints.join(firsts, (F.col("file") == F.col("at_file")) & (F.col("row") == F.col("at_row")), "left_semi")
    one = store(one.select("c", "n", "file", "row", "prefix", "sketch"), "one")
    known = simhash.linked(prints.select("fp", "c"), "c") if bits else None
    whole, prints = prints, store(prints.select("id", "file", "row", "c"), "places")
    discard(whole)
    sweep(docs.sparkSession)
    parts = connected_components(links(one, rows.select("file", "row", "t"), share, words, known))
    grouped = least.join(parts, F.col("c") == F.col("node"), "left").select("c", "least", F.coalesce("component", "c").alias("part"))
    best = grouped.groupBy("part").agg(F.min("least").alias("first"))
    kept = store(grouped.join(best, "part").select("c", "first"), "kept")
    gone = prints.select("file", "row", "c", rank.alias("rank")).join(kept, "c").filter(~F.col("rank").eqNullSafe(F.col("first")))
    return without_places(source, gone)
