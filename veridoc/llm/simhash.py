"""SimHash near-duplicates: fingerprints over word shingles, linked by anchor points of a covering code.

Anchors. A fingerprint is two halves of 32 bits. In a half, 31 bits are a word of the perfect Hamming code of that length,
whose codewords cover every word within radius 1; the last bit is left out. Two fingerprints that differ in at most
`THRESHOLD` = 2 bits differ in at most 1 bit of some half, so in that half the second lies within 1 + 1 = 2 of the first
one's nearest codeword. Each fingerprint goes to the anchors within that reach (16 of a half) and is compared there with
those whose nearest codeword the anchor is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from veridoc.llm.common import place, slices, small, store, stored, to_python, without_places
from veridoc.llm.components import connected_components

SEED = 42
THRESHOLD = 2
#: Members of an anchor compared pair by pair; all members of a larger one are linked through shared neighbours instead.
ANCHOR_MEMBERS = 64

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = np.arange(8, dtype=np.int64) * 256
# Shingles hashed at once, which bounds the arrays of a very long text.
_SLAB = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """64 bits: a bit is 1 if it is set in over half of the hashes of the text's shingles, repeats included."""
    if not text:
        return 0
    # Bytes of UTF-8: lower() changes A-Z only, split() cuts at the six ASCII white space characters.
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.r_[0, ends[:-1]]
    last = ends[words - 1:] - 1 if len(parts) >= words else ends[-1:] - 1
    total, digest = np.zeros(2048, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(last), _SLAB):
        hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts[at:at + _SLAB].tolist(), last[at:at + _SLAB].tolist())],
                          dtype="<u8")
        total += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048)
    ones = total.reshape(8, 256) @ _BITS
    return int(np.packbits(ones.ravel() * 2 > len(last), bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame) -> DataFrame:
    """`rows` without its column `t`, a text, and with its fingerprint `fp` as a signed long."""
    kept = [c for c in rows.columns if c != "t"]
    source = rows.select(*kept, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(t) for t in batch.column(len(kept)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(values)], [*kept, "fp"])

    return to_python(source).mapInArrow(run, T.StructType([*source.schema.fields[:len(kept)], T.StructField("fp", T.LongType())]))


def _nearest(fp: Column, half: int) -> tuple[Column, Column]:
    """(31 bits of a half, syndrome): the syndrome is the place (from 1) of the bit that leads to the nearest codeword, or 0."""
    word = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0x7FFFFFFF))
    syndrome = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        odd = F.bit_count(word.bitwiseAND(F.lit(mask))) % 2
        syndrome = syndrome + odd * (1 << k)
    return word, syndrome


def _flip(i: Column) -> Column:
    """The word with bit i, counted from 1, and none for 0."""
    return F.expr("1L").cast("long") * F.when(i == 0, F.lit(0).cast("long")).otherwise(F.pow(F.lit(2.0), i - 1).cast("long"))


def anchors(prints: DataFrame) -> DataFrame:
    """(anchor, fp, home): every anchor within covering radius 1 + 1 of each fingerprint; home: it is the nearest one."""
    parts = None
    for half in (0, 1):
        word, syndrome = _nearest(F.col("fp"), half)
        base = prints.select("fp", word.alias("w"), syndrome.alias("s"))
        home = F.col("w").bitwiseXOR(_flip(F.col("s")))
        # Two flipped bits reach a codeword if their places give the syndrome; each pair once.
        others = F.transform(
            F.filter(F.sequence(F.lit(1), F.lit(31)),
                     lambda i: (F.col("s") != 0) & (i < i.bitwiseXOR(F.col("s")))),
            lambda i: F.col("w").bitwiseXOR(_flip(i)).bitwiseXOR(_flip(i.bitwiseXOR(F.col("s")))))
        reached = base.select("fp", home.alias("at_home"), F.explode(F.concat(F.array(home), others)).alias("c"))
        rows = reached.select((F.col("c") * 2 + half).alias("anchor"), "fp", (F.col("c") == F.col("at_home")).alias("home"))
        parts = rows if parts is None else parts.union(rows)
    return parts


def links(prints: DataFrame, members: int = ANCHOR_MEMBERS) -> DataFrame:
    """(a, b): links that join exactly the fingerprints which differ in 1 or 2 bits; `prints` has distinct ones in `fp`.

    Small anchors give each of their links. The members of a large anchor are linked through shared neighbours: two
    fingerprints differ in at most 2 bits if and only if some word differs in at most 1 bit from both. Each member goes to
    itself and its 64 neighbours, and those that meet at a word (65 at most) are linked to the smallest of them, which
    gives the same components and no group that grows with the data.
    """
    spread = anchors(prints)
    sizes = store(spread.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "anchors")
    usual = small(sizes.filter(F.col("n") <= members).select("anchor"))
    busy = spread.join(usual, "anchor", "left_semi")
    left = busy.filter("home").select("anchor", F.col("fp").alias("a"))
    right = busy.select(F.col("anchor").alias("anchor_"), F.col("fp").alias("b"))
    near = left.join(right, (F.col("anchor") == F.col("anchor_")) & (F.col("a") != F.col("b")) & (
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD)).select("a", "b")
    crowd = spread.join(small(sizes.filter(F.col("n") > members).select("anchor")), "anchor", "left_semi").select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64))))
    meeting = crowd.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("word"))
    first = meeting.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = meeting.join(first, "word").filter(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return near.union(shared)


def classes(prints: DataFrame, best: Column) -> DataFrame:
    """(fp, first) for a stored table of fingerprints: the least value of `best` that each can reach by links."""
    distinct = store(prints.groupBy("fp").agg(F.min(best).alias("least")), "distinct")
    found = connected_components(links(distinct.select("fp")))
    grouped = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    first = grouped.groupBy("component").agg(F.min("least").alias("first"))
    return store(grouped.select("fp", "component").join(first, "component").select("fp", "first"), "classes")


def linked(prints: DataFrame, node: str) -> DataFrame:
    """(a, b), stored: links that join exactly the nodes whose fingerprints reach each other; a node may have several fingerprints."""
    found = prints.join(classes(prints, F.col(node)), "fp").filter(F.col(node) != F.col("first"))
    return store(found.select(F.col("first").alias("a"), F.col(node).alias("b")).distinct(), "linked")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per row of `docs`; component_id is the smallest id reachable by links.

    Texts that are null, empty or blank have fingerprint 0, linked like any other; equal fingerprints are linked. Rows with
    a null id get the component of their fingerprint, null if no row with an id is reachable. An empty table gives an
    empty one. Whole texts are read; other columns are not.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    prints = store(fingerprints(rows), "prints")
    return prints.join(classes(prints, F.col("id")), "fp").select(F.col("id").alias("doc_id"), "fp", F.col("first").alias("component_id"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one of each group: the smallest id, null ids last; of rows with that id the one stored first."""
    source = stored(docs)
    rows = source.select(F.col(f"`{key}`").cast("long").alias("id"), *place(source), F.col(f"`{text}`").cast("string").alias("t"))
    prints = store(fingerprints(rows), "prints")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "file", "row")
    gone = prints.withColumn("rank", rank).join(classes(prints, rank), "fp").filter(~F.col("rank").eqNullSafe(F.col("first")))
    return without_places(source, gone)
