"""Near-duplicate vectors: random bucket tables, binary codes of a random rotation, exact cosine where codes leave it open.

Vectors of one label meet in buckets of random hyperplanes; with n vectors of a label there are 2**k buckets of about
`BUCKET_ROWS` and as many tables as make the chance to miss a pair at the threshold at most `MISS`. In a bucket, a vector is
the signs of its rotated coordinates (1 bit each) and a stored correction factor f, the inner product of the vector with its
normalised signs. <signs, query> / f estimates the cosine with a query without bias, and if the true angle is t, it is off by
at most sin(t) * sqrt(1 - f * f) / f. A pair whose estimate cannot belong to a cosine at the threshold is settled; all others
are computed again in double precision. So codes never lose a pair.

Buckets above `TILE_ROWS` are cut into tiles, and pairs of tiles are the groups, so that no group grows with the data. A
group returns sums and one link per vector, never pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veridoc.llm.common import small, store
from veridoc.llm.components import connected_components

THRESHOLD = 0.98
BUCKET_ROWS = 1024
TILE_ROWS = 1024
MISS = 1e-7
SEED = 20240607
_SLAB_ROWS = 128
_CODED = ("node string, label string, dim int, raw binary, weight long, code binary, factor float, keys array<long>")


@functools.lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same in every task; rows are the new axes."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).T


@functools.lru_cache(maxsize=64)
def planes(dim: int, table: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, 1 + dim, table]).standard_normal((64, dim))[:bits]


def bucket_tables(n: int, threshold: float = THRESHOLD, rows: int = BUCKET_ROWS, miss: float = MISS) -> tuple[int, int]:
    """(bits of a bucket, tables) for n vectors of a label; one bucket holds all while they are few."""
    bits = min(60, max(0, math.ceil(math.log2(max(1, n) / rows))))
    if bits == 0:
        return 0, 1
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


def units(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision, scaled first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, correction factors) of rotated unit vectors."""
    return np.packbits(unit >= 0, axis=1), (np.abs(unit).sum(axis=1) / math.sqrt(unit.shape[1])).astype(np.float32)


def compare(table: pa.Table, threshold: float = THRESHOLD) -> pa.Table:
    """One group, rows of one tile or of two: per linked vector the weight of its links here and the vector it hangs on.

    A pair that also meets in an earlier table is left to that table, so each pair counts once.
    """
    dim, t, within = table["dim"][0].as_py(), table["tab"][0].as_py(), table["a"][0].as_py() == table["b"][0].as_py()
    table = table.take(pa.array(np.argsort(table["tile"].to_numpy(), kind="stable")))
    unit = units(table["raw"].to_pylist(), dim)
    n = len(unit)
    first = n if within else int((table["tile"].to_numpy() == table["a"][0].as_py()).sum())
    lo, hi = (0, n) if within else (first, n)
    signs = np.unpackbits(np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(n, -1), axis=1, count=dim)
    signs = (signs[lo:hi].astype(np.float32) * 2 - 1) / math.sqrt(dim)
    factor = table["factor"].to_numpy()[lo:hi].astype(np.float64)
    reach = math.sqrt(1 - threshold ** 2) * np.sqrt(np.maximum(0, 1 - factor ** 2)) / factor
    # estimate + error >= threshold, multiplied by the factor; the last term covers rounding in single precision.
    least = ((threshold - reach) * factor - 1e-4).astype(np.float32)
    rotated = (unit[:first] @ rotation(dim).T).astype(np.float32)
    earlier = np.array(table["keys"].to_pylist(), dtype=np.int64).reshape(n, -1)[:, :t]
    weight = table["weight"].to_numpy()
    links, pairs = np.zeros(n, dtype=np.int64), []
    for at in range(0, first, _SLAB_ROWS):
        open_pairs = rotated[at:at + _SLAB_ROWS] @ signs.T >= least
        if within:
            open_pairs &= np.arange(n) > np.arange(at, min(at + _SLAB_ROWS, first))[:, None]
        rows, cols = np.flatnonzero(open_pairs.any(axis=1)), np.flatnonzero(open_pairs.any(axis=0))
        if not len(rows):
            continue
        linked = open_pairs[np.ix_(rows, cols)] & (unit[at + rows] @ unit[lo + cols].T >= threshold)
        if t and linked.any():
            linked &= ~(earlier[at + rows][:, None, :] == earlier[lo + cols][None, :, :]).any(axis=2)
        links[at + rows] += linked @ weight[lo + cols]
        links[lo + cols] += linked.T @ weight[at + rows]
        i, j = np.nonzero(linked)
        pairs.append((at + rows[i], lo + cols[j]))
    node = table["node"].to_pylist()
    at, hung = np.flatnonzero(links), np.arange(n)
    if len(at):
        x, y = (np.concatenate(c) for c in zip(*pairs))
        while True:  # smallest reachable place, over links and then over what they reached
            before = hung.copy()
            np.minimum.at(hung, x, hung[y])
            np.minimum.at(hung, y, hung[x])
            hung = hung[hung]
            if np.array_equal(before, hung):
                break
    return pa.table({"node": pa.array([node[i] for i in at], pa.string()), "links": pa.array(links[at]),
                     "near": pa.array([node[i] for i in hung[at]], pa.string())})


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 threshold: float = THRESHOLD, bucket_rows: int = BUCKET_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link if they have the same label and length and a cosine of at least `threshold`. Rows with a null label or a
    null vector, zero vectors and those with null or non-finite components link with nothing and are components of their
    own, as are all rows with a null key (their component and kept are null). Equal vectors of a label are compared once
    and count with their number; rows that repeat a key are vectors of their own. Other columns are not read.
    """
    source = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"),
                            F.col(f"`{vector}`").cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(2):
                x = None if v.as_py() is None else v.values.to_numpy(zero_copy_only=False)
                good = x is not None and len(x) and v.values.null_count == 0 and np.isfinite(x).all() and np.any(x)
                # Minus zero equals zero.
                out.append((x + 0.0).astype("<f8").tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "raw"])

    usable = F.col("raw").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    node = F.when(usable, F.sha2(F.concat(F.col("raw"), F.lit("|").cast("binary"), F.col("label").cast("binary")), 256))
    rows = store(source.mapInArrow(pack, "vec_id long, label string, raw binary").withColumn("node", node), "vectors")
    classes = rows.filter("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("raw").alias("raw"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    classes = store(classes.withColumn("dim", (F.octet_length("raw") / 8).cast("int")), "classes")
    counts = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sized = classes.join(small(store(counts, "counts")), ["label", "dim"]).select("node", "label", "dim", "raw", "weight", "n")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _CODED.split(", ")]
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kinds = np.unique(np.stack([table["dim"].to_numpy(), table["n"].to_numpy()], axis=1), axis=0)
            for dim, n in kinds.tolist():
                some = table.filter(pa.compute.and_(pa.compute.equal(table["dim"], dim), pa.compute.equal(table["n"], n)))
                bits, tables = bucket_tables(n, threshold, bucket_rows)
                unit = units(some["raw"].to_pylist(), dim)
                places = 1 << np.arange(bits, dtype=np.int64)
                keys = np.stack([(unit @ planes(dim, t, bits).T >= 0) @ places for t in range(tables)], axis=1).astype(np.int64)
                packed, factor = codes(unit @ rotation(dim).T)
                columns = {c: some[c] for c in ("node", "label", "dim", "raw", "weight")}
                columns |= {"code": pa.array([x.tobytes() for x in packed], pa.binary()), "factor": pa.array(factor),
                            "keys": pa.array(keys.tolist(), pa.list_(pa.int64()))}
                yield from pa.table({c: columns[c] for c in names}).combine_chunks().to_batches()

    coded = store(sized.mapInArrow(code, _CODED), "coded")
    bucket = ["label", "dim", "tab", "bucket"]
    large = store(coded.select("label", "dim", F.posexplode("keys").alias("tab", "bucket")).groupBy(*bucket).count()
                  .filter(F.col("count") > tile_rows)
                  .withColumn("tiles", F.ceil(F.col("count") / tile_rows).cast("int")).drop("count"), "large")
    placed = coded.select("*", F.posexplode("keys").alias("tab", "bucket")).join(small(large), bucket, "left")
    tiles = F.coalesce("tiles", F.lit(1))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int"))
    meets = F.explode(F.transform(F.sequence(F.lit(0), tiles - 1), lambda x: F.struct(
        F.least(x, F.col("tile")).alias("a"), F.greatest(x, F.col("tile")).alias("b"))))
    groups = placed.withColumn("ab", meets).withColumn("a", F.col("ab.a")).withColumn("b", F.col("ab.b")).drop("ab", "tiles")
    found = store(groups.groupBy(*bucket, "a", "b").applyInArrow(lambda t: compare(t, threshold), "node string, links long, near string"),
                  "found")
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(parts, "node", "left")
    # Stored, so that the join on a component with very many members can be split.
    joined = store(classes.select("node", "weight", "least").join(linked, "node", "left").select(
        "node", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "linked")
    least = store(joined.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    settled = store(joined.join(least, "component").select("node", "component_id", (F.col("links") + F.col("weight") - 1).alias("n_links")), "settled")
    out = rows.select("vec_id", "node").join(settled, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
