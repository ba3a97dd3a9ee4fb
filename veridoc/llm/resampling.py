"""Importance resampling toward a target distribution over hashed word n-grams, with exact ranks by regular sampling.

Every run of one to three words is a feature; features fall into buckets by CRC-32. Two arrays of bucket counts, of all
documents and of all target texts, give one gain for each bucket, and a document's weight is the sum of the gains of its
features. Checksums of runs are composed from those of their words, so a batch of texts is scored by array operations.

Scores are ranked by parallel sorting by regular sampling: partitions are sorted where they lie (runs), every k-th row of
each run is a sample, evenly spaced samples are the splitters, the segments between splitters are exchanged and sorted, and
sums over the sizes of the segments before give exact ranks. Segments that lie behind the last rank drawn stay where they are.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from veridoc.llm.common import store, to_python

BUCKETS = 10_000
#: Only documents of so many words are drawn, and this share of them.
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of text that are looked at together; words up to this length are hashed side by side.
CHUNK, SHORT = 1 << 21, 32
#: Samples that the driver takes at most, beside one for each run; rows of a segment, and the largest number of segments.
SAMPLES, SEGMENT_ROWS, SEGMENTS = 1 << 16, 20_000, 1 << 13

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Words are runs of digits, letters A-Z and bytes of characters beyond ASCII.
_IN_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_BYTES >= 0x80)


def _step_table() -> np.ndarray:
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, (r >> 1) ^ np.uint32(0xEDB88320), r >> 1).astype(np.uint32)
    return r


_STEP = _step_table()


def _tables(images: np.ndarray) -> np.ndarray:
    """Four lookup tables, one for each byte, of the linear map that takes bit i to images[i]."""
    out = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte] ^= np.where(_BYTES >> bit & 1, images[8 * byte + bit], 0).astype(np.uint32)
    return out


def _apply(tables: np.ndarray, r: np.ndarray) -> np.ndarray:
    return tables[0][r & 255] ^ tables[1][r >> 8 & 255] ^ tables[2][r >> 16 & 255] ^ tables[3][r >> 24]


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Maps that append n zero bytes, for every n up to 2 * SHORT and for powers of two."""
    image, near, powers = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32), [], []
    for _ in range(2 * SHORT + 1):
        near.append(_tables(image))
        image = (_STEP[image & 255] ^ (image >> 8)).astype(np.uint32)
    power = near[1]
    for _ in range(31):
        powers.append(power)
        power = _tables(_apply(power, _apply(power, (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32))))
    return np.stack(near, axis=1), np.stack(powers)


_NEAR, _POWERS = _shift_tables()
_BLANK = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums as they stand after n more zero bytes; xor with the checksum of n bytes appends those."""
    at = np.minimum(n, 2 * SHORT)
    out = (_NEAR[0][at, crc & 255] ^ _NEAR[1][at, crc >> 8 & 255] ^ _NEAR[2][at, crc >> 16 & 255] ^ _NEAR[3][at, crc >> 24])
    far = np.flatnonzero(n > 2 * SHORT)
    if len(far):
        r, rest = crc[far], n[far]
        for k, table in enumerate(_POWERS):
            r = np.where(rest >> k & 1, _apply(table, r), r)
        out[far] = r
    return out


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, CRC-32, bytes) of all words of an array of binary texts, letters A-Z in lower case."""
    texts = texts.fill_null(b"")
    if not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8) if len(texts) else np.zeros(0, np.uint8)
    found, at, last = [], int(bounds[0]), int(bounds[-1])
    while at < last:
        end = _cut(data, bounds, min(at + CHUNK, last), last)
        found.append(_chunk_words(data, bounds, at, end))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return tuple(np.concatenate(part) for part in zip(*found))


def _cut(data: np.ndarray, bounds: np.ndarray, end: int, last: int) -> int:
    """The first place from `end` on that no word runs over."""
    stop = int(bounds[np.searchsorted(bounds, end)]) if end < last else last
    while end < stop:
        outside = np.flatnonzero(~_IN_WORD[data[end:min(end + CHUNK, stop)]])
        if len(outside):
            return end + int(outside[0])
        end = min(end + CHUNK, stop)
    return stop


def _chunk_words(data: np.ndarray, bounds: np.ndarray, at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = _LOWER[data[at:end]]
    inside = np.zeros(len(part) + 2, dtype=bool)
    inside[1:-1] = _IN_WORD[part]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    # Texts touch each other in the buffer; a word never runs from one into the next.
    edges = bounds[(bounds > at) & (bounds < end)] - at
    starts[edges] = inside[edges + 1]
    ends[edges - 1] = inside[edges]
    start, size = np.flatnonzero(starts), np.flatnonzero(ends)
    size = size - start + 1
    crc = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    open_ = np.arange(len(start))
    for k in range(SHORT):
        open_ = open_[size[open_] > k]
        if not len(open_):
            break
        r = crc[open_]
        crc[open_] = _STEP[(r ^ part[start[open_] + k]) & 255] ^ (r >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in open_[size[open_] > SHORT]:
        crc[i] = zlib.crc32(part[start[i]:start[i] + size[i]])
    text = np.searchsorted(bounds, start + at, side="right") - 1
    return text, crc, size


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of the runs of one, two and three words; one pair of arrays for each length."""
    text, crc, size = words(texts)
    yield text, (crc % BUCKETS).astype(np.int64)
    run, then = crc, shifted(np.full(len(crc), _BLANK), size) ^ crc
    for length in (2, 3):
        if len(crc) < length:
            return
        run = shifted(run[:-1], size[length - 1:] + 1) ^ then[length - 1:]
        whole = text[length - 1:] == text[:1 - length]
        yield text[length - 1:][whole], (run[whole] % BUCKETS).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for _, bucket in features(batch.column(0)):
            sums += np.bincount(bucket, minlength=BUCKETS)
    hit = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(sums[hit])], names=["bucket", "n"])


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket; tasks sum whole arrays, so few rows are shuffled and BUCKETS numbers collected."""
    rows = to_python(docs).select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(_count, "bucket int, n long")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket under both distributions, one count added everywhere."""
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS))))
                     for s, t in zip(source.astype(float), target.astype(float))], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_features, n_words, weight) of every row, with the array of gains sent along (BUCKETS numbers)."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros((3, batch.num_rows), dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for k, (of, bucket) in enumerate(features(batch.column(1))):
                n[k] = np.bincount(of, minlength=batch.num_rows)
                # Sums of whole numbers below 2**53, so they are exact in doubles.
                total += np.bincount(of, weights=gain[bucket], minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.sum(axis=0)), pa.array(n[0]), pa.array(total)],
                                             names=["key", "n_features", "n_words", "weight"])
    rows = to_python(docs).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("n_features", T.LongType()),
                           T.StructField("n_words", T.LongType()), T.StructField("weight", T.LongType())])
    return rows.mapInArrow(score, schema)


def chance(key: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths, from a hash of the key; a null key counts as the text null."""
    word = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(word, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, most: int, total: int, score: str = "score", key: str = "key") -> DataFrame:
    """`rows` (stored, `total` of them) with `rank`: 1.. by score from the highest on and key, null behind the first `most`.

    Keys that are null come last of their score; rows equal in both are told apart by their place, so even very many of
    them are split between segments.
    """
    order = [F.col(score).desc(), F.col(key).asc_nulls_last()]
    runs = rows.sortWithinPartitions(*order).withColumn("_run", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    runs = store(runs, "resample-runs")
    step = max(1, total // SAMPLES)
    places = [score, key, "_run", "_at"]
    samples = sorted(_place(*r) for r in runs.filter(F.col("_at") % step == step // 2).select(*places).collect())
    parts = min(SEGMENTS, -(-total // SEGMENT_ROWS), len(samples) + 1)
    splitters = [samples[len(samples) * k // parts] for k in range(1, parts)]

    @F.pandas_udf("int")
    def segment(s: pd.Series, k: pd.Series, run: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(splitters, _place(*r)) for r in zip(s, k, run, at)], dtype="int32")

    cut = store(runs.withColumn("_segment", segment(*places)), "resample-segments")
    sizes = {r["_segment"]: r["count"] for r in cut.groupBy("_segment").count().collect()}
    starts, before = [], 0
    for k in range(max(1, parts)):
        starts.append(before)
        before += sizes.get(k, 0)
    needed = sum(1 for s in starts if s < most)
    inner = F.row_number().over(W.partitionBy("_segment").orderBy(*order, "_run", "_at"))
    start = F.element_at(F.array(*(F.lit(s).cast("long") for s in starts[:needed] or [0])), F.col("_segment") + 1)
    top = cut.filter(F.col("_segment") < needed).withColumn("rank", (inner + start).cast("long"))
    top = top.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = cut.filter(F.col("_segment") >= needed).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).drop("_run", "_at", "_segment")


def _place(score, key, run, at) -> tuple:
    missing = key is None or key != key
    return -int(score), missing, None if missing else key, int(run), int(at)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = 42) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of `docs`; other columns are not read.

    A null or empty text has no features and weight 0. floor(percent * N / 100) of the N rows with `least_words` words or
    more are drawn and get rank 1, 2, 3, ...; all others have a null rank. A null key is a value like others and comes last
    among equal scores; rows repeated in key and text have one score and stand next to each other. With an empty target the
    weights favour rare features; an empty table gives an empty one. Texts are read twice, for the counts and for the weights.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    rows = weigh(docs, gain, key, text).withColumn("score", F.col("weight") + chance(F.col("key"), seed))
    rows = store(rows, "resample-scores")
    open_ = rows.filter(F.col("n_words") >= least_words)
    total = open_.count()
    drawn = ranked(open_, percent * total // 100, total)
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("key", "n_features", "weight", "score", "rank")
