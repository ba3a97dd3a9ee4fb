"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard is one file that Spark's writer commits, so that retries leave whole files in any store. It is a row of frames:

    length of the payload (u64) | masked checksum of those 8 bytes (u32) | payload | masked checksum of it (u32) | 0x0A

Numbers are little-endian. A checksum is CRC-32, rotated right by 15 bits, plus a constant. A payload is a 16-byte head
(kind u8, bytes of an id u8, 2 zero bytes, number of ids u32, identifier i64) and the ids. The first frame of a shard has
kind 0 and the shard's number as identifier; documents have kind 1, or 2 if their identifier is null. The closing 0x0A is
no part of the length.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from veridoc.llm.common import input_bytes, shared_folder, slices, small, to_python
from veridoc.llm.tokens import default_tokenizer, encoder

#: Stored bytes of input of one shard; bounds the file that a reader holds.
SHARD_INPUT_BYTES = 16 << 20
SHARD, DOCUMENT, NULL_DOCUMENT = 0, 1, 2
#: Fixed value of the masked checksum, as commonly used for such record files.
_MASK = 0xA282EAD8
_HEAD = struct.Struct("<BBHIq")
_LENGTH = struct.Struct("<Q")
_U32 = struct.Struct("<I")
_OPEN, _CLOSE = 12, 5
_YIELD_BYTES = 4 << 20


class CorruptRecord(ValueError):
    """A frame whose lengths or checksums do not hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One frame without its closing line feed, which the writer adds."""
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _U32.pack(masked(length)), payload, _U32.pack(masked(payload))))


def payload(kind: int, identifier: int, ids: bytes, width: int) -> bytes:
    return _HEAD.pack(kind, width, 0, len(ids) // width, identifier) + ids


def frames(data: bytes) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(offset, kind, identifier, length of the frame, ids) of each frame of a shard; raises CorruptRecord."""
    at, view = 0, memoryview(data)
    while at < len(data):
        kind, identifier, size, ids = frame_at(view, at)
        yield at, kind, identifier, size, ids
        at += size


def frame_at(view: memoryview, at: int) -> tuple[int, int, int, np.ndarray]:
    if at + _OPEN > len(view):
        raise CorruptRecord(f"cut off at {at}")
    length = view[at:at + 8]
    n = _LENGTH.unpack(length)[0]
    if _U32.unpack(view[at + 8:at + _OPEN])[0] != masked(length):
        raise CorruptRecord(f"length at {at}")
    end = at + _OPEN + n
    if end + _CLOSE > len(view) or n < _HEAD.size or view[end + 4] != 0x0A:
        raise CorruptRecord(f"cut off at {at}")
    body = view[at + _OPEN:end]
    if _U32.unpack(view[end:end + 4])[0] != masked(body):
        raise CorruptRecord(f"payload at {at}")
    kind, width, _, count, identifier = _HEAD.unpack(body[:_HEAD.size])
    if n != _HEAD.size + width * count or width not in (2, 4):
        raise CorruptRecord(f"payload at {at}")
    return kind, identifier, end + _CLOSE - at, np.frombuffer(body[_HEAD.size:], dtype=f"<u{width}")


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
                  shards: int | None = None) -> None:
    """Encode whole texts and write them in ascending order of `key`, one shard per range of keys.

    Null texts count as empty and have the end id only. Null keys come first; rows of one key are ordered by a hash of
    their text, so that a key with many rows is spread over shards too. Columns other than these two are not read.
    An empty table gives shards without documents.
    """
    source = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    tasks = shards or max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(input_bytes(docs) / SHARD_INPUT_BYTES))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t"), F.col("n")]
    # The row number spreads equal rows of one key.
    ranged = source.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        width, end = tool.dtype.itemsize, np.array([end_id], dtype=tool.dtype).tobytes()
        out, size = [frame(payload(SHARD, TaskContext.get().partitionId(), b"", width))], 0
        for batch in slices(batches):
            for k, ids in zip(batch.column(0).to_pylist(), tool.encode(batch.column(1).to_pylist())):
                out.append(frame(payload(NULL_DOCUMENT if k is None else DOCUMENT, k or 0, ids + end, width)))
                size += len(out[-1])
                if size >= _YIELD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    # The text writer puts out the bytes as they are, each row with a line feed.
    (to_python(ranged.select("k", "t")).mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.text(folder))


def build_index(spark: SparkSession, folder: str, index_folder: str) -> DataFrame:
    """Read all shards back, check every frame and write the offset index.

    Columns: shard, path, place (in the shard), doc_id, offset and length of the frame, shard_start (ids of the shard
    before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit numbers).
    """
    schema = ("shard long, path string, place long, doc_id long, offset long, length long, shard_start long, "
              "n_tokens long, ids_crc32 long")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, shard, before = [], None, 0
                for at, kind, identifier, size, ids in frames(content.as_buffer()):
                    if kind == SHARD:
                        shard = identifier
                        continue
                    rows.append((shard, path.as_py(), len(rows), None if kind == NULL_DOCUMENT else identifier, at, size, before,
                                 len(ids), zlib.crc32(ids.astype("<u4"))))
                    before += len(ids)
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if n == "path" else pa.int64()) for n, c in zip(names, columns)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "content")
    files.mapInArrow(run, schema).write.parquet(index_folder)
    return spark.read.schema(schema).parquet(index_folder)


def with_starts(index: DataFrame) -> DataFrame:
    """Add `start`, the ids of all documents before one; only one row per shard meets in the running sum."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    bases = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return index.join(bases, "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def read_records(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records that rows of the index name, by their offsets: doc_id and ids; order and choice are the caller's."""
    by_file = wanted.groupBy("path").agg(F.collect_list(F.struct("offset", "length")).alias("spans"))  # of one shard
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, spans in zip(batch.column(0), batch.column(1).to_pylist()):
                view = memoryview(content.as_buffer())
                found = [frame_at(view, s["offset"]) for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array([None if k == NULL_DOCUMENT else i for k, i, _, _ in found], pa.int64()),
                                                  pa.array([x.tolist() for *_, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return files.join(small(by_file), "path").select("content", "spans").mapInArrow(run, "doc_id long, ids array<long>")


def token_records(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write records and index in the shared folder; return the index with starts."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "records")
    write_records(docs, f"{folder}/shards", tokenizer or default_tokenizer(), end_id)
    return with_starts(build_index(spark, f"{folder}/shards", f"{folder}/index"))
