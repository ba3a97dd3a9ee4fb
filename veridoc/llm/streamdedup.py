"""Exact deduplication by a stateful stream over content digests.

New rows are appended to a log of (digest, identifier, locator); a stream reads the log and keeps one keyed state for each
digest in a disk-backed store, without a watermark, so that no key expires. The state holds the number of rows, the
identifier of the row that stays and the locator of its content. A hit, a row whose digest is there already, counts as a
copy only after its bytes have been compared: rows of one digest whose texts differ are separated. Everything is DataFrame
and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from veridoc.llm.common import lower_ascii, place, settings, shared_folder, small, store, stored, without_places

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOG = T.StructType([T.StructField("digest", T.StringType()), T.StructField("id", T.LongType()), T.StructField("file", T.StringType()),
                    T.StructField("row", T.LongType())])


def normal_text(text: Column) -> Column:
    """Null counts as empty; A-Z are lower-cased, nothing else."""
    return lower_ascii(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class StreamDedup:
    """State of all rows taken in so far, in a folder; `add` takes in further rows, also in a later session."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", text: str = "text", digest=sha256,
                 files_per_batch: int | None = None):
        self.spark, self.folder, self.key, self.text, self.digest = spark, folder, key, text, digest
        self.files_per_batch = files_per_batch

    def located(self, docs: DataFrame) -> DataFrame:
        """digest, id, file, row and normalised text; file and row are the place of the content in stored files.

        `docs` must be read from files, possibly filtered; that is what makes its rows addressable.
        """
        return docs.select(F.col(f"`{self.key}`").cast("long").alias("id"), *place(docs),
                           normal_text(F.col(f"`{self.text}`")).alias("t")).withColumn("digest", self.digest(F.col("t")))

    def add(self, docs: DataFrame) -> None:
        """Append the digests of `docs` to the log and let the stream take them in."""
        self.located(docs).select(*LOG.names).write.mode("append").parquet(f"{self.folder}/log")
        source = self.spark.readStream.schema(LOG)
        if self.files_per_batch:
            source = source.option("maxFilesPerTrigger", self.files_per_batch)
        # Of equal identifiers, the one stored last stays; null is below every identifier.
        state = source.parquet(f"{self.folder}/log").groupBy("digest").agg(
            F.count("*").alias("rows"), F.max(F.struct("id", "file", "row")).alias("stays"))
        with settings(self.spark, spark__sql__streaming__stateStore__providerClass=_STORE,
                      spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
                      spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
                      spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
                      spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="64"):
            (state.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{self.folder}/state")
             .trigger(availableNow=True).start().awaitTermination())

    def state(self) -> DataFrame:
        """(digest, rows, stays): the keyed state as it is stored."""
        kept = self.spark.read.format("statestore").load(f"{self.folder}/state")
        return kept.select(F.col("key.digest").alias("digest"), F.col("value.count").alias("rows"), F.col("value.max").alias("stays"))

    def differing(self, docs: DataFrame) -> DataFrame | None:
        """Full bytes of all hits: (digest, t, rows, stays) of each text of the digests that stand for several texts.

        `docs` holds all rows taken in. Rows whose digest others share fall together by their whole text, first within
        each task; a digest that is left with one text is confirmed. None if all are.
        """
        shared = small(store(self.state().filter("rows > 1").select("digest"), "shared"))
        texts = self.located(docs).join(shared, "digest", "left_semi").groupBy("digest", "t").agg(
            F.count("*").alias("rows"), F.max(F.struct("id", "file", "row")).alias("stays"))
        wrong = store(texts.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "differing")
        return None if wrong.isEmpty() else texts.join(wrong, "digest", "left_semi")

    def rows(self, docs: DataFrame) -> DataFrame:
        """(id, file, row, digest, keep_id, group_size, kept) of every row of `docs`, which holds all rows taken in."""
        log = self.spark.read.schema(LOG).parquet(f"{self.folder}/log")
        found = log.join(self.state(), "digest")
        texts = self.differing(docs)
        if texts is not None:
            texts = store(texts, "texts")
            apart = self.located(docs).join(texts, ["digest", "t"]).select(found.columns)
            found = found.join(texts.select("digest").distinct(), "digest", "left_anti").union(apart)
        here = F.struct("id", "file", "row").eqNullSafe(F.col("stays"))
        return found.select("id", "file", "row", "digest", F.col("stays.id").alias("keep_id"), F.col("rows").alias("group_size"),
                            here.alias("kept"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, file, row) of every row of `docs`, dropped ones too.

    Texts are equal when they are identical after lower-casing A-Z only; null counts as empty. Of equal texts, the row with
    the largest id stays; null ids are below all others; of rows with that id the one stored last stays. Whole texts are
    read; other columns are not. An empty table gives an empty one.
    """
    source = stored(docs)
    state = StreamDedup(docs.sparkSession, shared_folder(docs.sparkSession, "dedup"), key, text, **options)
    state.add(source)
    return state.rows(source).withColumnRenamed("id", "doc_id")


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay. The rows that go are fewer and are what is matched by place."""
    source = stored(docs)
    return without_places(source, exact_duplicates(source, key, text).filter("not kept"))
