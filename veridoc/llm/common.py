"""Folders, stored intermediate tables and size checks shared by the operators of this package."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veridoc.session import input_bytes, plan_bytes

__all__ = ["BROADCAST_LIMIT", "input_bytes", "small", "table", "shared_folder", "store", "stored", "place", "without_places",
           "settings", "slices", "discard", "sweep", "to_python", "word_pattern", "lower_ascii"]

#: A side of a join is broadcast only if the planner's size for it, the size of its files once stored, is below this.
BROADCAST_LIMIT = 4 << 20

#: One word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
word_pattern = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below `spark.checkpoint.dir`; a temporary folder serves local mode only when that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="veridoc-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if plan_bytes(df) <= BROADCAST_LIMIT else df


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, so that their space does not add up over the steps."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def sweep(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished steps now: it does so once the driver's garbage collector has met their plans."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of one Arrow batch: whole texts are long, and a batch is held by the JVM and by Python at once.
ARROW_ROWS = 1000


def to_python(df: DataFrame) -> DataFrame:
    """`df` itself, in a session whose Arrow batches suit whole texts."""
    if int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller parts, so that few texts at once become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def stored(docs: DataFrame) -> DataFrame:
    """`docs` itself if its rows have places in files, else a stored copy."""
    try:
        docs.select(*place(docs))
        return docs
    except AnalysisException:
        return store(docs, "rows")


def place(docs: DataFrame) -> tuple[Column, Column]:
    """File and row number of each row of a table that is read from Parquet files, possibly filtered."""
    hidden = docs.metadataColumn("_metadata")
    return hidden.getField("file_path").alias("file"), hidden.getField("row_index").cast("long").alias("row")


def without_places(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose (file, row) is not in `gone`."""
    gone = small(store(gone.select(F.col("file").alias("gone_file"), F.col("row").alias("gone_row")), "gone"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), *place(docs))
    return whole.join(gone, (F.col("file") == F.col("gone_file")) & (F.col("row") == F.col("gone_row")), "left_anti").select("whole.*")


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as double underscores) for the time of a block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. `lower` does that for texts of ASCII characters; others are translated letter by letter."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
