"""Session settings, lineage cuts and size checks shared by all operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side may be broadcast only when the planner's size estimate is below this.
BROADCAST_LIMIT = 64 * 1024 * 1024
# Compact rows (one text per row, as stored) that one task expands into words. Compression hides several times that size, a word is a
# row of some 200 bytes, and the sorts and lists of a task must stay in memory.
BYTES_PER_TASK = 1024 * 1024


def build_session(app: str = "veridoc", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Checkpoint files go when nothing refers to them any more.
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every plan relies on; all are safe at any scale."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def plan_bytes(df: DataFrame) -> int:
    """Planner's size estimate; no job runs. Estimates multiply along joins and may have more digits than Python converts."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except ValueError:
        return 1 << 62


def input_bytes(df: DataFrame) -> int:
    """Summed size of the tables a plan reads (join estimates multiply, so they are of no use here)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def small(df: DataFrame) -> DataFrame:
    """Mark a side for broadcast only when its estimated size is bounded."""
    return F.broadcast(df) if plan_bytes(df) <= BROADCAST_LIMIT else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash compact rows by key, before they are expanded, with enough tasks."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism,
                math.ceil(input_bytes(df) / BYTES_PER_TASK))
    return df.repartition(tasks, *keys)


def _shared_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="veridoc-ckpt-")
        sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name that all executors can reach."""
    _shared_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a written table in the shared folder. Unlike a checkpoint it has the size of its files as estimate,
    not that of its plan, which loops would multiply."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
