"""Files of folders, listed by Spark's binary source; contents are read only when asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

FILE_SCHEMA = "folder string, path string, name string, length long, modified timestamp"
#: Files of documents, whatever the case of their ending.
DOCUMENTS = "*.[pP][dD][fF]"


def _folder(spark: SparkSession, folder: str, pattern: str, deep: bool, content: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", deep)
    try:
        found = reader.load(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILE_SCHEMA + (", content binary" if content else ""))
    # Without `recursiveFileLookup`, folders named key=value are read as partitions: only files right inside count.
    inside = F.col("path") if deep else F.regexp_replace("path", r"/[^/]*$", "")
    kept = found if deep else found.where(F.element_at(F.split(inside, "/"), -1) == folder.rstrip("/").rsplit("/", 1)[-1])
    return kept.select(F.lit(folder).alias("folder"), "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length",
                       F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def list_files(spark: SparkSession, folders: list[str], pattern: str = DOCUMENTS, deep: bool = False, content: bool = False) -> DataFrame:
    """(folder, path, name, length, modified[, content]): files of the folders that match the pattern.

    A folder that is missing or empty, or a blank name, gives no rows, nor does a file of no bytes, which Spark's source leaves out. `deep` takes folders below as well. Without `content` no file is opened:
    the columns come from the listing. A folder named twice is listed once.
    """
    named = [f for f in dict.fromkeys(folders) if f and f.strip()]
    tables = [_folder(spark, f, pattern, deep, content) for f in named]
    empty = spark.createDataFrame([], FILE_SCHEMA + (", content binary" if content else ""))
    return reduce(DataFrame.unionByName, tables) if tables else empty
