"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir; on a single machine without it a temporary folder; else None."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.startswith("local"):
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tables-"))
        folder = _LOCAL[0]
    return folder.rstrip("/") if folder else None


_WRITTEN: list[str] = []


def discard(spark: SparkSession) -> int:
    """Deletes the tables that `written` has written so far; call it when results that read them are written."""
    n, jvm = len(_WRITTEN), spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table that is computed once, however often it is read; df itself where there is no shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        return df
    path = f"{folder}/candles-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)
