"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths handed out by this process, for clear().
_paths: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete every scratch table of this process: tables and results that read them can't be read any more."""
    while _paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a session on one machine (tests) gets a folder of it; on a
    cluster that is an error, as executors don't share local folders."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tape-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """`df` as a written table: its lineage ends there, and what is read twice is computed once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
