"""A tape as a table of day folders that flushes are taken into, and whose small files a job packs while others read.

Files never change. Each change writes new folders `part=N/day=D` and then a list of the folders that are the table, as version N of
`_log`. Readers take the last list there is, so they see the table before or after a change, never between; folders that no
list names any more go with `clean_up()`, when their readers are done. Two writers that begin from one version: the second one
fails and leaves the table as it is.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tapeworks.schema import RAW_COLUMNS
from tapeworks.sources.trades import RAW_SCHEMA

#: Bytes of a packed file, about.
TARGET = 256 << 20


class Conflict(RuntimeError):
    """Another writer has made, or claimed, the next version."""


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(fs, p, path: str) -> list[str]:
    return [f.getPath().getName() for f in fs.listStatus(p(path))] if fs.exists(p(path)) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _files(spark, path)
    return sorted(int(n.removesuffix(".json")) for n in _names(fs, p, f"{path}/_log") if n.endswith(".json"))


def state(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """version, folders, batches (flushes taken so far) of a table; of an empty one if there is none."""
    known = versions(spark, path)
    if not known:
        return {"version": 0, "folders": [], "batches": 0}
    return json.loads(spark.read.text(f"{path}/_log/{version or known[-1]:08d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, new: dict) -> None:
    fs, p = _files(spark, path)
    at = f"{path}/_log/{new['version']:08d}"
    if new["version"] <= max(versions(spark, path), default=0) or not fs.createNewFile(p(f"{at}.claim")):
        raise Conflict(f"version {new['version']} of {path} is taken")
    out = fs.create(p(f"{at}.tmp"), True)
    out.write(json.dumps(new).encode())
    out.close()
    fs.rename(p(f"{at}.tmp"), p(f"{at}.json"))


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The raw rows and their day (UTC)."""
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField("part", T.IntegerType()), T.StructField("day", T.DateType())])
    folders = state(spark, path, version)["folders"]
    if not folders:
        return spark.createDataFrame([], schema).drop("part")
    return spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/{f}" for f in folders)).drop("part")


def _written(rows: DataFrame, path: str, version: int) -> list[str]:
    """The new folders of rows with a day."""
    part = f"part={version}"
    rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/{part}")
    fs, p = _files(rows.sparkSession, path)
    return [f"{part}/{n}" for n in _names(fs, p, f"{path}/{part}") if n.startswith("day=")]


def day_of(ms: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))


def take_flushes(spark: SparkSession, flushes: str, path: str) -> int:
    """Take the flushes that collect_trades() has finished under `flushes` since last time into the table; how many. A flush's
    heartbeat is its last output, so a flush without one is left for later; none is taken twice."""
    before = state(spark, path)
    fs, p = _files(spark, flushes)
    done = {int(n.removeprefix("batch=")) for n in _names(fs, p, f"{flushes}/beats") if n.startswith("batch=") and fs.exists(p(f"{flushes}/beats/{n}/_SUCCESS"))}
    upto = before["batches"]
    while upto in done:
        upto += 1
    if upto == before["batches"]:
        return 0
    version = before["version"] + 1
    raw = spark.read.schema(RAW_SCHEMA).option("header", True).csv([f"{flushes}/trades/batch={k}" for k in range(before["batches"], upto)])
    folders = _written(raw.withColumn("day", day_of(F.col("timestamp_ms").cast("long"))).repartition("day"), path, version)
    _commit(spark, path, {"version": version, "folders": before["folders"] + folders, "batches": upto})
    return upto - before["batches"]


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """day, files, bytes of the table's days."""
    rows = read_table(spark, path).select("day", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def pack(spark: SparkSession, path: str, target: int = TARGET) -> int:
    """Rewrite the days that have more files than their bytes need, as that many of about `target` bytes; how many days. Other days
    keep their folders. A day's rows are dealt to its files by the hour and trade_id, each file in the order of time."""
    before = state(spark, path)
    if not before["folders"]:
        return 0
    needed = files_of(spark, path).select("day", "files", F.ceil(F.col("bytes") / target).cast("int").alias("need")).where(F.col("files") > F.col("need"))
    days = {str(r.day): r.need for r in needed.collect()}  # a row for each day
    if not days:
        return 0
    version = before["version"] + 1
    of = F.create_map(*[x for d, n in days.items() for x in (F.lit(d), F.lit(n))])[F.col("day").cast("string")]
    rows = read_table(spark, path).where(F.col("day").cast("string").isin(list(days)))
    dealt = rows.withColumn("_file", F.pmod(F.xxhash64(F.floor(F.col("timestamp_ms").cast("long") / 3_600_000), "trade_id"), of))
    packed = dealt.repartition(sum(days.values()), "day", "_file").sortWithinPartitions("day", F.col("timestamp_ms").cast("long"), F.col("trade_id").cast("long")).select(*RAW_COLUMNS, "day")
    folders = _written(packed, path, version)
    left = [f for f in before["folders"] if f.rpartition("day=")[2] not in days]
    _commit(spark, path, before | {"version": version, "folders": left + folders})
    return len(days)


def clean_up(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete folders and lists that none of the last `keep` versions names; how many folders."""
    fs, p = _files(spark, path)
    known = versions(spark, path)
    kept = reduce(lambda a, b: a | b, ({*state(spark, path, v)["folders"]} for v in known[-keep:]), set())
    gone = 0
    for part in (n for n in _names(fs, p, path) if n.startswith("part=") and int(n[5:]) <= known[-1]):
        for day in _names(fs, p, f"{path}/{part}"):
            if day.startswith("day=") and f"{part}/{day}" not in kept:
                gone += fs.delete(p(f"{path}/{part}/{day}"), True)
    for v in known[:-keep]:
        fs.delete(p(f"{path}/_log/{v:08d}.json"), False)
    return gone
