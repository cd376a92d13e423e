"""What the operators share: tables, scratch tables in the shared folder, text columns, byte packing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths handed out since `watch()`, for those who know when they are done with.
_watched: list[str] | None = None
#: All of them, for `clear()`.
_paths: list[str] = []


def watch() -> list[str]:
    """From now on scratch paths are noted in the list that this returns, until `_watched` is set anew."""
    global _watched
    _watched = []
    return _watched


def clear(spark: SparkSession) -> None:
    """Delete every scratch table of this process: results that read them can't be read any more."""
    discard(spark, _paths)
    _paths.clear()


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a session on one machine (tests) gets a folder of it; on a
    cluster that is an error, as executors don't share local folders."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _paths.append(path)
    if _watched is not None:
        _watched.append(path)
    return path


def written(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`df` as a written table: its lineage ends there, and a lost executor costs no recomputation above it."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").partitionBy(*(by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame) -> DataFrame:
    """`df`, whose rows are a few numbers, written in no more files than twice the cluster's cores: such tables are made by the
    dozen, and a small file for each shuffle partition would cost more than their rows."""
    return written(df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism))


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of fewer splits than the cluster has cores is dealt out by `key`; any other stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


#: Rows of one key in a task, at least, before the key counts as hot.
HOT = 4096


#: Hot keys at most, and so the rows (a key and a number) of the table of them that is broadcast.
HOT_KEYS = 100_000


def hot_keys(counts: DataFrame, key: str, hot: int = HOT) -> DataFrame | None:
    """key, deals of the keys with more than `hot` rows, from (key, n), written. A key needs more than one `HOT_KEYS`th of all rows
    besides, so there are fewer than HOT_KEYS of them. None if there are none."""
    total, top = counts.agg(F.sum("n"), F.max("n")).first()
    most = max(hot, (total or 0) // HOT_KEYS)
    return narrow(counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("long").alias("deals"))) if (top or 0) > most else None


def dealt(rows: DataFrame, hot: DataFrame | None, key: str, by) -> DataFrame:
    """rows with `deal`: 0, or for a hot key one of its numbers, by the column `by`."""
    if hot is None:
        return rows.withColumn("deal", F.lit(0).cast("long"))
    return rows.join(F.broadcast(hot), key, "left").withColumn("deal", F.pmod(F.xxhash64(by), F.coalesce("deals", F.lit(1).cast("long")))).drop("deals")


def each_deal(rows: DataFrame, hot: DataFrame | None, key: str) -> DataFrame:
    """A copy of rows for each `deal` of their key, to be joined with rows that are dealt."""
    if hot is None:
        return rows.withColumn("deal", F.lit(0).cast("long"))
    return rows.join(F.broadcast(hot), key, "left").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("deals", F.lit(1).cast("long")) - 1))).drop("deals")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text (null: empty) and `more`."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def blocks(batches, limit: int = 8_000_000, column: str = "text"):
    """Arrow batches cut where their text passes `limit` bytes, so that a block of short texts and one of long ones
    take much the same memory. A single longer text is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(col.cast("large_binary").value_lengths() if hasattr(col, "value_lengths") else _lengths(col), dtype=np.int64)
        start, room = 0, limit
        for i, n in enumerate(sizes.tolist()):
            if n > room and i > start:
                yield batch.slice(start, i - start)
                start, room = i, limit
            room -= n
        yield batch.slice(start)


def _lengths(col) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Ids(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs: XXH64 of eight bytes with seed 42, whose primes are fixed values."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(v, n):
        return v << np.uint64(n) | v >> np.uint64(64 - n)

    h = np.uint64(42 + 8) + p5 ^ turned(np.asarray(x, np.int64).view(np.uint64) * p2, 31) * p1
    h = turned(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return (h ^ h >> np.uint64(32)).view(np.int64)
