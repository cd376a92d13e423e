"""The `events` table as a trade tape: what the registered queries run on."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeworks.functions.durable import durable, scratch
from tapeworks.functions.numbers import utc_text
from tapeworks.jobs.pipeline import feature_matrix
from tapeworks.operators import bars as B, clean
from tapeworks.operators.features import features
from tapeworks.operators.series import prefix
from tapeworks.schema import RAW_COLUMNS

WIDTH = 900


def millis(ts: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


#: The kind of an event that is a closing record.
CLOSE = "close"


def as_raw(events: DataFrame, by: list[str] | None = None, closing: bool = False) -> DataFrame:
    """Events as raw trades, all cells text: value is the price, props.k the quantity, and the kind of event the side. closing:
    with a column that says whether the event is a closing record."""
    side = F.when(F.col("event_type").isin("purchase", "signup"), "BUY").when(F.col("event_type") == "error", "ERR").otherwise("SELL")
    ms = millis(F.col("ts"))
    cells = {
        "timestamp_ms": ms.cast("string"),
        "timestamp_utc": utc_text(F.floor(ms / 1000), F.pmod(ms, F.lit(1000))),
        "price": F.col("value").cast("string"),
        "quantity": F.get_json_object("props", "$.k"),
        "is_buyer_maker": F.when(side == "SELL", "True").otherwise("False"),
        "agggressor_side": side,
        "trade_id": F.col("event_id").cast("string"),
    }
    return events.select(*(by or []), *[cells[c].alias(c) for c in RAW_COLUMNS], *([(F.col("event_type") == CLOSE).alias("closing")] if closing else []))


def raw(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    """The events as raw trades, dealt out over all cores: making and parsing the cells of a row costs much more than its shuffle, and
    the file's row groups may be few."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return as_raw(events.repartition(max(events.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism), "event_id"), by)


def trades(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    return clean.typed(clean.clean_trades(raw(spark, sf_dir, by)))


def bars(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    return B.bars(trades(spark, sf_dir, by), WIDTH, by)


def unclipped(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    return features(durable(bars(spark, sf_dir, by)), WIDTH, by, chunk=1000)


def spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw tape with cells emptied or set to nothing here and there, by trade_id, as the given events have no such cells."""
    i = F.col("trade_id").cast("long")
    price = F.when(i % 97 == 5, F.lit(None)).when(i % 89 == 7, F.lit("0.0")).otherwise(F.col("price"))
    return raw(spark, sf_dir).withColumns({"price": price, "quantity": F.when(i % 83 == 11, F.lit(None)).otherwise(F.col("quantity"))})


def matrix(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    """The clipped matrix, written once: checks read it several times."""
    return durable(feature_matrix(trades(spark, sf_dir, by), WIDTH, by, chunk=1000)[1])


def rest_pages(spark: SparkSession, sf_dir: str, size: int = 1000) -> DataFrame:
    """Events as REST payloads of `size` trades each."""
    t = raw(spark, sf_dir).where("timestamp_ms is not null and price is not null and quantity is not null")
    fields = {"id": F.col("trade_id").cast("long"), "time": F.col("timestamp_ms").cast("long"), "price": F.col("price"), "qty": F.col("quantity"), "isBuyerMaker": F.col("is_buyer_maker") == "True"}
    one = F.struct(*[c.alias(k) for k, c in fields.items()])
    return t.groupBy(F.floor(F.col("trade_id").cast("long") / size).alias("page")).agg(F.to_json(F.collect_list(one)).alias("payload"))


def messages(events: DataFrame) -> DataFrame:
    """Events as stream messages, a JSON object each (column value), with their `flush` if they are counted off."""
    more = [c for c in ("flush",) if c in events.columns]
    t = as_raw(events, more, closing=True)
    fields = {"closing": F.when(F.col("closing"), True), "T": F.col("timestamp_ms").cast("long"), "p": F.col("price"), "q": F.col("quantity"), "m": F.col("is_buyer_maker") == "True", "a": F.col("trade_id").cast("long")}
    return t.select(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("value"), *more)


SLICES = 10


def sliced(events: DataFrame) -> DataFrame:
    """Events with `slice`, the tenth of the table's time that they lie in."""
    first, last = events.agg(F.min(millis(F.col("ts"))), F.max(millis(F.col("ts")))).first()
    place = (millis(F.col("ts")) - F.lit(first or 0)) * SLICES / F.lit((last or 0) - (first or 0) + 1)
    return events.withColumn("slice", F.coalesce(F.floor(place), F.lit(0)).cast("int"))


#: Flushes that a batch admits at most, and the batches that a tape is cut into as long as they stay below that.
FLUSHES, BATCHES = 1000, 20


def counted_off(events: DataFrame, rows: int) -> DataFrame:
    """Events with `flush`, which counts off `rows` of them in the order of event_id, and `slice`, which counts off flushes: one
    for each batch where there are BATCHES or fewer, at most FLUSHES of them."""
    each = min(FLUSHES, max(1, -(-events.count() // (rows * BATCHES))))
    placed = prefix(events, F.floor(F.col("event_id") / 10_000), ["event_id"])
    numbered = placed.withColumn("flush", F.floor(F.col("idx") / rows).cast("long")).drop("idx")
    return numbered.withColumn("slice", F.floor(F.col("flush") / each).cast("int"))


#: Bytes of a row group of a spooled file, so that several tasks read it.
GROUP_BYTES = 8 << 20


def spool(df: DataFrame, path: str) -> DataFrame:
    """df as a stream of a file for each value of its column `slice`, in this order, one for each batch."""
    spark = df.sparkSession
    df.repartition("slice").write.option("parquet.block.size", GROUP_BYTES).partitionBy("slice").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files, now = fs.listFiles(hadoop.Path(path), True), int(time.time() * 1000)
    while files.hasNext():  # a stream takes files in the order of their times
        file = files.next().getPath()
        if found := re.search(r"/slice=(\d+)/", str(file.toString())):
            fs.setTimes(file, now - 10_000_000 + int(found[1]) * 1000, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def events_stream(spark: SparkSession, sf_dir: str, rows: int | None = None, close_ms: int | None = None) -> DataFrame:
    """The events as a stream of SLICES files in the order of time, or of files of flushes of `rows` events each. close_ms: with a
    closing record at the end, so long after the last event. A file is one batch, whose rows are dealt out over all cores."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cut = counted_off(events, rows) if rows else sliced(events)
    if close_ms is not None:
        ends = cut.agg(F.max("slice").alias("slice"), F.max("ts").alias("ts")).where("ts is not null")
        late = (F.col("ts") + F.make_dt_interval(secs=F.lit(close_ms / 1000))).cast(events.schema["ts"].dataType)
        cut = cut.unionByName(ends.select((F.col("slice") + 1).alias("slice"), late.alias("ts"), F.lit(CLOSE).alias("event_type")), allowMissingColumns=True)
    stream = spool(cut, scratch(spark))
    return stream if rows else stream.repartition(spark.sparkContext.defaultParallelism, "event_id")  # flushes are dealt out where they are collected
