"""Live trades: messages to raw files in flushes of a bounded number of rows, bars and running sums as streams that close.

A closing record is a message of a time and `closing` alone. It is no trade; it moves the watermark, so that bars and sums of a
tape that has ended come out of the stream itself. Its time lies a delay and a bar's width after the last trade.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tapeworks.functions.numbers import rounded
from tapeworks.operators import clean
from tapeworks.operators.bars import aggregates, finished
from tapeworks.schema import RAW_COLUMNS, TINY
from tapeworks.sources.trades import parse_messages

FLUSH_ROWS, FLUSH_S = 50, 5


def flush_options(rows: int = FLUSH_ROWS, seconds: int = FLUSH_S) -> dict[str, str]:
    """Options of a Kafka stream that give a batch as soon as `rows` messages wait, or some have waited `seconds`, and never more
    than `rows`. Offsets there are rows, so the broker bounds what a batch admits."""
    return {"minOffsetsPerTrigger": str(rows), "maxOffsetsPerTrigger": str(rows), "maxTriggerDelay": f"{seconds}s"}


def spooled_messages(spark: SparkSession, spool: str, rows: int = FLUSH_ROWS, file_rows: int = FLUSH_ROWS) -> DataFrame:
    """Messages (column value) of a folder of text files, of `file_rows` lines each at most, that a connector adds to: a batch
    admits as many files as make `rows` rows at most."""
    if file_rows > rows:
        raise ValueError(f"files of {file_rows} rows don't fit batches of {rows}")
    return spark.readStream.option("maxFilesPerTrigger", rows // file_rows).text(spool)


def closing_message(at_ms: int) -> str:
    return json.dumps({"T": at_ms, "closing": True})


class Beats(StreamingQueryListener):
    """Of each batch of a query begun with collect_trades(): number, rows, dead letters and rows a second, as Spark reports them."""

    def __init__(self):
        self.seen: list[tuple[int, int, int, float]] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        if beat := (p.observedMetrics or {}).get("beat"):
            self.seen.append((p.batchId, beat["rows"], beat["dead"], p.processedRowsPerSecond))

    def onQueryTerminated(self, event):
        pass


def collect_trades(messages: DataFrame, path: str, checkpoint: str, flush_s: int | None = None, kind: str = "csv"):
    """One query that reads a message stream (column value) once. Each batch becomes, under `path`, the raw rows in
    trades/batch=N, messages that can't be read in dead/batch=N and a row (rows, dead, at) in beats/batch=N. A batch that runs
    again after a failure takes its own folders' place, so nothing is there twice and counts agree. How many rows a batch has is
    the reader's matter: flush_options(), spooled_messages(). flush_s: seconds between batches; None drains what is there.

    Messages with a column `flush` are flushed by it: a batch admits many flushes, each of them whole, N is a flush's number, and
    a flush has one file. Beats are then a row for each flush, in beats/of=the batch's number. So a flush costs its rows and
    its file, not a batch of Spark's."""
    flushes = "flush" in messages.columns
    parsed = parse_messages(messages.repartition("flush") if flushes else messages)
    counts = (F.count_if("good").alias("rows"), F.count_if(~F.col("good") & ~F.col("closing")).alias("dead"))

    def into(rows: DataFrame, name: str, n: int, *columns: str):
        """The writer of columns, and the folder."""
        if not flushes:
            return rows.select(*columns).write.mode("overwrite"), f"{path}/{name}/batch={n}"
        own = rows.select(*columns, F.col("flush").alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        return own.partitionBy("batch"), f"{path}/{name}"

    def flush(batch: DataFrame, n: int) -> None:
        held = batch.persist()  # a batch's rows, which the reader bounds, for the three outputs
        try:
            files, folder = into(held.where("good"), "trades", n, *RAW_COLUMNS)
            (files.option("header", True).csv if kind == "csv" else files.parquet)(folder)
            files, folder = into(held.where("not good and not closing"), "dead", n, "value")
            files.parquet(folder)
            beats = held.groupBy(F.col("flush").alias("batch")).agg(*counts) if flushes else held.agg(*counts)
            beats.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/beats/{'of' if flushes else 'batch'}={n}")
        finally:
            held.unpersist()

    w = parsed.observe("beat", *counts).writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if flush_s is None else w.trigger(processingTime=f"{flush_s} seconds")).start()


def heartbeats(spark: SparkSession, beats: str) -> DataFrame:
    """batch, rows, dead, at, rows_per_s since the batch before of the same day."""
    o = Window.partitionBy(F.to_date("at")).orderBy("batch")  # a row for each flush
    seconds = F.col("at").cast("double") - F.lag("at").over(o).cast("double")
    rate = F.when(seconds > 0, F.col("rows") / F.when(seconds > 0, seconds)).alias("rows_per_s")
    return spark.read.schema("rows long, dead long, at timestamp, batch long").parquet(beats).select("batch", "rows", "dead", "at", rate)


def clean_stream(raw: DataFrame) -> DataFrame:
    """Typed clean trades of a stream of raw rows, and its closing records (column closing; false if there is none)."""
    closing = F.coalesce(F.col("closing"), F.lit(False)) if "closing" in raw.columns else F.lit(False)
    return clean.typed(clean.judged(raw.withColumn("closing", closing)).where("closing or reason is null").drop("reason"))


def without_replays(trades: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """A trade that a reconnect sends again within the delay is dropped; state is bounded by the watermark."""
    timed = trades.withColumn("_ts", F.timestamp_millis("timestamp_ms")).withWatermark("_ts", delay)
    return timed.dropDuplicatesWithinWatermark(["trade_id"]).drop("_ts")


def stream_bars(trades: DataFrame, width_s: int = 1, by: list[str] | None = None, delay: str = "10 seconds") -> DataFrame:
    """Bars (all columns but the running sum) of a stream of typed trades, each once its watermark has passed. With a column
    `closing`, such rows move the watermark and are in no bar: the last bars come out behind them."""
    by = by or []
    timed = trades.withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", delay)
    real = ~F.col("closing") if "closing" in trades.columns else None
    grouped = timed.groupBy(*by, F.window("ts", f"{width_s} seconds").alias("w")).agg(*aggregates(real)).where("total_trades > 0")
    return finished(grouped.withColumn("timestamp_s", F.unix_seconds(F.col("w.start")))).drop("w", "_net")


def collect_cvd(stream: DataFrame, by: list[str], path: str, checkpoint: str, delay: str = "10 seconds"):
    """Running cvd and z-score of each series across the batches of a stream of bars (by, timestamp_s, net_delta, total_trades).
    Bars may come in any order within the delay: each waits in the state until the watermark has passed it, and bars are then
    taken in the order of time. Rows without total_trades are closing records. Of a series, four sums go from batch to batch:
    a batch's windows begin with the row of sums that the batch before has left in totals/batch=N, and its results are
    out/batch=N. A batch that runs again takes its own folders' place; totals of older batches are deleted."""
    spark, totals = stream.sparkSession, lambda n: f"{path}/totals/batch={n}"
    real = F.when(F.col("total_trades").isNotNull(), F.struct("net_delta", F.col("total_trades").cast("long").alias("trades")))
    timed = stream.withColumn("_ts", F.timestamp_seconds("timestamp_s")).withWatermark("_ts", delay)
    due = timed.groupBy(*by, "_ts").agg(F.max(real).alias("_bar")).where("_bar is not null")
    net, trades = F.col("_bar.net_delta"), F.col("_bar.trades")
    due = due.select(*by, F.unix_seconds("_ts").alias("timestamp_s"), net.alias("_cvd"), F.lit(1).cast("long").alias("_n"), trades.alias("_sum"), (trades * trades).alias("_squares"), trades.alias("_trades"))
    sums = ["_cvd", "_n", "_sum", "_squares"]
    o = Window.partitionBy(*by).orderBy("timestamp_s").rowsBetween(Window.unboundedPreceding, 0)  # a series' bars of one batch
    mean = F.col("_sum") / F.col("_n")
    var = F.col("_squares") / F.col("_n") - mean * mean
    score = (F.col("_trades") - mean) / F.when(var > TINY, F.sqrt(F.abs(var))).otherwise(F.lit(1.0))

    def add(batch: DataFrame, n: int) -> None:
        rows = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(totals(n - 1))) if n else batch
        summed = rows.withColumns({c: F.sum(c).over(o) for c in sums}).persist()
        try:
            shown = summed.where("_trades is not null").select(*by, "timestamp_s", rounded(F.col("_cvd"), 8).alias("cvd"), rounded(score, 6).alias("trade_intensity_zscore"))
            shown.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
            last = summed.groupBy(*by).agg(F.max_by(F.struct("timestamp_s", *sums), "timestamp_s").alias("_last"))
            last.select(*by, "_last.*", F.lit(None).cast("long").alias("_trades")).write.mode("overwrite").parquet(totals(n))
        finally:
            summed.unpersist()
        old = spark._jvm.org.apache.hadoop.fs.Path(totals(n - 2))
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return due.writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_sums(spark: SparkSession, path: str) -> DataFrame:
    """What collect_cvd() wrote: by, timestamp_s, cvd, trade_intensity_zscore."""
    return spark.read.parquet(f"{path}/out").drop("batch")
