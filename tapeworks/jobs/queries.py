"""Registered queries over the given tables, and DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeworks.functions.durable import durable, scratch
from tapeworks.functions.numbers import rounded
from tapeworks.jobs import tape
from tapeworks.jobs.sql import SHOWN, SQL  # noqa: F401
from tapeworks.operators import checks, clean, cost, summary
from tapeworks.operators.features import features
from tapeworks.operators.profile import profile
from tapeworks.operators.winsor import clip, winsor_bounds
from tapeworks.schema import FEATURES, RETURN_WINDOWS, SLOPE_WINDOWS, VOL_WINDOWS
from tapeworks.sources import tables, trades as S
from tapeworks.streaming import live

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__.removeprefix("q_")] = f
    return f


def of(name, source, *columns):
    """Registers columns of a source table of the tape."""
    QUERIES[name] = lambda spark, sf_dir: shown(source(spark, sf_dir)).select(*columns)


def shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c) + F.lit(1.7 * 10.0 ** -(n + 3)), n) for c, n in SHOWN.items() if c in df.columns})


def typed(raw: DataFrame) -> DataFrame:
    return clean.typed(raw).select("timestamp_ms", "price", "quantity", "is_buyer_maker", "side", "trade_id")


def digits(df: DataFrame, n: int, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), n) for c in columns})


# Sources and sinks


@query
def read_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    S.write_table(tape.raw(spark, sf_dir), path := scratch(spark))
    return typed(S.read_trades(spark, path))


@query
def read_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    S.write_table(tape.bars(spark, sf_dir), path := scratch(spark))
    return S.read_numeric(spark, path).select("timestamp_s", "timestamp_utc", "price_close", "total_volume", "total_trades")


@query
def write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    S.write_table(tape.bars(spark, sf_dir), path := scratch(spark), ["timestamp_s", "price_open", "price_close"], "parquet")
    return spark.read.parquet(path)


@query
def write_table_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars in a folder for each day."""
    S.write_table(tape.bars(spark, sf_dir), path := scratch(spark), ["timestamp_s", "price_close"], "parquet", seconds="timestamp_s")
    return spark.read.parquet(path).select("timestamp_s", "price_close", F.regexp_extract(F.input_file_name(), "/day=([^/]*)/", 1).alias("day"))


@query
def parse_rest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(S.parse_rest_trades(tape.rest_pages(spark, sf_dir)))


@query
def parse_agg_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = S.parse_agg_trades(tape.messages(spark.read.parquet(f"{sf_dir}/events.parquet")))
    counted = bad.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(True).alias("dead"))
    return good.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(False).alias("dead")).unionByName(counted)


@query
def latest_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.latest_input(spark, f"{sf_dir}/events*.parquet").first().path
    name = path.rsplit("/", 1)[1]
    return spark.read.parquet(f"{sf_dir}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")


@query
def write_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    S.write_bounds(winsor_bounds(durable(tape.unclipped(spark, sf_dir))), path := scratch(spark))
    return S.read_bounds(spark, path)


# Cleaning


def _reason(name: str, *details: str, source=tape.raw):
    QUERIES[name] = lambda spark, sf_dir: clean.removed(source(spark, sf_dir)).where(F.col("reason").isin(*details)).select(F.col("trade_id").cast("long").alias("trade_id"), "reason")


_reason("clean_missing", "missing_field", "invalid_timestamp", source=tape.spoiled)
_reason("clean_quantity", "invalid_quantity", "zero_qty")
_reason("clean_price", "invalid_price", "zero_price", source=tape.spoiled)
_reason("clean_side", "invalid_side")
_reason("clean_removed", *clean.COUNTED)


@query
def clean_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(clean.clean_trades(tape.raw(spark, sf_dir)))


@query
def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_report(tape.spoiled(spark, sf_dir))


@query
def clean_on_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report that comes with the write of the kept rows, and what was written."""
    kept, gone, report = clean.clean_to(tape.spoiled(spark, sf_dir), scratch(spark))
    counts = kept.select(F.lit(1).alias("kept_rows"), F.lit(0).alias("removed_rows")).unionByName(gone.select(F.lit(0).alias("kept_rows"), F.lit(1).alias("removed_rows")))
    return report.join(counts.agg(F.sum("kept_rows").alias("kept_rows"), F.sum("removed_rows").alias("removed_rows")), F.col("output_rows") == F.col("kept_rows"), "left")


# Bars


@query
def bar_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeworks.operators.bars import bar_key as key

    return tape.trades(spark, sf_dir).select("trade_id", key(tape.WIDTH).alias("timestamp_s"))


of("bar_volume", tape.bars, "timestamp_s", "buy_vol", "sell_vol", "net_delta", "total_volume")
of("bar_counts", tape.bars, "timestamp_s", "buy_trades", "sell_trades", "total_trades")
of("bar_ohlc", tape.bars, "timestamp_s", "price_open", "price_high", "price_low", "price_close")
of("bar_vwap", tape.bars, "timestamp_s", "vwap")
of("bar_cvd", tape.bars, "timestamp_s", "cvd_cumulative", "idx")
of("bars", tape.bars, "*")
QUERIES["bars_by_series"] = lambda spark, sf_dir: tape.bars(spark, sf_dir, ["user_id"])

# Features

for _name, _columns in {
    "f_returns": ["returns", "abs_returns"],
    "f_cvd": ["cvd"],
    "f_return_w": [f"return_{w}s" for w in RETURN_WINDOWS],
    "f_volume_w": [f"volume_{w}s" for w in RETURN_WINDOWS],
    "f_intensity_w": [f"intensity_{w}s" for w in RETURN_WINDOWS],
    "f_cvd_delta_w": [f"cvd_delta_{w}s" for w in RETURN_WINDOWS],
    "f_realized_vol": [f"realized_vol_{w}s" for w in VOL_WINDOWS],
    "f_cvd_slope": [f"cvd_slope_{w}s" for w in SLOPE_WINDOWS],
    "f_divergence": ["cvd_price_divergence_30s"],
    "f_intensity_z": ["trade_intensity_zscore"],
    "f_delta_mom": ["net_delta_mom_10s", "net_delta_mom_30s"],
    "f_vroc": ["vroc_30s"],
    "f_efficiency": ["efficiency_ratio_30s"],
    "f_imbalance": ["vol_imbalance"],
    "f_vwap_dist": ["price_vwap_dist"],
}.items():
    of(_name, tape.unclipped, "timestamp_s", *_columns)
of("feature_matrix", tape.matrix, "*")

# Winsorizing


@query
def q_winsor_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winsor_bounds(durable(tape.unclipped(spark, sf_dir)))


of("winsorize", tape.matrix, "timestamp_s", *FEATURES)


@query
def bounds_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of each user's own tape, written as JSON and read again."""
    by = ["user_id"]
    f = durable(tape.unclipped(spark, sf_dir, by))
    S.write_bounds(winsor_bounds(f, by=by), path := scratch(spark), by)
    return S.read_bounds(spark, path, f.select(*by).schema)


QUERIES["winsor_by_series"] = lambda spark, sf_dir: shown(tape.matrix(spark, sf_dir, ["user_id"])).select("user_id", "timestamp_s", *FEATURES)


@query
def apply_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds saved from the tape clip it as new data."""
    f = durable(tape.unclipped(spark, sf_dir))
    S.write_bounds(winsor_bounds(f), path := scratch(spark))
    return clip(f, S.read_bounds(spark, path)).select("timestamp_s", "returns", "vroc_30s", "intensity_30s")


# Checks


@query
def check_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_order(tape.raw(spark, sf_dir).select(F.col("timestamp_ms").cast("long").alias("t"), F.col("trade_id").cast("long").alias("q")), "t", "q")


@query
def check_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the tape as it stands in three files, whose rows were shuffled before."""
    i = F.col("trade_id").cast("long")
    mixed = tape.raw(spark, sf_dir).withColumns({"file": i % 3, "key": i * 7919 % 10_007})
    mixed.repartition("file").sortWithinPartitions("file", "key", i).drop("key").write.partitionBy("file").option("header", True).csv(path := scratch(spark))
    placed = S.in_file_order(S.read_trades(spark, f"{path}/*/"))
    return checks.check_order(placed.select(F.col("timestamp_ms").cast("long").alias("t"), "seq"), "t", "seq")


@query
def validation_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on a feature file whose rows are out of order, in the file's own order."""
    step = F.floor(F.col("timestamp_s") / tape.WIDTH) % 7
    m = tape.matrix(spark, sf_dir).withColumn("file", step).drop("idx")
    m.repartition("file").sortWithinPartitions("file", "timestamp_s").write.partitionBy("file").option("header", True).csv(path := scratch(spark))
    return checks.validation_report(durable(S.read_numeric(spark, f"{path}/*/", ordered=True)), seq="seq")


@query
def check_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_duplicates(tape.trades(spark, sf_dir))


@query
def check_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_missing(tape.spoiled(spark, sf_dir))


@query
def check_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_constant(tape.matrix(spark, sf_dir).withColumn("fixed", F.lit(2.5)))


@query
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digits(checks.moments(tape.matrix(spark, sf_dir)), 4, "mean", "std", "skewness", "kurtosis")


@query
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digits(checks.drift(tape.matrix(spark, sf_dir)), 6, "drift_ratio")


@query
def correlated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.correlated_pairs(tape.matrix(spark, sf_dir))


@query
def redundant_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.ranked(checks.correlated_pairs(tape.matrix(spark, sf_dir)))


@query
def baseline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.baseline_summary(tape.matrix(spark, sf_dir))


@query
def returns_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digits(checks.returns_sanity(tape.matrix(spark, sf_dir)), 8, "mean", "min", "max")


@query
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.validation_report(tape.matrix(spark, sf_dir))


@query
def validation_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each user's tape."""
    return checks.validation_report(tape.matrix(spark, sf_dir, ["user_id"]), ["user_id"])


@query
def profile_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and drift of each column of each user's tape."""
    m = tape.matrix(spark, sf_dir, ["user_id"])
    found = profile(m, checks.numeric_columns(m, ["user_id"]), ["user_id"]).where("b is null")
    values = [rounded(F.col(c) + F.lit(1.7e-6), 3).alias(c) for c in ("low", "high", "mean", "std", "skewness", "kurtosis", "drift_ratio")]  # off ties
    return found.select("user_id", F.col("a").alias("feature"), "n", *values)


@query
def pairs_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated columns of each user's tape."""
    return digits(checks.correlated_pairs(tape.matrix(spark, sf_dir, ["user_id"]), by=["user_id"]), 3, "r")


@query
def columns_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.columns_report(tape.spoiled(spark, sf_dir)).select("feature", "missing", "pct")


@query
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the first half of the bars, by themselves and within the whole."""
    b = durable(tape.bars(spark, sf_dir))
    half = b.where(F.col("idx") < b.count() // 2)
    f = [features(x, tape.WIDTH, chunk=1000) for x in (b, half)]
    return checks.leakage(*f, FEATURES)


@query
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tape.unclipped(spark, sf_dir)
    return checks.melted(m, {c: [F.count(c)] for c in checks.numeric_columns(m)}, ["n"])


# Costs, summaries, charts


@query
def trade_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.trades(spark, sf_dir).select("trade_id", cost.fee(F.col("price") * F.col("quantity")).alias("fee"))


@query
def trade_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.trades(spark, sf_dir).select("trade_id", cost.slippage(F.col("price"), F.col("quantity")).alias("slippage"))


@query
def cost_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.cost_metrics(tape.matrix(spark, sf_dir))


@query
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.dataset_summary(tape.bars(spark, sf_dir))


@query
def tape_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.tape_span(tape.trades(spark, sf_dir))


@query
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.chart_series(tape.matrix(spark, sf_dir))


@query
def chart_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ten bars."""
    return summary.chart_series(tape.matrix(spark, sf_dir), 10).withColumn("returns", rounded(F.col("returns") + F.lit(1.7e-11), 8)).drop("vol_30", "vol_60")


@query
def feature_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.feature_preview(tape.matrix(spark, sf_dir))


@query
def has_cvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.has_cvd(tape.bars(spark, sf_dir))


# Streams


#: Rows of a flush in the registered queries, so that a run is some twenty flushes and batches at sf0.01; a live tape flushes at live.FLUSH_ROWS.
FLUSH = 500


def _collected(spark: SparkSession, sf_dir: str, rows: int | None = None) -> str:
    path = scratch(spark)
    live.collect_trades(tape.messages(tape.events_stream(spark, sf_dir, rows)), f"{path}/out", f"{path}/log").awaitTermination()
    return f"{path}/out"


@query
def stream_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(S.read_trades(spark, f"{_collected(spark, sf_dir)}/trades"))


@query
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each batch."""
    return live.heartbeats(spark, f"{_collected(spark, sf_dir)}/beats").select("batch", "rows")


@query
def stream_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flushes of at most FLUSH rows: of each its stored rows, the rows and dead letters that its heartbeat has, and its files."""
    path = _collected(spark, sf_dir, FLUSH)
    files = S.read_trades(spark, f"{path}/trades").select("batch", F.input_file_name().alias("file"))
    stored = files.groupBy("batch").agg(F.count(F.lit(1)).alias("stored"), F.count_distinct("file").alias("files"))
    return live.heartbeats(spark, f"{path}/beats").select("batch", "rows", "dead").join(stored.select(F.col("batch").cast("long").alias("batch"), "stored", "files"), "batch", "left")


@query
def packed_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's flushes taken into a table of days, whose files are then packed; each row's day, and the files of that day."""
    flushes, path = _collected(spark, sf_dir), scratch(spark)
    tables.take_flushes(spark, flushes, path)
    tables.pack(spark, path)
    rows = tables.read_table(spark, path)
    days = rows.select("day", F.col("trade_id").cast("long").alias("trade_id"))
    found = typed(rows).join(days, "trade_id").join(tables.files_of(spark, path).select("day", "files"), "day")
    return found.withColumn("day", F.col("day").cast("string"))


@query
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message sent twice, and the stream begun again on its log: every trade is there once."""
    path = scratch(spark)
    for _ in range(2):
        good, _bad = S.parse_agg_trades(tape.messages(tape.events_stream(spark, sf_dir)).select(F.explode(F.array("value", "value")).alias("value")))
        q = live.without_replays(clean.typed(good)).writeStream.format("parquet").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start(f"{path}/out")
        q.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("trade_id", "timestamp_ms", "price", "quantity", "side")


@query
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars of the stream: a closing record moves the watermark past the last ones."""
    path = scratch(spark)
    events = tape.events_stream(spark, sf_dir, close_ms=tape.WIDTH * 1000 + 10_000)
    q = live.stream_bars(live.clean_stream(tape.as_raw(events, closing=True)), tape.WIDTH).writeStream.format("parquet").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query
def stream_cvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of each user's bars, which come out of order: each up to six hours late, in ten batches, then a closing record."""
    path, late = scratch(spark), 6 * 3600
    b = durable(tape.bars(spark, sf_dir, ["user_id"]).select("user_id", "timestamp_s", "net_delta", "total_trades"))
    arrival = F.col("timestamp_s") + F.pmod(F.xxhash64("user_id", "timestamp_s"), F.lit(late))
    first, last = b.agg(F.min("timestamp_s"), F.max("timestamp_s")).first()
    slices = b.withColumn("slice", F.floor((arrival - F.lit(first or 0)) * 10 / F.lit((last or 0) - (first or 0) + late)).cast("int"))
    end = spark.range(1).select(F.lit((last or 0) + 3 * late).cast("long").alias("timestamp_s"), F.lit(10).alias("slice"))
    stream = tape.spool(slices.unionByName(end, allowMissingColumns=True), f"{path}/in")
    session = stream.sparkSession
    store, session_store = "spark.sql.streaming.stateStore.providerClass", session.conf.get("spark.sql.streaming.stateStore.providerClass")
    session.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = live.collect_cvd(stream, ["user_id"], f"{path}/sums", f"{path}/log", f"{late} seconds")
    finally:
        session.conf.set(store, session_store)
    q.awaitTermination()
    return live.running_sums(spark, f"{path}/sums")
