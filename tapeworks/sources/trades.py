"""Sources and sinks of trades, bars and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tapeworks.functions.durable import durable
from tapeworks.functions.numbers import number, utc_text
from tapeworks.operators.series import prefix
from tapeworks.schema import RAW_COLUMNS

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
REST = "array<struct<id:bigint,time:bigint,price:string,qty:string,isBuyerMaker:boolean>>"
MESSAGE = "struct<T:bigint,p:string,q:string,m:boolean,a:bigint,closing:boolean>"


def read_trades(spark: SparkSession, path: str, more: list[str] | None = None) -> DataFrame:
    """Raw trades of CSV files with a header: every cell as text."""
    schema = T.StructType([*RAW_SCHEMA.fields, *(T.StructField(c, T.StringType()) for c in more or [])])
    return spark.read.schema(schema).option("header", True).csv(path)


def in_file_order(read: DataFrame) -> DataFrame:
    """A DataFrame straight from files, with `seq`: the place of each row, dense from 0, in the order of the files' paths and of
    the rows in each file. A row is known by its file, the block that its task read, and its place in the block, which
    only the task that reads it can tell; so the rows are written with these, and blocks' row counts, a row for each block,
    run up to offsets. No row is shuffled to be put in order."""
    columns = read.columns
    tagged = durable(read.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")))
    blocks = tagged.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return tagged.join(offsets, ["_file", "_block"]).select(*columns, (F.col("_at") - F.col("_first") + F.col("_start")).alias("seq"))


def read_numeric(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """CSV files with a header; a column whose filled cells are all numbers becomes double, any other stays text. ordered: with
    `seq`, the rows' place in the files."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    names = raw.columns
    raw = in_file_order(raw) if ordered else raw
    plain = raw.agg(*[F.coalesce(F.bool_and(number(F.col(c)).isNotNull() | F.col(c).isNull()), F.lit(True)).alias(c) for c in names]).first()
    return raw.select(*[number(F.col(c)).alias(c) if plain[c] else F.col(c) for c in names], *(["seq"] if ordered else []))


def raw_row(ms: Column, price: Column, quantity: Column, maker: Column, trade_id: Column) -> list[Column]:
    """The 7 raw columns as text: a sell if the buyer is the maker."""
    return [
        ms.cast("string").alias("timestamp_ms"),
        utc_text(F.floor(ms / 1000), F.pmod(ms, F.lit(1000))).alias("timestamp_utc"),
        price.cast("string").alias("price"),
        quantity.cast("string").alias("quantity"),
        F.initcap(maker.cast("string")).alias("is_buyer_maker"),
        F.when(maker, "SELL").otherwise("BUY").alias("agggressor_side"),
        trade_id.cast("string").alias("trade_id"),
    ]


def parse_rest_trades(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Raw rows of REST pages, each a JSON array of trades."""
    t = payloads.select(F.explode(F.from_json(column, REST)).alias("t"))
    return t.select(*raw_row(*(F.col(f"t.{c}") for c in ("time", "price", "qty", "isBuyerMaker", "id"))))


def parse_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """messages with the raw columns, good (all fields are there) and closing (a closing record); batch and streaming alike."""
    m = messages.withColumn("_m", F.from_json(column, MESSAGE, {"mode": "PERMISSIVE"}))
    fields = [F.col(f"_m.{c}") for c in ("T", "p", "q", "m", "a")]
    closing = F.coalesce(F.col("_m.closing"), F.lit(False)) & fields[0].isNotNull()
    bad = fields[0].isNull()
    for f in fields[1:]:
        bad = bad | f.isNull()
    cells = raw_row(*fields)
    return m.select(*messages.columns, *cells, (~bad & ~closing).alias("good"), closing.alias("closing"))


def parse_agg_trades(messages: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(raw rows, messages that lack a field or aren't JSON) of stream messages; closing records are in neither."""
    m = parse_messages(messages, column)
    return m.where("good").select(*RAW_COLUMNS), m.where("not good and not closing").select(*messages.columns)


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, kind: str = "csv", by: list[str] | None = None, seconds: str | None = None) -> None:
    """Columns in the order given, with a header where the format has one; what is there is replaced. Folders by series, and by
    day (UTC) too where `seconds` names a column of epoch seconds. Rows are dealt out by folder, large folders over several
    tasks and small ones together, so that a folder has few files."""
    out, folders = df.select(*(columns or df.columns)), list(by or [])
    if seconds:
        out, folders = out.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(seconds) / 86_400).cast("int"))), [*folders, "day"]
    if folders:
        out = out.hint("rebalance", *folders)
    w = out.write.mode("overwrite").partitionBy(*folders)
    w.option("header", True).csv(path) if kind == "csv" else w.parquet(path)


def latest_input(spark: SparkSession, pattern: str, without: str = "merged") -> DataFrame:
    """path of the newest file that matches, names with `without` left out. File contents aren't read."""
    folder, _, glob = pattern.rpartition("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~F.contains(name, F.lit(without))).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).where("path is not null")


def write_bounds(bounds: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Bounds (a row for each series and feature) as JSON: one object {feature: {lower, upper}}; with series, a line for each of
    them, {"series": {key: value}, "bounds": {feature: {lower, upper}}}."""
    one = bounds.groupBy(*(by or [])).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lower", "upper")))).alias("bounds"))
    if by:
        one.select(F.to_json(F.struct(F.struct(*by).alias("series"), "bounds")).alias("value")).write.mode("overwrite").text(path)
    else:
        one.select(F.to_json("bounds").alias("value")).coalesce(1).write.mode("overwrite").text(path)


BOUNDS = "map<string,struct<lower:double,upper:double>>"


def read_bounds(spark: SparkSession, path: str, by: T.StructType | None = None) -> DataFrame:
    """What write_bounds() wrote; by: the series' columns with their types."""
    if by is None:
        m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", BOUNDS)).alias("feature", "b"))
        return m.select("feature", "b.lower", "b.upper")
    m = spark.read.text(path).select(F.from_json("value", f"struct<series:{by.simpleString()},bounds:{BOUNDS}>").alias("x"))
    return m.select("x.series.*", F.explode("x.bounds").alias("feature", "b")).select(*by.names, "feature", "b.lower", "b.upper")


def synth_trades(spark: SparkSession, n: int, seed: int = 0, start_ms: int = 1775351900000, base: float = 67000.0, bucket: int = 100_000) -> DataFrame:
    """A made-up tape of n trades, 300 ms apart: a Gaussian walk that never falls below base - 100, quantities of a scaled
    exponential, sides by a coin. Draws hang on (id, seed) alone, so the tape doesn't depend on partitioning. The
    clamped walk is the free walk plus what its lowest point so far lies under the floor."""

    def draw(k: int) -> Column:
        return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)

    gauss = F.sqrt(-2 * F.ln(draw(0))) * F.cos(F.lit(6.283185307179586) * draw(1)) * 0.5
    t = spark.range(n).withColumn("_g", gauss)
    walk = prefix(t, F.floor(F.col("id") / bucket), ["id"], sums={"_s": F.col("_g")}, index=None)
    low = prefix(walk, F.floor(F.col("id") / bucket), ["id"], maxima={"_under": F.lit(-100.0) - F.col("_s")}, index=None)
    price = F.round(F.lit(base) + F.col("_s") + F.greatest(F.lit(0.0), F.col("_under")), 2)
    quantity = F.greatest(F.round(-F.ln(draw(2)) / 0.5 * 0.01, 6), F.lit(0.001))
    return low.select(*raw_row(F.lit(start_ms) + F.col("id") * 300, price, quantity, draw(3) < 0.5, F.lit(1_000_000) + F.col("id")))
