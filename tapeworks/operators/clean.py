"""Cleaning of raw trades: a chain of predicates of which the first that holds gives the row's reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from tapeworks.functions.numbers import blank, number, stripped
from tapeworks.schema import RAW_COLUMNS, REQUIRED

#: Counted reason of each detail reason.
COUNTED = {
    "missing_field": "missing_field", "invalid_timestamp": "missing_field", "invalid_quantity": "missing_field", "zero_qty": "zero_qty",
    "invalid_price": "missing_field", "zero_price": "zero_price", "invalid_side": "invalid_side",
}
REASONS = ["missing_field", "zero_qty", "zero_price", "invalid_side"]


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def side_of(c: Column) -> Column:
    return F.upper(stripped(c))


def detail() -> Column:
    """The detail reason of a raw row, null if it is kept. A timestamp that is no whole number counts as missing."""
    quantity, price = number(F.col("quantity")), number(F.col("price"))
    return (
        F.when(_any([blank(F.col(c)) for c in REQUIRED]), "missing_field")
        .when(quantity.isNull(), "invalid_quantity")
        .when(quantity <= 0, "zero_qty")
        .when(price.isNull(), "invalid_price")
        .when(price <= 0, "zero_price")
        .when(~side_of(F.col("agggressor_side")).isin("BUY", "SELL"), "invalid_side")
        .when(F.trim("timestamp_ms").try_cast("long").isNull(), "invalid_timestamp")
    )


def judged(raw: DataFrame) -> DataFrame:
    """raw with its detail reason as `reason`. No shuffle."""
    return raw.withColumn("reason", detail())


def clean_trades(raw: DataFrame, normalize_side: bool = False) -> DataFrame:
    """Rows without a reason, cells as they were; normalize_side writes the side trimmed and in upper case."""
    kept = judged(raw).where("reason is null").drop("reason")
    return kept.withColumn("agggressor_side", side_of(F.col("agggressor_side"))) if normalize_side else kept


def removed(raw: DataFrame) -> DataFrame:
    return judged(raw).where("reason is not null")


def counted(reason: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in COUNTED.items() for x in kv])[reason]


def _counts() -> list[Column]:
    kind = F.when(F.col("reason").isNotNull(), counted(F.col("reason")))
    return [
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(F.col("reason").isNull()).alias("output_rows"),
        F.count("reason").alias("removed"),
        *[F.count_if(F.coalesce(kind == r, F.lit(False))).alias(r) for r in REASONS],
    ]


def clean_report(raw: DataFrame) -> DataFrame:
    """input_rows, output_rows, removed and a column for each of the four counted reasons, in one row."""
    return judged(raw).agg(*_counts())


def clean_to(raw: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept rows, removed rows with their reason, the report) of one scan of raw: rows are written once, dealt by whether they
    stay, and the report is observed as they pass."""
    spark, seen = raw.sparkSession, Observation()
    j = judged(raw).observe(seen, *_counts())
    j.withColumn("_gone", F.col("reason").isNotNull()).write.mode("overwrite").partitionBy("_gone").parquet(path)
    back = spark.read.schema(T.StructType([*j.schema.fields, T.StructField("_gone", T.BooleanType())])).parquet(path)
    got = seen.get
    names = ["input_rows", "output_rows", "removed", *REASONS]
    report = spark.createDataFrame([tuple(got.get(k, 0) for k in names)], ", ".join(f"{k} long" for k in names))
    return back.where("not _gone").drop("_gone", "reason"), back.where("_gone").drop("_gone"), report


def typed(raw: DataFrame) -> DataFrame:
    """Clean rows with typed columns; `side` is the raw cell."""
    by = [c for c in raw.columns if c not in RAW_COLUMNS]
    return raw.select(
        *by,
        F.trim("timestamp_ms").try_cast("long").alias("timestamp_ms"),
        number(F.col("price")).alias("price"),
        number(F.col("quantity")).alias("quantity"),
        (F.lower(F.trim("is_buyer_maker")) == "true").alias("is_buyer_maker"),
        F.col("agggressor_side").alias("side"),
        F.trim("trade_id").try_cast("long").alias("trade_id"),
    )
