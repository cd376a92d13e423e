"""Fixed-width bars of trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeworks.functions.durable import durable
from tapeworks.functions.numbers import rounded, utc_text
from tapeworks.operators.series import BUCKET, prefix, time_bucket
from tapeworks.schema import BAR_COLUMNS


def bar_key(width_s: int = 1) -> Column:
    """The bar's start in seconds: timestamps before 1970 go down, not towards zero."""
    return (F.floor(F.col("timestamp_ms") / F.lit(width_s * 1000)) * F.lit(width_s)).cast("long")


def aggregates(real: Column | None = None) -> list[Column]:
    """Of the typed trades (timestamp_ms, price, quantity, side, trade_id) of one bar. What isn't BUY is a sell. real: rows that
    are trades, if not all are."""
    if real is None:
        only = lambda c: c
        real = F.lit(True)
    else:
        only = lambda c: F.when(real, c)
    buy = F.coalesce(F.col("side") == "BUY", F.lit(False))
    q, p, when = only(F.col("quantity")), only(F.col("price")), only(F.struct("timestamp_ms", "trade_id"))
    return [
        F.sum(F.when(buy, q).otherwise(F.lit(0.0))).alias("_buy"),
        F.sum(F.when(buy, F.lit(0.0)).otherwise(q)).alias("_sell"),
        F.count_if(buy & real).alias("buy_trades"),
        F.count_if(~buy & real).alias("sell_trades"),
        F.count(only(F.lit(1))).alias("total_trades"),
        F.min_by("price", when).alias("price_open"),
        F.max(p).alias("price_high"),
        F.min(p).alias("price_low"),
        F.max_by("price", when).alias("price_close"),
        F.sum(p * q).alias("_pv"),
        F.sum(q).alias("_v"),
    ]


def finished(grouped: DataFrame) -> DataFrame:
    """Bars but for the running sum, from aggregates() by timestamp_s; `_net` is the unrounded net volume."""
    net = F.col("_buy") - F.col("_sell")
    return grouped.withColumns(
        {
            "timestamp_utc": utc_text(F.col("timestamp_s")),
            "buy_vol": rounded(F.col("_buy"), 6),
            "sell_vol": rounded(F.col("_sell"), 6),
            "net_delta": rounded(net, 6),
            "_net": net,
            "vwap": rounded(F.when(F.col("_v") > 0, F.col("_pv") / F.col("_v")).otherwise(F.col("price_open")), 2),
            "total_volume": rounded(F.col("_buy") + F.col("_sell"), 6),
        }
    ).drop("_buy", "_sell", "_pv", "_v")


def bars(trades: DataFrame, width_s: int = 1, by: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """One row for each bar that has a trade, and its place `idx` in its series. Shuffles: bars by (series, second) after a
    partial aggregate of the trades, then bars by time bucket. The trades are read once: bars are written before their
    running sum, which reads them twice."""
    by = by or []
    grouped = trades.groupBy(*by, bar_key(width_s).alias("timestamp_s")).agg(*aggregates())
    b = prefix(durable(finished(grouped)), time_bucket(width_s, bucket), ["timestamp_s"], by, {"_cvd": F.col("_net")})
    return b.withColumn("cvd_cumulative", rounded(F.col("_cvd"), 6)).select(*by, *BAR_COLUMNS, "idx")
