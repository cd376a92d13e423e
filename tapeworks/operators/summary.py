"""Summaries and chart-ready tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeworks.functions.numbers import rounded


def dataset_summary(bars: DataFrame) -> DataFrame:
    return bars.agg(
        F.min("price_close").alias("price_min"), F.max("price_close").alias("price_max"), rounded(F.sum("total_volume"), 4).alias("total_volume"),
        rounded(F.avg("net_delta"), 6).alias("mean_net_delta"), F.count(F.lit(1)).alias("bars"), (F.count(F.lit(1)) / 60.0).alias("minutes"),
    )


def tape_span(trades: DataFrame) -> DataFrame:
    span = (F.col("last_ms") - F.col("first_ms")) / 1000.0
    return trades.agg(F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms")).select("*", span.alias("span_s"), (span / 60.0).alias("span_min"))


def chart_series(feats: DataFrame, every: int = 1) -> DataFrame:
    """x, price, buy, sell (negative), returns, vol_30, vol_60, cvd by bar. every > 1: a row for each run of that many bars, with
    its lowest and highest price as low and high, volumes and returns added up, and the rest as at its last bar; so no
    high or low of the tape is lost however few points are drawn. Runs are partial aggregates: no order, no window."""
    sell = F.lit(0.0) - F.col("sell_vol")
    if every == 1:
        return feats.select(
            F.col("idx").alias("x"), F.col("price_close").alias("price"), F.col("buy_vol").alias("buy"), sell.alias("sell"), "returns",
            F.col("realized_vol_30s").alias("vol_30"), F.col("realized_vol_60s").alias("vol_60"), F.col("cvd_cumulative").alias("cvd"),
        )
    run = F.floor(F.col("idx") / F.lit(every)).cast("long")
    last = {"price": "price_close", "vol_30": "realized_vol_30s", "vol_60": "realized_vol_60s", "cvd": "cvd_cumulative"}
    one = feats.groupBy(run.alias("run")).agg(
        F.max("idx").alias("x"), F.min("price_low").alias("low"), F.max("price_high").alias("high"), rounded(F.sum("buy_vol"), 6).alias("buy"), rounded(F.sum(sell), 6).alias("sell"),
        rounded(F.sum("returns"), 10).alias("returns"), *[F.max_by(c, "idx").alias(k) for k, c in last.items()],
    )
    return one.select("x", "price", "low", "high", "buy", "sell", "returns", "vol_30", "vol_60", "cvd")


def feature_preview(feats: DataFrame) -> DataFrame:
    z = F.col("trade_intensity_zscore")
    return feats.select(
        F.col("idx").alias("x"), F.col("price_close").alias("price"), "returns", "cvd", F.col("realized_vol_30s").alias("vol_30"), "vol_imbalance",
        (F.col("vol_imbalance") >= 0).alias("buy_heavy"), z.alias("zscore"), F.lit(2.0).alias("band_high"), F.lit(-2.0).alias("band_low"), (F.abs(z) > 2).alias("beyond"),
    )


def has_cvd(feats: DataFrame, column: str = "cvd_cumulative") -> DataFrame:
    return feats.agg(F.coalesce(F.bool_or(F.col(column) != 0), F.lit(False)).alias("has_cvd"))
