"""Fees, slippage and cost-aware metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeworks.functions.numbers import rounded
from tapeworks.schema import FEE_RATE, SLIPPAGE_RATE


def fee(notional: Column, rate: float = FEE_RATE) -> Column:
    return rounded(notional * F.lit(rate), 4)


def slippage(price: Column, quantity: Column, rate: float = SLIPPAGE_RATE) -> Column:
    return rounded(price * quantity * F.lit(rate), 4)


def cost_metrics(returns: DataFrame, per_day: int = 100, notional: float = 10_000.0) -> DataFrame:
    """One row of metrics over a column `returns` of which zeros are left out; no row without a return."""
    one = returns.where("returns != 0").agg(F.sum("returns").alias("s"), F.count("returns").alias("n")).where("n > 0")
    mean = F.col("s") / F.col("n")
    cost = per_day * FEE_RATE
    gross = F.when(mean > -1, F.pow(1 + mean, F.lit(252.0)) - 1).otherwise(F.lit(-1.0))
    return one.select(
        rounded(mean, 10).alias("mean_return_per_period"),
        rounded(F.col("s"), 8).alias("total_return"),
        F.lit(round(cost, 6)).alias("daily_cost_pct"),
        F.lit(round(per_day * notional * FEE_RATE, 2)).alias("daily_cost_usd"),
        F.lit(round(cost * 252, 4)).alias("annual_cost_pct"),
        rounded(gross, 4).alias("gross_annual_return"),
        rounded(gross - cost * 252, 4).alias("net_annual_return"),
        F.when(mean > 0, rounded(mean / F.lit(FEE_RATE), 1)).alias("breakeven_trades_per_day"),
    )
