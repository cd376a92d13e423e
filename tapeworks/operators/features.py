"""Features of bars: windows over the bars before, all on one window specification so that each chunk is sorted once.

Sums over many bars are differences of running sums, so a row costs the same whatever the window's length. The running sums
are whole numbers in units of the last digit that the summed values have: exact, so no difference is off, and equal values have a
volatility of exactly zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeworks.functions.numbers import rounded
from tapeworks.operators.series import BUCKET, CHUNK, chunked, in_chunk, prefix
from tapeworks.schema import BAR_COLUMNS, FEATURES, MOMENTUM_WINDOWS, RETURN_WINDOWS, SLOPE_WINDOWS, TINY, VOL_WINDOWS

#: Counts of not-a-number, infinity and minus infinity, side by side in one number; a chunk has fewer rows.
FIELD = 1 << 20
#: Numbers of so many units and more count as infinite, as do infinities: sums of a chunk's rows stay within 38 digits.
MOST = 1e29


def warm(w: int, value: Column, otherwise: float | int = 0.0) -> Column:
    """value from the w-th bar of the series on, zero before."""
    return F.when(F.col("idx") >= w, value).otherwise(F.lit(otherwise))


def units(c: str, digits: int) -> Column:
    """A column of at most `digits` decimals as a whole number; nothing where it is not a number or infinite."""
    x = F.col(c) * F.lit(10.0**digits)
    return F.when(F.abs(x) < MOST, F.round(x)).cast("decimal(38,0)")  # not a number is more than any


def odd(c: str, digits: int) -> Column:
    x = F.col(c) * F.lit(10.0**digits)
    return F.when(F.isnan(x), 1).when(x >= MOST, FIELD).when(x <= -MOST, FIELD * FIELD).otherwise(0).cast("long")


class Running:
    """Running sums of a chunk's rows, as columns of it; sums over windows are their differences. What an expression needs of an
    earlier row is noted and becomes one column, however often it is used: expressions of windows are never repeated."""

    def __init__(self, df: DataFrame, by: list[str]):
        self.df, self.o, self.made, self.lags, self.sums = df, in_chunk(by), {}, {}, {}
        self.upto = self.o.rowsBetween(Window.unboundedPreceding, 0)
        self.kinds: dict[str, str] = {}

    def add(self, name: str, value: Column) -> None:
        self.made[f"_r_{name}"] = F.sum(value).over(self.upto)

    def add_exact(self, c: str, digits: int) -> None:
        self.add(c, F.coalesce(units(c, digits), F.lit(0).cast("decimal(38,0)")))
        self.add(f"{c}_odd", odd(c, digits))

    def done(self) -> None:
        self.df = self.df.withColumns(self.made)
        self.kinds = dict(self.df.dtypes)

    def back(self, k: int, c: str) -> Column:
        """Column c, k rows before."""
        self.lags[f"_g{k}_{c}"] = F.lag(c, k).over(self.o)
        return F.col(f"_g{k}_{c}")

    def sum(self, name: str, a: int, b: int = 1) -> Column:
        """Over the rows from a to b rows before."""
        key = f"_w{a}_{b}_{name}"
        if key not in self.sums:
            zero = F.lit(0).cast(self.kinds[f"_r_{name}"])
            self.sums[key] = self.back(b, f"_r_{name}") - F.coalesce(self.back(a + 1, f"_r_{name}"), zero)
        return F.col(key)

    def finite(self, c: str, value: Column, a: int, b: int = 1) -> Column:
        """value, unless a number of the window isn't finite: then what adding them up gives."""
        n = self.sum(f"{c}_odd", a, b)
        up, down = F.floor(n / FIELD) % FIELD, F.floor(n / (FIELD * FIELD))
        nan = (n % FIELD > 0) | (up > 0) & (down > 0)
        return F.when(n == 0, value).when(nan, F.lit(float("nan"))).when(up > 0, F.lit(float("inf"))).when(down > 0, F.lit(-float("inf")))

    def total(self, c: str, digits: int, a: int, b: int = 1) -> Column:
        """The sum of a column added by add_exact()."""
        return self.finite(c, self.sum(c, a, b).cast("double") / F.lit(10.0**digits), a, b)

    def with_columns(self, new: dict[str, Column]) -> DataFrame:
        """The rows with `new`, whose expressions may use what has been noted."""
        return self.df.withColumns(self.lags).withColumns(self.sums).withColumns(new)


def nothing(c: Column) -> Column:
    """c, or not a number where a window holds something that isn't finite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(float("nan"))).otherwise(c)


def features(bars: DataFrame, width_s: int = 1, by: list[str] | None = None, chunk: int | None = CHUNK) -> DataFrame:
    """bars (with idx) and the 29 features, not yet clipped. Later features read the rounded values of earlier ones. A volume or
    net volume of 1e23 or more, or a running sum of 1e21, counts as infinite in sums over windows."""
    by = by or []
    n = F.col("total_trades").cast("long")
    bucket = F.floor(F.col("idx") / F.lit(BUCKET)).cast("long")
    summed = prefix(bars, bucket, ["idx"], by, {"_cvd": F.col("net_delta"), "_n": n, "_nn": n * n}, index=None)
    df = chunked(summed.withColumn("cvd", rounded(F.col("_cvd"), 8)), chunk)
    o = in_chunk(by)

    close = F.col("price_close")
    df = df.withColumn("_before", F.lag("price_close", 1).over(o))
    returns = F.when((F.col("idx") > 0) & (F.col("_before") > 0) & (close > 0), F.ln(close / F.col("_before"))).otherwise(F.lit(0.0))
    df = df.withColumns({"returns": rounded(returns, 10), "abs_returns": rounded(F.abs(returns), 10), "_step": F.abs(close - F.col("_before"))})
    r = Running(df, by)
    for c, digits in (("returns", 10), ("total_volume", 6), ("net_delta", 6), ("cvd", 8)):
        r.add_exact(c, digits)
    square = units("returns", 10)
    r.add("squares", F.coalesce(square * square, F.lit(0)).cast("decimal(38,0)"))
    r.add("trades", n)
    place = F.col("idx") - F.col("chunk") * F.lit(chunk or 0)  # slopes don't hang on where counting begins: small numbers
    r.add("moment", F.coalesce(units("cvd", 8) * place, F.lit(0)).cast("decimal(38,0)"))
    r.add("places", place.cast("decimal(38,0)"))
    r.done()
    back, new = r.back, {}
    for w in RETURN_WINDOWS:
        new[f"return_{w}s"] = rounded(warm(w, r.total("returns", 10, w)), 10)
        new[f"volume_{w}s"] = rounded(warm(w, r.total("total_volume", 6, w)), 8)
        new[f"intensity_{w}s"] = warm(w, r.sum("trades", w), 0).cast("long")
        new[f"cvd_delta_{w}s"] = rounded(warm(w, F.col("cvd") - back(w, "cvd")), 8)
    for w in VOL_WINDOWS:
        s = r.sum("returns", w)
        spread = F.sqrt((F.lit(w) * r.sum("squares", w) - s * s).cast("double")) / F.lit(w * 1e10)
        new[f"realized_vol_{w}s"] = rounded(warm(w, nothing(r.finite("returns", spread, w))), 12)
    for w in SLOPE_WINDOWS:
        above = F.lit(w) * r.sum("moment", w) - r.sum("cvd", w) * r.sum("places", w)
        slope = above.cast("double") / F.lit(1e8) / F.lit(w * w * (w * w - 1) / 12)
        new[f"cvd_slope_{w}s"] = rounded(warm(w, nothing(r.finite("cvd", slope, w))), 10)
    ahead = F.nanvl(F.signum(F.col("cvd") - back(30, "cvd")), F.lit(0.0)) - F.nanvl(F.signum(close - back(30, "price_close")), F.lit(0.0))
    new["cvd_price_divergence_30s"] = warm(30, ahead).cast("int")
    count = (F.col("idx") + 1).cast("double")
    mean = F.col("_n") / count
    var = F.col("_nn") / count - mean * mean
    new["trade_intensity_zscore"] = rounded((F.col("total_trades") - mean) / F.when(var > TINY, F.sqrt(F.abs(var))).otherwise(F.lit(1.0)), 6)
    for w in MOMENTUM_WINDOWS:
        new[f"net_delta_mom_{w}s"] = rounded(warm(w, r.total("net_delta", 6, w)), 8)
    prior = r.total("total_volume", 6, 60, 31)
    new["vroc_30s"] = rounded(warm(60, F.when(prior > TINY, (r.total("total_volume", 6, 30) - prior) / F.when(prior > TINY, prior)).otherwise(F.lit(0.0))), 8)
    r.lags["_path"] = F.sum("_step").over(o.rowsBetween(-29, -1))
    path = F.col("_path")
    new["efficiency_ratio_30s"] = rounded(warm(30, F.when(path > TINY, F.abs(back(1, "price_close") - back(30, "price_close")) / F.when(path > TINY, path)).otherwise(F.lit(0.0))), 8)
    both = F.col("buy_vol") + F.col("sell_vol")
    new["vol_imbalance"] = rounded(F.when(both > TINY, (F.col("buy_vol") - F.col("sell_vol")) / F.when(both > TINY, both)).otherwise(F.lit(0.0)), 8)
    new["price_vwap_dist"] = rounded(F.when(F.col("vwap") > TINY, (close - F.col("vwap")) / F.when(F.col("vwap") > TINY, F.col("vwap"))).otherwise(F.lit(0.0)), 8)
    return r.with_columns(new).where(~F.col("halo")).select(*by, *BAR_COLUMNS, *FEATURES, "idx")
