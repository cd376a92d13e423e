"""Exact bounds by order statistics, of one series or of each of many, and clipping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeworks.functions.durable import durable
from tapeworks.schema import FEATURES, LOWER, UPPER

#: approx_percentile errs by 1 / ACCURACY of the rows at most.
ACCURACY = 10_000
#: Rows of a series up to which its values are put in order as they are; longer series go by brackets.
SHORT = 20_000
SIDES = ("lower", "upper")


def place(n: Column, side: str, share: float) -> Column:
    """The place, from 0, of a bound among n sorted values: whole part of n * share, within the values."""
    k = F.floor(n.cast("double") * F.lit(float(share))).cast("long")
    return F.greatest(F.lit(0).cast("long"), k) if side == "lower" else F.least(n - 1, k)


def with_series(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """df joined with a table of one row for each series; a null key is a key."""
    right = other.withColumnsRenamed({c: f"_by_{c}" for c in by})
    return df.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])).drop(*(f"_by_{c}" for c in by))


def long_bounds(wide: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """by, feature, lower, upper from a column (lower, upper) for each feature."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_b_{f}.lower").alias("lower"), F.col(f"_b_{f}.upper").alias("upper")) for f in features]))
    return wide.select(*by, each.alias("x")).select(*by, "x.*")


def short_bounds(df: DataFrame, features: list[str], shares: dict[str, float], by: list[str]) -> DataFrame:
    """Bounds of series of at most SHORT rows, in one pass: their values sorted in an array each."""
    held = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.sort_array(F.collect_list(F.col(f).cast("double"))).alias(f"_v_{f}") for f in features]).where("_n > 0")
    at = lambda f, side: F.get(f"_v_{f}", place(F.col("_n"), side, shares[side]).cast("int")).alias(side)
    return long_bounds(held.select(*by, *[F.struct(*[at(f, s) for s in SIDES]).alias(f"_b_{f}") for f in features]), by, features)


def bracketed_bounds(df: DataFrame, features: list[str], shares: dict[str, float], by: list[str]) -> DataFrame:
    """Bounds of series of more than SHORT rows. A mergeable sketch of each series and feature brackets a place; the values below
    the bracket and at its lower edge are counted as they pass, and only those inside, a few ten-thousandths, are put in
    order, counted by value. Exact at any size, and no task sorts a whole column. df is read three times."""
    margin = 2 / ACCURACY + 2 / SHORT
    edges = [p for s in SIDES for p in (max(0.0, shares[s] - margin), min(1.0, shares[s] + margin))]
    sketch = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(F.col(f).cast("double"), edges, ACCURACY).alias(f"_e_{f}") for f in features])
    sketch = durable(sketch.where("_n > 0"))
    if by:
        joined, edge, n = with_series(df.select(*by, *features), sketch, by), lambda f, k: F.col(f"_e_{f}")[k], F.col("_n")
    else:
        row = sketch.first()
        joined, edge, n = df.select(*features), lambda f, k: F.lit(row[f"_e_{f}"][k] if row[f"_e_{f}"] else None).cast("double"), F.lit(row._n)
    each = [(f, j, s) for f in features for j, s in enumerate(SIDES)]
    value = {f: F.col(f).cast("double") for f in features}
    below = joined.groupBy(*by).agg(*[x for f, j, s in each for x in (F.count_if(value[f] < edge(f, 2 * j)).alias(f"_u_{f}_{s}"), F.count_if(value[f] == edge(f, 2 * j)).alias(f"_l_{f}_{s}"))])
    inside = F.array(*[F.when((value[f] > edge(f, 2 * j)) & (value[f] < edge(f, 2 * j + 1)), F.struct(F.lit(f).alias("feature"), F.lit(s).alias("side"), value[f].alias("value"))) for f, j, s in each])
    counts = joined.select(*by, F.explode(F.array_compact(inside)).alias("x")).groupBy(*by, "x.feature", "x.side", "x.value").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*by, "feature", "side").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto))
    k = {s: place(n, s, shares[s]) for s in SIDES}
    part = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(s).alias("side"), (k[s] - F.col(f"_u_{f}_{s}")).alias("k"), F.col(f"_l_{f}_{s}").alias("least"), edge(f, 2 * j).alias("low"), edge(f, 2 * j + 1).alias("high")) for f, j, s in each]))
    wanted = (with_series(below, sketch, by) if by else below).select(*by, part.alias("x")).select(*by, "x.*")
    keys = [*by, "feature", "side"]
    same = reduce(lambda a, b: a & b, [F.col(f"w.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys] + [F.col("r.upto") + F.col("w.least") > F.col("w.k")])
    found = wanted.alias("w").join(ranked.alias("r"), same, "left").groupBy(*[F.col(f"w.{c}").alias(c) for c in keys], "w.k", "w.least", "w.low", "w.high").agg(F.min("r.value").alias("inner"))
    v = F.when(F.col("k") < F.col("least"), F.col("low")).otherwise(F.coalesce("inner", "high"))
    return found.groupBy(*by, "feature").agg(*[F.max(F.when(F.col("side") == s, v)).alias(s) for s in SIDES])


def winsor_bounds(df: DataFrame, features: list[str] | None = None, lower: float = LOWER, upper: float = UPPER, by: list[str] | None = None) -> DataFrame:
    """by, feature, lower, upper: the values at places max(0, int(n * lower)) and min(n - 1, int(n * upper)) of each feature's
    sorted values, from 0, within each series. An empty table has no bounds."""
    by, features = by or [], features or FEATURES
    shares = dict(zip(SIDES, (lower, upper)))
    df = df.select(*by, *features)
    if not by:
        return (bracketed_bounds if df.count() > SHORT else short_bounds)(df, features, shares, by)
    sizes = durable(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")))
    if not sizes.where(F.col("_rows") > SHORT).limit(1).count():
        return short_bounds(df, features, shares, by)
    sized = with_series(df, sizes, by)
    short, rest = (sized.where(c).drop("_rows") for c in (F.col("_rows") <= SHORT, F.col("_rows") > SHORT))
    return short_bounds(short, features, shares, by).unionByName(bracketed_bounds(rest, features, shares, by))


def clip(df: DataFrame, bounds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df with each feature that bounds (a row for each series and feature) names cut to them; types stay. Without series the
    bounds, a row for each feature, are read; with series they are joined, and one that has no bounds stays as it is."""
    if not by:
        held = {r.feature: (F.lit(r.lower), F.lit(r.upper)) for r in bounds.collect()}
        joined = df
    else:
        names = [r.feature for r in bounds.select("feature").distinct().collect()]  # a row for each feature
        one = bounds.groupBy(*by).agg(*[F.max(F.when(F.col("feature") == f, F.struct("lower", "upper"))).alias(f"_b_{f}") for f in names])
        right = one.withColumnsRenamed({c: f"_by_{c}" for c in by})
        joined = df.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]), "left")
        held = {f: (F.col(f"_b_{f}.lower"), F.col(f"_b_{f}.upper")) for f in names}
    out = {f: F.when(F.col(f) < lo, lo).when(F.col(f) > hi, hi).otherwise(F.col(f)).cast(df.schema[f].dataType) for f, (lo, hi) in held.items()}
    return joined.withColumns(out).select(*df.columns) if out else df


def winsorize(df: DataFrame, features: list[str] | None = None, lower: float = LOWER, upper: float = UPPER, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(bounds, df clipped to them), each series by its own bounds"""
    bounds = durable(winsor_bounds(df, features, lower, upper, by))
    return bounds, clip(df, bounds, by)
