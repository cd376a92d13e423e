"""Integrity and statistics checks; each gives a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeworks.functions.durable import durable
from tapeworks.functions.numbers import rounded
from tapeworks.operators.profile import profile
from tapeworks.schema import NOT_FEATURES, TINY

NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")
BATCH = 60


def numeric_columns(df: DataFrame, by: list[str] | None = None) -> list[str]:
    """Feature columns: numeric, and none of the names that are never features, nor a key of the series."""
    return [c for c, t in df.dtypes if t in NUMERIC and c not in NOT_FEATURES and c != "idx" and c not in (by or [])]


def order_of_series(df: DataFrame, ts: str, seq: str, by: list[str] | None = None, bucket_rows: int = 1_000_000) -> DataFrame:
    """by, violations (ts less than in the row before of the series, in the order of seq), counted (at most 6), passed. Rows are
    compared within buckets of seq; each bucket's first row with the last one of the bucket before. Without series, one row."""
    by = by or []
    d = df.select(*by, F.col(ts).alias("_t"), F.col(seq).alias("_q")).withColumn("_b", F.floor(F.col("_q") / bucket_rows))
    o = Window.partitionBy(*by, "_b").orderBy("_q")
    inner = d.withColumn("_p", F.lag("_t").over(o)).groupBy(*by).agg(F.count_if(F.col("_t") < F.col("_p")).alias("n"))
    ends = d.groupBy(*by, "_b").agg(F.min_by("_t", "_q").alias("first"), F.max_by("_t", "_q").alias("last"))
    outer = ends.withColumn("_p", F.lag("last").over(Window.partitionBy(*by).orderBy("_b"))).groupBy(*by).agg(F.count_if(F.col("first") < F.col("_p")).alias("n"))  # a row for each bucket
    return judged_order(inner.unionByName(outer).groupBy(*by).agg(F.sum("n").alias("violations")), by)


def judged_order(violations: DataFrame, by: list[str]) -> DataFrame:
    return violations.select(*by, "violations", F.least("violations", F.lit(6)).cast("long").alias("counted"), (F.col("violations") == 0).alias("passed"))


def check_order(df: DataFrame, ts: str, seq: str, bucket_rows: int = 1_000_000, by: list[str] | None = None) -> DataFrame:
    """violations, counted, passed of all series together, in one row."""
    each = order_of_series(df, ts, seq, by, bucket_rows)
    return judged_order(each.agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("violations")), [])


def duplicates_of_series(df: DataFrame, ts: str | None = None, by: list[str] | None = None) -> DataFrame:
    """by, duplicates (distinct timestamps that occur more than once in the series), passed. Without series, one row."""
    ts, by = ts or ("timestamp_s" if "timestamp_s" in df.columns else "timestamp_ms"), by or []
    n = df.groupBy(*by, F.col(ts).alias("_t")).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.count_if(F.col("_n") > 1).alias("duplicates"))
    return n.withColumn("passed", F.col("duplicates") == 0)


def check_duplicates(df: DataFrame, ts: str | None = None, by: list[str] | None = None) -> DataFrame:
    """duplicates of all series together, and passed, in one row."""
    n = duplicates_of_series(df, ts, by).agg(F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"))
    return n.withColumn("passed", F.col("duplicates") == 0)


def absent(df: DataFrame, c: str) -> Column:
    x = F.col(c)
    return x.isNull() | F.isnan(x) if dict(df.dtypes)[c] in ("double", "float") else x.isNull()


def melted(df: DataFrame, per: dict[str, list[Column]], names: list[str]) -> DataFrame:
    """One aggregate pass for each batch of columns, then a row for each: column name and `names`."""
    out = None
    keys = list(per)
    for a in range(0, len(keys), BATCH):
        part = keys[a : a + BATCH]
        row = df.agg(*[F.struct(*[c.alias(n) for c, n in zip(per[k], names)]).alias(k) for k in part])
        rows = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("s")) for k in part])).alias("x")).select("x.feature", "x.s.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def check_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """feature, missing, pct of rows, for columns that miss something."""
    per = {c: [F.count_if(absent(df, c)), F.count(F.lit(1))] for c in columns or df.columns}
    m = melted(df, per, ["missing", "n"])
    return m.where("missing > 0").select("feature", "missing", rounded(F.col("missing") / F.col("n") * 100, 4).alias("pct"))


def check_constant(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """feature: those of two values or more, all (but for rounding) equal."""
    per = {}
    for c in columns or numeric_columns(df):
        x = F.when(~absent(df, c), F.col(c).cast("double"))
        per[c] = [F.count(x), F.max(x) - F.min(x)]
    return melted(df, per, ["n", "spread"]).where((F.col("n") >= 2) & (F.col("spread") < TINY)).select("feature")


def moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """feature, mean, std (population), skewness, excess kurtosis. All 0 under four values; of a constant only the mean."""
    per = {}
    for c in columns or numeric_columns(df):
        x = F.when(~absent(df, c), F.col(c).cast("double"))
        per[c] = [F.count(x), F.avg(x), F.stddev_pop(x), F.skewness(x), F.kurtosis(x)]
    m = melted(df, per, ["n", "mean", "std", "skewness", "kurtosis"])
    few, flat = F.col("n") < 4, F.col("std") < TINY
    zero = F.lit(0.0)
    return m.select(
        "feature",
        F.when(few, zero).otherwise(F.col("mean")).alias("mean"),
        *[F.when(few | flat, zero).otherwise(F.col(c)).alias(c) for c in ("std", "skewness", "kurtosis")],
    )


STABLE = 2.0


def moments_of(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, feature, mean, std, skewness, kurtosis of a profile()."""
    return found.where("b is null").select(*(by or []), F.col("a").alias("feature"), "mean", "std", "skewness", "kurtosis")


def missing_of(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    pct = rounded(F.col("missing") / (F.col("n") + F.col("missing")) * 100, 4)
    return found.where("b is null and missing > 0").select(*(by or []), F.col("a").alias("feature"), "missing", pct.alias("pct"))


def is_constant() -> Column:
    return F.col("b").isNull() & (F.col("n") >= 2) & (F.col("high") - F.col("low") < TINY)


def constant_of(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    return found.where(is_constant()).select(*(by or []), F.col("a").alias("feature"))


def drift_of(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, feature, drift_ratio, stable: the spread of the means of runs of rows over the standard deviation."""
    return found.where("b is null and drift_ratio is not null").select(*(by or []), F.col("a").alias("feature"), "drift_ratio", (F.col("drift_ratio") < STABLE).alias("stable"))


def pairs_of(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, a, b, r (4 digits) of the pairs of columns that correlate."""
    return found.where("b is not null").select(*(by or []), "a", "b", rounded(F.col("r"), 4).alias("r"))


def drift(df: DataFrame, columns: list[str] | None = None, chunks: int = 5, by: list[str] | None = None) -> DataFrame:
    """drift_of() a table with places idx: `chunks` runs of rows of each series. The mean of a run under four values counts as
    0; no row if a run had less than two."""
    return drift_of(profile(df, columns or numeric_columns(df, by), by, chunks), by)


def correlated_pairs(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.9, by: list[str] | None = None) -> DataFrame:
    """a, b, r (4 digits) of pairs of columns, in their order, whose Pearson correlation passes the threshold; one pass."""
    return pairs_of(profile(df if "idx" in df.columns else df.withColumn("idx", F.lit(0)), columns or numeric_columns(df, by), by, threshold=threshold), by)


def ranked(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Correlated pairs with their rank by |r| within a series, the highest first (ties by name)."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(F.abs("r").desc(), "a", "b")))  # columns**2 / 2 rows at most


BASELINE = ["features_analyzed", "missing_issues", "constant_features", "unstable_features", "redundant_pairs"]


def summary_of(found: DataFrame, features: int, by: list[str] | None = None) -> DataFrame:
    """by and BASELINE of a profile(), a row for each series."""
    counts = (F.lit(features).cast("long"), F.count_if(F.col("b").isNull() & (F.col("missing") > 0)), F.count_if(is_constant()), F.count_if(F.col("b").isNull() & ~(F.col("drift_ratio") < STABLE)), F.count("b"))
    return found.groupBy(*(by or [])).agg(*[c.alias(k) for k, c in zip(BASELINE, counts)])


def baseline_summary(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    columns = columns or numeric_columns(df, by)
    return summary_of(profile(df, columns, by), len(columns), by)


def returns_sanity(df: DataFrame) -> DataFrame:
    """Over the returns that aren't zero: n, mean, min, max, passed."""
    r = F.col("returns")
    return df.where(r != 0).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.min(r).alias("min"), F.max(r).alias("max"), F.coalesce(F.abs(F.avg(r)) < 0.01, F.lit(False)).alias("passed"))


def validation_report(df: DataFrame, by: list[str] | None = None, seq: str = "idx", ts: str = "timestamp_s", found: DataFrame | None = None) -> DataFrame:
    """by, section, name, value (text) of all that a report holds, for each series; statistics don't fail it, order (of ts along
    seq) and duplicates do. Two scans of the table: its keys, written by themselves, and all columns for their profile()
    (`found`, if there is one)."""
    by = by or []
    columns = numeric_columns(df, [*by, seq])
    keys = durable(df.select(*by, F.col(ts).alias("_ts"), F.col(seq).alias("_seq")))
    rows = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    order, twice = durable(order_of_series(keys, "_ts", "_seq", by)), durable(duplicates_of_series(keys, "_ts", by))
    found = found if found is not None else profile(df, columns, by, seq=seq, sizes=rows)
    out = None

    def add(d: DataFrame, section: str, names: list[str]):
        nonlocal out
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names]))
        part = d.select(*by, pairs.alias("x")).select(*by, F.lit(section).alias("section"), "x.*")
        out = part if out is None else out.unionByName(part)

    width = len([c for c in df.columns if c not in (seq, "idx", *by)])
    add(rows.select(*by, F.col("_rows").alias("row_count"), F.lit(width).alias("columns")), "data", ["row_count", "columns"])
    add(order, "ordering", ["violations", "passed"])
    add(twice, "duplicates", ["duplicates", "passed"])
    add(summary_of(found, len(columns), by), "baseline", BASELINE)
    both = order.select(*by, "passed").unionByName(twice.select(*by, "passed")).groupBy(*by).agg(F.min("passed").alias("overall_passed"))
    add(both, "overall", ["overall_passed"])
    return out


def columns_report(df: DataFrame) -> DataFrame:
    """feature (every column of the table), type, missing, pct."""
    types = df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "place int, feature string, type string")
    per = {c: [F.count_if(absent(df, c)), F.count(F.lit(1))] for c in df.columns}
    pct = F.when(F.col("n") > 0, rounded(F.col("missing") / F.col("n") * 100, 4)).otherwise(F.lit(0.0))
    return types.join(melted(df, per, ["missing", "n"]), "feature").select("place", "feature", "type", "missing", pct.alias("pct"))


def table_text(df: DataFrame) -> str:
    """A small table (a row for each column, or pair of columns) as Markdown."""
    cell = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    rows = [" | ".join(map(cell, r)) for r in df.collect()]
    return "\n".join([f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns), *(f"| {r} |" for r in rows)]) if rows else "None."


#: What no check of values can show: how each group of features is built, from no later row than its own.
LEAKAGE = """Window features (sums, volatility, slopes, momentum, rate of change, efficiency) end one bar before their own.
Returns, distances and imbalance take their own bar and the one before it. Running sums end at their own bar.
Bounds of clipping come from the whole table: fit them on a training part before a model is tested on the rest."""


def markdown(report: DataFrame) -> str:
    """validation_report() as a Markdown table."""
    by = [c for c in report.columns if c not in ("section", "name", "value")]
    return table_text(report.orderBy(*by, "section", "name"))


def full_report(found: dict[str, DataFrame]) -> str:
    """All tables of a validation as one Markdown text."""
    order = {"report": ["section", "name"], "columns": ["place"], "pairs": ["rank"]}
    out = ["# Validation"]
    for name, df in found.items():
        keys = [c for c in order.get(name, ["feature"]) if c in df.columns]
        out += [f"## {name}", table_text(df.orderBy(*keys) if keys else df)]
    return "\n\n".join([*out, "## leakage", LEAKAGE]) + "\n"


def leakage(on_all: DataFrame, on_prefix: DataFrame, columns: list[str]) -> DataFrame:
    """feature, compared, different: features computed on a prefix of the bars against those computed on all bars."""
    b = on_prefix.select("idx", *[F.col(c).alias(f"_{c}") for c in columns])
    per = {c: [F.count(F.lit(1)), F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}")))] for c in columns}
    return melted(on_all.join(b, "idx"), per, ["compared", "different"])
