"""Trades to bars to features, and the checks of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeworks.functions.durable import clear, durable, scratch
from tapeworks.operators import bars as B, checks, clean, cost, summary
from tapeworks.operators.features import features
from tapeworks.operators.profile import profile
from tapeworks.operators.series import CHUNK
from tapeworks.operators.winsor import winsorize
from tapeworks.schema import BAR_COLUMNS, FEATURES
from tapeworks.sources import trades as S


def feature_matrix(trades: DataFrame, width_s: int = 1, by: list[str] | None = None, chunk: int | None = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(bounds, the clipped 44-column matrix with idx) of typed trades, each series clipped by its own bounds. Bars and features
    are written once each and read for running sums, bounds and clipping."""
    return winsorize(durable(features(durable(B.bars(trades, width_s, by)), width_s, by, chunk)), by=by)


def run_pipeline(spark: SparkSession, source: str, target: str, width_s: int = 1, by: list[str] | None = None) -> dict[str, DataFrame]:
    """Raw trade files, read once, to bars, features, bounds and removed rows under target."""
    kept, gone, report = clean.clean_to(S.read_trades(spark, source, by), scratch(spark))
    made = durable(B.bars(clean.typed(kept), width_s, by))
    bounds, matrix = winsorize(durable(features(made, width_s, by)), by=by)
    by = by or []
    S.write_table(made, f"{target}/bars", [*by, *BAR_COLUMNS], "parquet", by, "timestamp_s")
    S.write_table(matrix, f"{target}/features", [*by, *BAR_COLUMNS, *FEATURES, "idx"], "parquet", by, "timestamp_s")
    S.write_table(gone, f"{target}/removed", kind="parquet")
    S.write_bounds(bounds, f"{target}/bounds", by)
    return {"summary": summary.dataset_summary(made), "report": report}


def run_validation(matrix: DataFrame, by: list[str] | None = None, seq: str = "idx") -> dict[str, DataFrame]:
    """All checks of a feature matrix, by name, in the order of its rows' place `seq`; with series, each by itself. Statistics come
    from one pass."""
    m = durable(matrix)
    c = checks.numeric_columns(m, [*(by or []), seq])
    found = profile(m, c, by, seq=seq)
    return {
        "report": checks.validation_report(m, by, seq, found=found), "columns": checks.columns_report(m), "moments": checks.moments_of(found, by), "drift": checks.drift_of(found, by),
        "missing": checks.missing_of(found, by), "constant": checks.constant_of(found, by), "pairs": checks.ranked(checks.pairs_of(found, by), by),
        "returns": checks.returns_sanity(m), "costs": cost.cost_metrics(m),
    }


def validate(matrix: DataFrame, target: str, by: list[str] | None = None, seq: str = "idx") -> bool:
    """Run all checks, write each table and the report as text under target; whether the tape, or every series of it, passes."""
    spark, found = matrix.sparkSession, {}
    for name, df in run_validation(matrix, by, seq).items():
        df.write.mode("overwrite").parquet(f"{target}/validation/{name}")
        found[name] = spark.read.parquet(f"{target}/validation/{name}")
    text = checks.full_report(found)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/validation/report_md")
    print(text)
    verdicts = found["report"].where("section = 'overall'").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == "true").alias("good")).first()
    return verdicts.n > 0 and verdicts.n == verdicts.good


def main() -> None:
    import argparse

    p = argparse.ArgumentParser(description="Trades to bars, features and checks")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--width", type=int, default=1)
    p.add_argument("--by", nargs="*", default=[])
    a = p.parse_args()
    spark = SparkSession.builder.appName("tape-pipeline").getOrCreate()
    try:
        run_pipeline(spark, a.source, a.target, a.width, a.by)
        good = validate(spark.read.parquet(f"{a.target}/features").drop("day"), a.target, a.by)
    finally:
        clear(spark)
    raise SystemExit(0 if good else 1)


if __name__ == "__main__":
    main()
