"""Ordered work over one long series without a single-task window.

A series is cut into buckets of its order key. Each bucket is summed by itself, the buckets' totals (few rows) get
running sums, and these are joined back as offsets. For windows of up to `halo` rows, rows are dealt to chunks of their dense
place, the last rows of each chunk to the next chunk too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bars in a bucket of running sums, and in a chunk of windows.
BUCKET, CHUNK, HALO = 100_000, 10_000, 301


def prefix(df: DataFrame, bucket: Column, order: list[str], by: list[str] | None = None, sums: dict[str, Column] | None = None, index: str | None = "idx", maxima: dict[str, Column] | None = None) -> DataFrame:
    """df with the dense 0-based place of each row, running sums and running maxima up to it, by series.

    bucket grows with the order; a bucket's rows are handled by one task, and so are the totals of one series, a row
    for each bucket. df is read twice, for totals and for rows: what is dear to compute is written before."""
    by, sums, maxima = by or [], sums or {}, maxima or {}
    key = [*by, "_bucket"]
    local = Window.partitionBy(*key).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    cols = {"_bucket": bucket} | {f"_s_{k}": c for k, c in sums.items()} | {f"_m_{k}": c for k, c in maxima.items()}
    df = df.withColumns(cols)
    totals = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums], *[F.max(f"_m_{k}").alias(f"_x_{k}") for k in maxima])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *key,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_t_{k}") for k in sums],
        *[F.max(f"_x_{k}").over(before).alias(f"_x_{k}") for k in maxima],
    )
    placed = df.withColumns(
        ({"_r": F.row_number().over(local) - 1} if index else {})
        | {f"_l_{k}": F.sum(f"_s_{k}").over(upto) for k in sums}
        | {f"_h_{k}": F.max(f"_m_{k}").over(upto) for k in maxima}
    )
    joined = placed.join(offsets, key)
    out = {k: F.col(f"_l_{k}") + F.col(f"_t_{k}") for k in sums} | {k: F.greatest(f"_h_{k}", f"_x_{k}") for k in maxima}
    if index:
        out[index] = (F.col("_r") + F.col("_n")).cast("long")
    keep = [c for c in df.columns if c not in cols and c not in out]
    return joined.select(*keep, *[c.alias(k) for k, c in out.items()])


def time_bucket(width_s: int, rows: int = BUCKET) -> Column:
    """Buckets of the time that `rows` bars take, so none holds more than `rows` bars."""
    return F.floor(F.col("timestamp_s") / F.lit(width_s * rows)).cast("long")


def chunked(df: DataFrame, chunk: int | None = CHUNK, halo: int = HALO) -> DataFrame:
    """df with a column `chunk`, and the last `halo` rows of each chunk once more in the next (`halo` true there). With
    chunk=None all rows are one chunk."""
    if chunk is None:
        return df.withColumns({"chunk": F.lit(0).cast("long"), "halo": F.lit(False)})
    if chunk <= halo:
        raise ValueError(f"chunks of {chunk} rows need more than their halo of {halo}")
    own = F.floor(F.col("idx") / F.lit(chunk)).cast("long")
    both = F.when(F.col("idx") % chunk >= chunk - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("chunk", F.explode(both)).withColumn("halo", F.col("chunk") != own)


def in_chunk(by: list[str] | None = None):
    return Window.partitionBy(*(by or []), "chunk").orderBy("idx")
