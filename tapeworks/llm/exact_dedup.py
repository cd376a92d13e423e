"""Exact duplicates with a heavy-hitter split: Misra-Gries, verified winners by broadcast, shuffling for the rest.

1. Each text, its runs of white space turned into one space, becomes a SHA-256 digest. Digests are written once with a number for
   each row, so that no text is shuffled and rows stay told apart.
2. Each task sums its digests up in Misra-Gries counters, 8 for each shuffle partition; the tasks' counters are added up. With N
   rows and k counters a count is too low by N / (k + 1) at most, so every digest of more than `N / (4 * partitions)` rows is
   among those with half that count, of which there are at most k.
3. These candidates are broadcast (k rows of 40 bytes), their rows counted exactly, and those that do reach the bound have their
   winner, the row of least doc_id. Winners are broadcast: the rows of frequent digests are settled where they are read.
4. All others are shuffled by digest; no group of them has more than a quarter of a mean partition (or `LEAST` rows).

A null text counts as empty; all empty texts are equal. Of rows of one doc_id and one text, one stays. Rows without a doc_id come
last: such a row stays only where its group has no other. Texts of any length are read whole; an empty table gives an
empty table; other columns are ignored by `exact_duplicates` and kept by `without_duplicates`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tapeworks.llm.common import table, written

#: Fixed value: white space that counts as one space.
GAPS = r"[\x20\x09-\x0D]+"
#: Rows of a digest, at least, that make it frequent.
LEAST = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAPS, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def misra_gries(digests: DataFrame, counters: int) -> DataFrame:
    """digest, n: every value of more than rows / (counters + 1) rows among them, n too low by that at most. No task holds more
    than a few times `counters` values."""

    def summed(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def smaller(held: pa.Table) -> pa.Table:
            held = held.group_by("digest", use_threads=False).aggregate([("n", "sum")]).rename_columns(["digest", "n"])
            if held.num_rows <= counters:
                return held
            order = pc.array_sort_indices(held["n"], order="descending")
            least = held["n"][order[counters].as_py()]
            held = held.filter(pc.greater(held["n"], least))
            return held.set_column(1, "n", pc.subtract(held["n"], least))

        held = pa.table({"digest": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        for batch in batches:
            more = pa.table({"digest": batch.column("digest").cast(pa.binary()), "n": pa.array([1] * batch.num_rows, pa.int64())})
            held = pa.concat_tables([held, more])
            if held.num_rows > 4 * counters + 10_000:
                held = smaller(held)
        yield from smaller(held).combine_chunks().to_batches()

    return digests.select("digest").mapInArrow(summed, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))


def first_row() -> Column:
    """Least doc_id, rows without one last, then the row's number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")


def frequent(rows: DataFrame, partitions: int) -> tuple[DataFrame | None, int]:
    """(digest, first, size) of the frequent digests, and the bound that they pass; None if there are none. At most 4 rows for
    each shuffle partition."""
    n = rows.count()
    bound = max(LEAST, n // (4 * partitions))
    likely = misra_gries(rows, 8 * partitions).where(F.col("n") * 2 >= bound).select("digest")
    counted = rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.min(first_row()).alias("first"), F.count(F.lit(1)).alias("size"))
    hot = written(counted.where(F.col("size") >= bound))
    return (hot, bound) if hot.count() else (None, bound)


def settled(docs: DataFrame) -> DataFrame:
    """doc_id, row, digest, first (none, doc_id, row) and size of its group for each row of docs (doc_id, text)."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("digest")))
    hot, _ = frequent(rows, partitions)
    of = Window.partitionBy("digest")
    rest = rows if hot is None else rows.join(F.broadcast(hot), "digest", "left_anti")
    out = rest.withColumns({"first": F.min(first_row()).over(of), "size": F.count(F.lit(1)).over(of)})
    return out if hot is None else out.unionByName(rows.join(F.broadcast(hot), "digest").select(*out.columns))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs (doc_id, text)."""
    return settled(docs).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) that stay, with all their columns. Losers of frequent digests go where they are read."""
    key, again = "_key", "_again"
    while {key, again, f"{key}_id"} & set(docs.columns):
        key, again = key + "_", again + "_"
    s = written(settled(docs))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    twice = s.where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") != F.col("first.row"))).select("digest").distinct().withColumn(again, F.lit(True))
    winners = s.where(F.col("row") == F.col("first.row")).select(F.col("digest").alias(key), F.col("doc_id").alias(f"{key}_id"), "size")
    winners = winners.join(twice.withColumnRenamed("digest", key), key, "left").withColumn(again, F.coalesce(again, F.lit(False)))
    bound = max(LEAST, s.count() // (4 * partitions))
    hot = written(winners.where(F.col("size") >= bound).drop("size"))
    rows = docs.withColumn(key, digest(F.col("text")))
    left = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(winners.where(F.col("size") < bound).drop("size"), key)
    won = rows.join(F.broadcast(hot), key).unionByName(left).where(F.col("doc_id").eqNullSafe(F.col(f"{key}_id")))
    return won.where(~F.col(again)).unionByName(won.where(again).dropDuplicates([key])).select(*docs.columns)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)"""
