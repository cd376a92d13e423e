"""Corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, token ids.

Each stage reads all that the one before has kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeworks.llm import bpe, common, decontaminate, minhash, quality_rules, suffix_dedup
from tapeworks.llm.common import table, written

_before: list[str] = []


def staged(stage):
    """A stage is called when the one before it is written, so that one's scratch tables go then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _before
        common.discard(spark, _before)
        _before = common.watch()
        try:
            return stage(spark, docs, sf_dir)
        finally:
            common._watched = None

    return run_stage


@staged
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


@staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more), the document of least doc_id."""
    kept = minhash.near_duplicates(docs, shingle=5, percent=80).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


@staged
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 100 bytes that also start earlier; what is cut through of a character goes
    with them. n_chars follows the text; documents stay, even those left without a text."""
    cut = suffix_dedup.remove_repeats(docs).where("n_removed > 0").select("doc_id", F.col("text_crc").alias("_crc"), F.col("kept_text").alias("_text")).dropDuplicates(["doc_id", "_crc"])
    text = F.coalesce("_text", "text")
    changed = {"text": text} | ({"n_chars": F.when(F.col("_text").isNull(), F.col("n_chars")).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return docs.withColumn("_crc", F.crc32(F.coalesce("text", F.lit("")))).join(cut, ["doc_id", "_crc"], "left").withColumns(changed).select(*docs.columns)


@staged
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak of `benchmark`."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@staged
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each document."""
    return bpe.encode_documents(docs, with_ids=False)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", token_ids),
]
#: No SQL can express compression bands, MinHash, suffix arrays, latent retrieval or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next; what a stage has read goes when it is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            kept = common.watch()
            docs = written(docs)
            common._watched = None
            common.discard(spark, before)
            before = kept
    return docs
