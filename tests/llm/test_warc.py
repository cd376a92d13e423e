"""Archives: one page_id with several payloads, records over several splits, chunks lost or changed."""

import base64
import hashlib
import random

import pytest

from tapeworks.llm import warc
from tapeworks.llm.common import scratch

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    """As the operator's docstring has it, from all rows at once."""
    best = {}
    for page, _, html in rows:
        if page is not None:
            best[html or ""] = max(best.get(html or "", page), page)
    out = []
    for page, url, html in rows:
        raw = (html or "").encode()
        refers = best[html or ""] if page is not None and best[html or ""] != page else None
        out.append((page, url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def read(spark, path):
    return sorted((tuple(r) for r in warc.read_archive(spark, path).collect()), key=str)


def test_one_page_id_with_several_payloads(spark):
    rows = [(4, None, "aaa"), (4, None, "bbbb"), (8, None, "aaa"), (9, None, "bbbb"), (9, None, "c\r\n\r\n"), (None, None, "aaa"), (None, "u", None), (3, "u", "")]
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), path := scratch(spark))
    assert read(spark, path) == brute(rows)


def test_records_over_several_splits(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdé") for _ in range(rng.randrange(0, 9000)))) for i in range(40)] + [(50, None, "\r\n\r\n" * 500)]
    path = scratch(spark)
    with_small_groups = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "20000")
    hadoop.set("parquet.page.size.row.check.min", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        warc.write_archive(with_small_groups, path, chunk=500)
        chunks = spark.read.parquet(path)
        assert chunks.rdd.getNumPartitions() > 4
        assert read(spark, path) == brute(rows)
    finally:
        for key in ("parquet.block.size", "parquet.page.size.row.check.min"):
            hadoop.unset(key)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("harm", ["chunk_no != 3", "chunk_no != 0", "chunk_no < 5"])
def test_lost_chunks_are_found(spark, harm):
    warc.write_archive(spark.createDataFrame([(1, None, "x" * 6000)], SCHEMA), path := scratch(spark), chunk=1000)
    harmed = scratch(spark)
    spark.read.parquet(path).where(harm).coalesce(1).write.parquet(harmed)
    with pytest.raises(Exception, match="missing or changed"):
        warc.read_archive(spark, harmed).collect()
