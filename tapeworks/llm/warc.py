"""WARC archives as a chunked record table.

An archive is a Parquet table of rows (record_id, page_id, copy, chunk_no, data, digest): the `data` of a record's chunks,
one after another, are zstandard frames of a WARC/1.1 record; chunk 0 is its header, the last holds the two empty lines. Spark cuts
a payload into chunks of `CHUNK` bytes before it reaches the writer, and the reader takes a chunk at a time, so beyond the
page's own cell no step holds a record as a whole. `digest` is carried from chunk to chunk: SHA-1 of the digest before
and the chunk's own SHA-1, so a lost, changed or swapped chunk is found when it is read.

Of records with equal payloads, that with the largest page_id is the response; the others are `revisit` records that
name it, carry the payload's digest and length in their header, and have no payload. A smaller payload than `least` is
never revisited. Equal payloads are found by SHA-1 and length, as partial maxima; only digests of several pages are
joined back, to ids and digests without payloads.

The archive is read once, as its files are split. A record that a split cuts comes as parts, each checked within itself;
parts, some numbers and a header each, are gathered by record and checked to follow one another.

A null html is an empty payload. Each row is a record, whether page_ids are repeated or not; rows of one page_id and equal
payloads have equal records; a row without page_id has one whose record_id is empty and which neither refers nor is
referred to. An empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeworks.llm.common import scratch, table, written

CHUNK = 1 << 16
SCHEMA = "record_id string, page_id long, copy long, chunk_no int, data binary, digest binary"
ENDS = b"\r\n\r\n"
#: Base 32's alphabet.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chained(before: bytes, data: bytes) -> bytes:
    return hashlib.sha1(before + hashlib.sha1(data).digest()).digest()


def header(kind: str, page_id, url: str, size: int, payload_digest: str, refers_to, payload_bytes: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {' '.join(url.split())}"] * bool(url)
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {payload_bytes}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {size}", "", ""]
    return "\r\n".join(lines).encode()


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, sha (hexadecimal SHA-1), size, refers_to (null: a response)."""
    sums = [F.sha1(F.encode("html", "UTF-8")).alias("sha"), F.octet_length("html").cast("long").alias("size")]
    full = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    narrow = full.select("page_id", *sums).where(F.col("page_id").isNotNull() & (F.col("size") >= least))
    keeper = narrow.groupBy("sha", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("other")).where("refers_to != other").drop("other")
    moved = narrow.join(keeper, ["sha", "size"]).where("page_id != refers_to").distinct()
    return full.select("*", *sums).join(moved, ["page_id", "sha", "size"], "left")


def write_archive(pages: DataFrame, path: str, least: int = 0, chunk: int = CHUNK) -> None:
    """Write pages (page_id, url, html) as an archive to path."""
    body = F.when(F.col("refers_to").isNull(), F.encode("html", "UTF-8")).otherwise(F.lit(b""))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length(body) / chunk).cast("int") - 1)), lambda i: F.substring(body, i * chunk + 1, F.lit(chunk)))
    cut = records(pages, least).withColumn("copy", F.monotonically_increasing_id())
    cut = cut.select("page_id", "url", "copy", "sha", "size", "refers_to", F.posexplode(pieces).alias("n", "part"))

    def write(batches):
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=6).compress
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        hold, size, carried, last = [], 0, b"", None

        def add(data):
            nonlocal carried, size
            carried = chained(carried, data)
            page, copy, n = last
            hold.append((f"page:{'' if page is None else page}", page, copy, n, squeeze(data), carried))
            size += len(data)

        def rows():
            nonlocal hold, size
            cols, hold, size = list(zip(*hold)), [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["record_id", "page_id", "copy", "chunk_no", "data", "digest"])

        for batch in batches:
            for k, (page, url, copy, sha, length, refers, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "copy", "sha", "size", "refers_to", "n")))):
                if n == 0:
                    if last:
                        last = (*last[:2], last[2] + 1)
                        add(ENDS)
                    last, carried = (page, copy, 0), b""
                    digest = b32(bytes.fromhex(sha))
                    add(header("response" if refers is None else "revisit", page, url or "", length if refers is None else 0, digest, refers, length))
                if data := batch.column("part")[k].as_py():
                    last = (page, copy, n + 1)
                    add(data)
                if size > 4_000_000:
                    yield rows()
        if last:
            last = (*last[:2], last[2] + 1)
            add(ENDS)
        if hold:
            yield rows()

    cut.mapInArrow(write, SCHEMA).write.option("compression", "none").parquet(path)


FIELDS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: A part of a record, if `copy` is set: its first and last chunk, the first one's own SHA-1, the digests carried with both,
#: bytes in chunks other than the header, whether it ends as a record does, and the header if it has it.
PART_FIELDS = ["copy", "first_no", "last_no", "own", "first_digest", "last_digest", "size", "ends", "head"]
PART = "copy long, first_no int, last_no int, own binary, first_digest binary, last_digest binary, size long, ends boolean, head binary"


def _parsed(head: bytes) -> tuple:
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if x)
    number = lambda x: int(m) if (m := x.rpartition(":")[2].rstrip(">")) else None
    kind = fields["WARC-Type"]
    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, refers


class Follower:
    """The chunks of one record (or of the part of it in a split), one after another."""

    def __init__(self, copy: int, n: int, data: bytes, digest: bytes):
        self.copy, self.first, self.last, self.head, self.size, self.sha = copy, n, n, None, 0, hashlib.sha1()
        self.own, self.first_digest, self.carried, self.before = hashlib.sha1(data).digest(), digest, digest, b""
        if n == 0:
            self.head = data
            self._check(chained(b"", data) == digest)
        else:
            self.before, self.size = data, len(data)

    def _check(self, right: bool) -> None:
        if not right:
            raise ValueError(f"a chunk of record {self.copy} behind chunk {self.last} is missing or changed")

    def add(self, n: int, data: bytes, digest: bytes) -> None:
        self._check(n == self.last + 1 and chained(self.carried, data) == digest)
        self.sha.update(self.before)
        self.last, self.carried, self.before, self.size = n, digest, data, self.size + len(data)

    def row(self) -> tuple:
        """FIELDS of a whole record, whose payload's digest is checked, and no part; or a part's."""
        ends = self.before == ENDS
        if self.head is not None and ends and self.size - len(ENDS) == _length(self.head):
            found = _parsed(self.head)
            self._check(found[4] == "revisit" or b32(self.sha.digest()) == found[3] and found[2] == self.size - len(ENDS))
            return found + (None,) * len(PART_FIELDS)
        return (None,) * len(FIELDS) + (self.copy, self.first, self.last, self.own, self.first_digest, self.carried, self.size, ends, self.head)


def follow(rows):
    """Rows of records and parts from chunk rows (copy, chunk_no, data, digest) as they come, one chunk in memory."""
    import zstandard

    expand, now = zstandard.ZstdDecompressor().decompress, None
    for copy, n, data, digest in rows:
        data = expand(data)
        if now is not None and copy == now.copy:
            now.add(n, data, digest)
        else:
            if now is not None:
                yield now.row()
            now = Follower(copy, n, data, digest)
    if now is not None:
        yield now.row()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record. The carried digests and a response's
    length are checked, and of a response that no split cuts the payload's digest."""
    import pyarrow as pa
    from itertools import batched

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.binary()]

    def read(batches):
        rows = ((copy, n, b.column("data")[k].as_buffer(), digest) for b in batches for k, (copy, n, digest) in enumerate(zip(*(b.column(c).to_pylist() for c in ("copy", "chunk_no", "digest")))))
        for part in batched(follow(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part), types)], names=FIELDS + PART_FIELDS)

    def combine(key, group):
        parts = sorted(group.to_pylist(), key=lambda r: r["first_no"])
        right = parts[0]["head"] is not None and parts[-1]["ends"] and sum(r["size"] for r in parts) - len(ENDS) == _length(parts[0]["head"])
        for r, s in zip(parts, parts[1:]):
            right = right and s["first_no"] == r["last_no"] + 1 and hashlib.sha1(r["last_digest"] + s["own"]).digest() == s["first_digest"]
        if not right:
            raise ValueError(f"a chunk of record {key[0].as_py()} is missing or changed")
        return pa.table([pa.array([v], t) for v, t in zip(_parsed(parts[0]["head"]), types)], names=FIELDS)

    chunks = spark.read.schema(SCHEMA).parquet(path).select("copy", "chunk_no", "data", "digest")
    found = written(chunks.mapInArrow(read, f"{READ}, {PART}"))
    cut = found.where("copy is not null").select(*PART_FIELDS).groupBy("copy").applyInArrow(combine, READ)
    return found.where("copy is null").select(*FIELDS).unionByName(cut)


def _length(head: bytes) -> int:
    return int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n", 1)[0])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = " || ".join(f"substr('{ALPHABET}', CAST((('0x' || substr(sha, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * k}) & 31 AS BIGINT) + 1, 1)" for g in range(8) for k in range(4))
OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
q AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha, max(page_id) OVER (PARTITION BY sha) AS keeper FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM q
"""
