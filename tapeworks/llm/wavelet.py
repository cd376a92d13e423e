"""Token-ID output: a wavelet matrix for each shard, in one compressed file of shards.

Documents are dealt by ranges of doc_id and sorted; within a range, whole documents fill shards of about `SHARD` ids (a
longer document is a shard of its own). A shard is a row of a Parquet table, the file: which range it is of, where it
starts in it, doc ids, how many ids each has, and the ids as a wavelet matrix. The matrix has a plane of bits for each
bit of an id, from the top; each plane is the ids' bit in the order that the planes above have sorted them into, zeros
first. Ones before each 512-bit block are counted, in the file too, so rank is a look-up and a popcount; select is a binary
search over the counts. From a shard alone one reads any id, counts an id in a stretch, and finds its places; planes are
inflated when they are first asked for, so an id that a shard lacks costs the planes down to where its path ends.

`count_ids`, `locate_ids` and `access` look a list of ids or places up in all shards of a file.

The ranges' totals (a row for each range) give each range's place in the whole sequence; a shard's own start is written with it.

Null texts are empty: their only id is the end id. Texts are read whole; repeated rows come out repeated; rows of a null
doc_id come first; an empty table gives an empty table and no shard; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeworks.llm.common import Ids, blocks, scratch, table, texts

SHARD = 1 << 20
BLOCK = 512
END_ID = 2
MOST_WORDS = 1_200_000
SCHEMA = "part int, shard int, first long, doc_ids array<long>, lengths array<int>, n long, planes int, matrix binary"


class WaveletMatrix:
    """Bit planes of a sequence of ids, and the ones before each block of a plane. A plane and its counts are kept packed or
    not until they are asked for; `to_bytes` and `from_bytes` go from and to one string of bytes."""

    def __init__(self, n: int, zeros: list[int], bits: list, counts: list):
        self.n, self.zeros, self._bits, self._counts = n, zeros, bits, counts

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        depth = max(1, int(ids.max(initial=0)).bit_length())
        now, bits, zeros = ids.astype(np.uint32), [], []
        for d in range(depth - 1, -1, -1):
            bit = (now >> np.uint32(d) & np.uint32(1)).astype(bool)
            bits.append(cls._pack(bit))
            zeros.append(int(n - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        return cls(n, zeros, bits, [np.r_[0, np.cumsum(np.bitwise_count(b.reshape(-1, BLOCK // 64)).sum(1, dtype=np.int64))] for b in bits])

    @property
    def planes(self) -> int:
        return len(self._bits)

    @property
    def bits(self) -> list[np.ndarray]:
        return [self.plane(d) for d in range(self.planes)]

    @staticmethod
    def _get(held: list, d: int, kind: str) -> np.ndarray:
        if isinstance(held[d], (bytes, memoryview)):
            import zstandard

            held[d] = np.frombuffer(zstandard.ZstdDecompressor().decompress(held[d]), kind)
        return held[d]

    def plane(self, d: int) -> np.ndarray:
        return self._get(self._bits, d, "<u8")

    def counts(self, d: int) -> np.ndarray:
        return self._get(self._counts, d, "<u4").astype(np.int64, copy=False)

    @staticmethod
    def _pack(bit: np.ndarray) -> np.ndarray:
        packed = np.packbits(bit, bitorder="little")
        return np.r_[packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)].view("<u8")

    def to_bytes(self) -> bytes:
        """n, zeros and the sizes of what follows; then each plane and each plane's counts, packed one by one."""
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        parts = [squeeze(self.plane(d).tobytes()) for d in range(self.planes)] + [squeeze(self.counts(d).astype("<u4").tobytes()) for d in range(self.planes)]
        return np.array([self.n, *self.zeros, *map(len, parts)], "<i8").tobytes() + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes, planes: int) -> WaveletMatrix:
        n, *rest = np.frombuffer(data, "<i8", 3 * planes + 1).tolist()
        edges = np.cumsum([8 * (3 * planes + 1), *rest[planes:]]).tolist()
        view = memoryview(data)
        parts = [view[a:b] for a, b in zip(edges[:-1], edges[1:])]
        return cls(n, rest[:planes], parts[:planes], parts[planes:])

    def rank1(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        at = np.asarray(at, np.int64)
        b, bits = at // BLOCK, self.plane(plane)
        out = self.counts(plane)[b].copy()
        for k in range(BLOCK // 64):
            word = b * (BLOCK // 64) + k
            left = np.clip(at - word * 64, 0, 64)
            some = left > 0
            mask = np.where(left >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
            out[some] += np.bitwise_count(bits[word[some]] & mask[some])
        return out

    def access(self, at) -> np.ndarray:
        """The ids at these places."""
        at = np.asarray(at, np.int64).copy()
        out = np.zeros(len(at), np.uint32)
        for d, zeros in enumerate(self.zeros):
            bit = self.plane(d)[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)
            ones = self.rank1(d, at)
            at = np.where(bit, zeros + ones, at - ones)
            out = out << np.uint32(1) | bit.astype(np.uint32)
        return out

    def all(self) -> np.ndarray:
        """All ids: the planes undone from the bottom, each a stable merge of its zeros and ones."""
        now = np.zeros(self.n, np.uint32)
        for d in range(self.planes - 1, -1, -1):
            bit = np.unpackbits(self.plane(d).view(np.uint8), bitorder="little", count=self.n).astype(bool)
            ids = np.empty(self.n, np.uint32)
            ids[~bit] = now[: self.zeros[d]]
            ids[bit] = now[self.zeros[d] :] | np.uint32(1 << (self.planes - 1 - d))
            now = ids
        return now

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        if value < 0 or value >> self.planes:
            return 0, 0
        for d, zeros in enumerate(self.zeros):
            if low == high:
                break
            a, b = self.rank1(d, np.array([low, high])).tolist()
            low, high = (zeros + a, zeros + b) if value >> (self.planes - 1 - d) & 1 else (low - a, high - b)
        return low, high

    def count(self, value: int, low: int = 0, high: int | None = None) -> int:
        """How often an id occurs from place low up to, not including, place high."""
        a, b = self._range(value, low, self.n if high is None else high)
        return b - a

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence of an id, from 0."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for d in range(self.planes - 1, -1, -1):
            one = value >> (self.planes - 1 - d) & 1
            at = self._select(d, one, at - self.zeros[d] if one else at)
        return at

    def _select(self, plane: int, one: int, k: int) -> int:
        counts = self.counts(plane)
        if not one:
            counts = np.arange(len(counts)) * BLOCK - counts
        b = int(np.searchsorted(counts, k, side="right")) - 1
        bit = np.unpackbits(self.plane(plane)[b * (BLOCK // 64) : (b + 1) * (BLOCK // 64)].view(np.uint8), bitorder="little")
        return b * BLOCK + int(np.flatnonzero(bit == one)[k - counts[b]])

    def locate(self, value: int) -> list[int]:
        """All places of an id, ascending."""
        a, b = self._range(value, 0, self.n)
        at = np.arange(a, b)
        for d in range(self.planes - 1, -1, -1):
            one = value >> (self.planes - 1 - d) & 1
            at = self._selected(d, one, at - self.zeros[d] if one else at)
        return at.tolist()

    def _selected(self, plane: int, one: int, k: np.ndarray) -> np.ndarray:
        """The places of many ones (or zeros) of a plane: block by the counts, then word by word."""
        counts, bits = self.counts(plane), self.plane(plane)
        if not one:
            counts = np.arange(len(counts)) * BLOCK - counts
        b = np.searchsorted(counts, k, side="right") - 1
        left, at = k - counts[b], b * BLOCK
        words = bits.reshape(-1, BLOCK // 64)[b]
        words = words if one else ~words
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        w = (upto <= left[:, None]).sum(1)
        left = left - np.where(w > 0, upto[np.arange(len(k)), np.maximum(w - 1, 0)], 0)
        inside = np.unpackbits(words[np.arange(len(k)), w][:, None].view(np.uint8), axis=1, bitorder="little")
        return at + 64 * w + (np.cumsum(inside, axis=1) <= left[:, None]).sum(1)


class Encoder:
    """The BPE model of the tokenizers library, asked once for each word. Words are found as the file's normalizer and
    pre-tokenizer find them, in stretches between white space; numbers of stretches and words are kept between texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from tapeworks.llm.bpe import WordBPE, byte_symbols

        tokenizer = Tokenizer.from_file(path)
        self.model, self.finder, self.symbols = tokenizer.model, WordBPE(path), byte_symbols()
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self._new()

    def _new(self):
        from tapeworks.llm.bpe import Ragged

        self.ids, self.words = Ids(), Ids()
        self.rows, self.word_rows = (Ragged(np.zeros(0, np.uint32), np.zeros(0, np.int64)) for _ in range(2))

    def _word(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.model.tokenize("".join([self.symbols[b] for b in word.encode()]))]

    def __call__(self, many: list[str]) -> list[np.ndarray]:
        from itertools import islice

        if len(self.ids) > MOST_WORDS:
            self._new()
        known, known_words, get = len(self.ids), len(self.words), self.ids.__getitem__
        rows = []
        for t in many:
            w = self.finder.cut(t)
            rows.append(np.fromiter(map(get, w), np.int32, len(w)))
        pieces = [self.finder.pieces(c) for c in islice(self.ids, known, None)]
        if pieces:
            within = np.fromiter((self.words[w] for ws in pieces for w in ws), np.int64)
            got = [self._word(w) for w in islice(self.words, known_words, None)]
            self.word_rows.extend(np.fromiter((x for ids in got for x in ids), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))
            flat, bounds = self.word_rows.take(within)
            self.rows.extend(flat, np.diff(bounds[np.cumsum([0, *map(len, pieces)])]))
        flat, bounds = self.rows.take(np.concatenate(rows) if rows else np.zeros(0, np.int32))
        upto = bounds[np.cumsum([0, *map(len, rows)])]
        return [flat[a:b] for a, b in zip(upto[:-1], upto[1:])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, shard: int = SHARD, end_id: int = END_ID) -> None:
    """Write docs (doc_id, text) as shards of ids to path."""
    from tapeworks.llm.bpe import default_path

    tokenizer = tokenizer or default_path()

    def build(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        doc_ids, held, size, first, number = [], [], 0, 0, 0

        def full():
            nonlocal doc_ids, held, size, first, number
            m = WaveletMatrix.of(np.concatenate(held))
            row = {"part": part, "shard": number, "first": first, "doc_ids": doc_ids, "lengths": [len(x) for x in held], "n": m.n, "planes": m.planes, "matrix": m.to_bytes()}
            first, number, doc_ids, held, size = first + m.n, number + 1, [], [], 0
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))

        for batch in blocks(batches, 4_000_000):
            for i, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(end_id))
                if held and size + len(ids) > shard:
                    yield full()
                doc_ids.append(i)
                held.append(ids)
                size += len(ids)
        if held:
            yield full()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(build, SCHEMA).write.parquet(path)


def _shards(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, int]]:
    """The shards of a file, and each range's place in the whole sequence: a row for each range is collected."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    totals = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in totals)]).tolist()
    return shards, {p: b for (p, _), b in zip(totals, before)}


def count_ids(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """id, n of each of `ids`: how often it occurs in the file."""
    import pyarrow as pa

    ids = sorted(set(ids))

    def count(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                m = WaveletMatrix.from_bytes(batch.column("matrix")[k].as_py(), batch.column("planes")[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([m.count(x) for x in ids], pa.int64())], names=["id", "n"])

    wanted = spark.createDataFrame([(x,) for x in ids], "id long")
    found = spark.read.schema(SCHEMA).parquet(path).select("planes", "matrix").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return wanted.join(found, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def locate_ids(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """id, place in the whole sequence, doc_id and place in the document of every occurrence of `ids`."""
    import pyarrow as pa

    shards, starts = _shards(spark, path)

    def locate(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("part", "first", "doc_ids", "lengths", "planes", "matrix")}
                m, bounds = WaveletMatrix.from_bytes(row["matrix"], row["planes"]), np.cumsum([0, *row["lengths"]])
                for x in sorted(set(ids)):
                    at = np.array(m.locate(x), np.int64)
                    d = np.searchsorted(bounds, at, side="right") - 1
                    docs = pa.array(row["doc_ids"], pa.int64()).take(pa.array(d))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x)), pa.array(at + starts[row["part"]] + row["first"]), docs, pa.array(at - bounds[d])], names=["id", "place", "doc_id", "at"])

    return shards.mapInArrow(locate, "id long, place long, doc_id long, at long")


def access(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """place, id of each of `places` in the whole sequence; none for a place beyond it."""
    import pyarrow as pa

    shards, starts = _shards(spark, path)
    wanted = np.unique(np.array(places, np.int64))

    def look(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("part", "first", "n")}
                start = starts[row["part"]] + row["first"]
                at = wanted[np.searchsorted(wanted, start) : np.searchsorted(wanted, start + row["n"])]
                if len(at):
                    m = WaveletMatrix.from_bytes(batch.column("matrix")[k].as_py(), batch.column("planes")[k].as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m.access(at - start).astype(np.int64))], names=["place", "id"])

    return shards.select("part", "first", "n", "planes", "matrix").mapInArrow(look, "place long, id long")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """From the shards: doc_id, start, n_tokens and ids_crc32 of every document."""
    import pyarrow as pa

    shards, starts = _shards(spark, path)

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("part", "first", "doc_ids", "lengths", "planes", "matrix")}
                ids = WaveletMatrix.from_bytes(row["matrix"], row["planes"]).all().astype("<u4")
                bounds = np.cumsum([0, *row["lengths"]])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(bounds[:-1] + starts[row["part"]] + row["first"]), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path)
