"""Quality rules: word and line counts, then compression bands.

Compression bands: zstandard's ratio (bytes before / bytes after) of the whole document and, where it has `CHUNK` bytes or
more, of each chunk of `CHUNK` bytes, the last one being what is left. Text far above its length's band says the same thing again and
again, or is strewn with the same marks; text below it is random. A document is kept if its base rules pass, its whole ratio lies
in the band of its length, and at most `MOST_BAD` of its chunks lie outside the band of a text of a chunk's length (for the last
one, of its own).

The limits come from the corpus, all of it: texts that pass the base rules, each (length, ratio) once so that copies don't count
anew, fall in classes of half an octave of length. Quartiles of each class with `LEAST` of them give a middle and a spread; both are
smoothed by medians over two classes on either side, along the median of all slopes between classes, so a class or two that one
large family of near-copies fills don't move them. The limits are `ABOVE` spreads over the middle and `BELOW` under it,
`CHUNK_WIDE` for chunks; beyond the classes the line goes on. A corpus with fewer than `CLASSES` such classes has no
distribution to speak of: there the wide fixed bands `BANDS` hold.

A null text counts as the empty text, has no words and fails the base rules. Texts of any length are read whole; repeated
rows give repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeworks.llm.common import Ids, blocks, spread, table, texts, written

#: Fixed values for small corpora: bytes up to which a band holds, least ratio, most ratio.
BANDS = ((200, 0.0, 4.0), (1_000, 0.9, 4.0), (4_000, 1.15, 4.5), (16_000, 1.3, 5.0), (1 << 62, 1.4, 6.0))
CHUNK, MOST_BAD, LEVEL = 4096, 0.34, 3
#: Spreads from the middle to a band's limits; texts of a class, and classes, that limits are drawn from; least spread.
ABOVE, BELOW, CHUNK_WIDE, LEAST, CLASSES, LEAST_SPREAD = 3.0, 8.0, 4.0, 30, 4, 0.03
#: Classes of length: half octaves of bytes.
MOST_CLASS = 80
SYMBOLS = b"#*$%&|<>"
WORD_GAPS = b" \t\n\r\x0b\x0c"
WINDOW = 5
MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, size long, class int, zstd_ratio double, chunk_ratios array<double>, last_class int"


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of five words that are found twice or more. Windows are compared exactly: the numbers of their
    words are packed into one integer, or ranked pair by pair where they do not fit."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = Ids()
    w = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    bits = max(1, (len(ids) - 1).bit_length())
    if bits * WINDOW <= 63:
        key = w[:n].copy()
        for k in range(1, WINDOW):
            key = key << bits | w[k : k + n]
    else:
        key = w[:n]
        for k in range(1, WINDOW):
            key = np.unique(key, return_inverse=True)[1] << 32 | w[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(words) + 1, dtype=np.int64)
    at = order[np.r_[same, False] | np.r_[False, same]]
    np.add.at(twice, at, 1)
    np.add.at(twice, at + WINDOW, -1)
    return int((np.cumsum(twice) > 0).sum())


def base_rules(raw: bytes) -> tuple[int, int, int, int, int, bool]:
    words = raw.split()
    chars = len(raw) - sum(map(raw.count, (bytes([b]) for b in WORD_GAPS)))
    if not raw.isascii():
        a = np.frombuffer(raw, np.uint8)
        chars -= int(((a & 0xC0) == 0x80).sum())
    symbols = sum(map(raw.count, (bytes([b]) for b in SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeats = repeat_words(words)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats, failed


def length_class(size: int) -> int:
    return min(MOST_CLASS, math.floor(2 * math.log2(size))) if size else 0


def compression(raw: bytes, squeeze) -> tuple[float, list[float], int]:
    """Ratio of the whole text, those of its chunks (none of a shorter text), and the class of the last chunk's length."""
    if not raw:
        return 0.0, [], 0
    parts = [raw[k : k + CHUNK] for k in range(0, len(raw), CHUNK)] if len(raw) >= CHUNK else []
    return len(raw) / len(squeeze(raw)), [len(p) / len(squeeze(p)) for p in parts], length_class(len(parts[-1])) if parts else 0


def measure(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text), as MEASURED says."""

    def rate(batches):
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        names = [x.split()[0] for x in MEASURED.split(", ")]
        for batch in blocks(batches):
            rows = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast("binary").to_pylist()):
                ratio, chunks, last = compression(text, squeeze)
                rows.append((i, *base_rules(text), len(text), length_class(len(text)), ratio, chunks, last))
            kinds = {"chunk_ratios": pa.list_(pa.float64()), "class": pa.int32(), "last_class": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n)) for n, x in zip(names, zip(*rows))], names=names)

    return spread(texts(docs), "doc_id").mapInArrow(rate, MEASURED)


def fixed_limits() -> list[tuple[float, float, float, float]]:
    sizes = [2 ** (k / 2) for k in range(MOST_CLASS + 1)]
    return [(low, high, low, high) for low, high in (next((low, high) for upto, low, high in BANDS if x <= upto) for x in sizes)]


def limits(quartiles: dict[int, tuple[float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Of each class the least and the most ratio of a whole text, and of a chunk, from the quartiles of classes."""
    if len(quartiles) < CLASSES:
        return fixed_limits()
    at = np.array(sorted(quartiles))
    q = np.array([quartiles[k] for k in at.tolist()])
    middle, wide = q[:, 1], (q[:, 2] - q[:, 0]) / 1.349
    i, j = np.triu_indices(len(at), 1)
    slope = float(np.median((middle[j] - middle[i]) / (at[j] - at[i])))
    out = []
    for k in range(MOST_CLASS + 1):
        to = int(np.clip(k, at[0], at[-1]))
        near = np.abs(at - to) <= 2 if (np.abs(at - to) <= 2).any() else np.abs(at - to) == np.abs(at - to).min()
        m = float(np.median(middle[near] - slope * (at[near] - to))) + slope * (k - to)
        w = max(LEAST_SPREAD, float(np.median(wide[near])))
        out.append((m - BELOW * w, m + ABOVE * w, m - BELOW * w, m + CHUNK_WIDE * w))
    return out


def corpus_limits(measured: DataFrame) -> list[tuple[float, float, float, float]]:
    """limits() of all measured texts that pass the base rules; a row for each class comes to the driver."""
    once = measured.where("not base_failed").select("class", "size", "zstd_ratio").distinct()
    found = once.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("zstd_ratio", [0.25, 0.5, 0.75], 10_000).alias("q")).where(F.col("n") >= LEAST)
    return limits({r["class"]: tuple(r.q) for r in found.collect()})


def judge(docs: DataFrame, bands: list[tuple[float, float, float, float]] | None = None) -> DataFrame:
    """doc_id, the base counts and base_failed, zstd_ratio, n_chunks, n_bad_chunks, kept for each row of docs (doc_id, text). bands:
    limits() to hold texts to, if not those of docs themselves. Texts are compressed once; what is measured is written."""
    m = written(measure(docs))
    bands = bands or corpus_limits(m)
    low, high, chunk_low, chunk_high = (F.array(*[F.lit(float(b[k])) for b in bands]) for k in range(4))
    at = lambda a, k: F.element_at(a, F.col(k) + 1)
    full = length_class(CHUNK)
    outside = lambda r: (r < bands[full][2]) | (r > bands[full][3])
    n = F.size("chunk_ratios")
    last = F.element_at("chunk_ratios", -1)
    before = F.size(F.filter(F.slice("chunk_ratios", F.lit(1), n - 1), outside))
    bad = F.when(n > 0, before + ((last < at(chunk_low, "last_class")) | (last > at(chunk_high, "last_class"))).cast("int")).otherwise(0)
    good = (F.col("size") > 0) & F.col("zstd_ratio").between(at(low, "class"), at(high, "class")) & (F.col("n_bad_chunks") <= MOST_BAD * F.col("n_chunks"))
    m = m.withColumns({"n_chunks": n.cast("long"), "n_bad_chunks": bad.cast("long")})
    return m.withColumn("kept", ~F.col("base_failed") & good).drop("size", "class", "chunk_ratios", "last_class")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that all rules keep, with their columns. doc_id is unique."""
    good = judge(docs).where("kept").select("doc_id")
    return docs.join(good, "doc_id", "left_semi").select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
