"""Suffix-array dedup by prefix-free parsing: which bytes lie in a string of `LENGTH` bytes that also starts earlier.

Triggers. A rolling hash of `GRAM` bytes runs over each text; the least hash of a window of LENGTH bytes (leftmost on a
tie) is its trigger. The windows of one trigger, next to one another, make a phrase: the text from the first window's
start to the last one's end. What a trigger is depends on the window's bytes alone, so equal windows have equal triggers
at equal places in them, wherever they stand.

Dictionary and parse. Equal phrases (96 bits of two polynomial hashes) are one entry of the dictionary; the parse
keeps where each stands. Every occurrence of an entry but the first in corpus order is a repeat as a whole. Only first
occurrences whose trigger's bytes start several entries can hold a repeat of a part: their bytes are fetched, and each
bucket of triggers sorts all windows of its entries as suffix arrays (prefix doubling to LENGTH bytes), each of whole
triggers and of about `ARRAY` bytes, since windows of two triggers are never equal. Windows of equal rank, taken in corpus
order, give the other repeats. A trigger of more than `HOT` entries is not sorted in one bucket: its windows are dealt out
by a 128-bit hash and compared by it.

As every window lies in one phrase, windows of different phrases meet in the dictionary's suffix arrays alone: the parse
only needs the corpus order of its entries' places, not a suffix array of its own.

Corpus order is doc_id, then place. Blocks of documents compare within themselves first, so a bucket gets one row of an
entry from each block at most. All decisions are taken on the input, never on what is left. Buckets and groups of documents
are as many as the input's bytes ask for, so what a task holds does not grow with the corpus.

Null texts are empty; texts under LENGTH bytes are never touched; a row without doc_id is kept as it is. Equal repeated rows are
one document: they give equal repeated results and don't count as copies of each other. Rows of one doc_id with
different texts are documents of their own, in the order of their texts' CRC. Texts of any length are read whole. An
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeworks.llm.common import blocks, mixed, spark_hash, table, texts, written

LENGTH, GRAM = 100, 20
SPAN = LENGTH - GRAM + 1
HOT = 2000
PIECE = 1 << 18
#: Bytes of phrases in one suffix array: what sorting it takes, some 80 times as much, doesn't hang on how many a bucket has.
ARRAY = 1 << 18
#: Bytes of text within which phrases are compared before they are dealt out.
TOGETHER = 1 << 23
#: Bytes of text for each bucket and for each group of documents.
SHARE = 1 << 23
PLACE_BITS = 24
_PLACE = np.uint64((1 << PLACE_BITS) - 1)
_rng = np.random.Generator(np.random.PCG64(7))
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = tuple(int(x) * 8 + 3 for x in _rng.integers(1 << 40, 1 << 60, 2))
UNIT = np.dtype([("c1", "<u8"), ("c2", "<u4"), ("gram", "<u4"), ("doc", "<i8"), ("crc", "<u4"), ("at", "<u4"), ("n", "u1")])
RUN = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("at", "<u4"), ("n", "<u4")])
ASK = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("at", "<u4"), ("n", "u1"), ("hot", "u1"), ("bucket", "<i4"), ("gram", "<u4")])
PRINT = np.dtype([("f1", "<u8"), ("f2", "<u8"), ("doc", "<i8"), ("crc", "<u4"), ("at", "<u4")])
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i < n."""
    size = max(PIECE + 2 * LENGTH, 1 << (n - 1).bit_length() if n > PIECE + 2 * LENGTH else 0)
    if (base, size) not in _powers:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[base, size] = tuple(both)
    return _powers[base, size]


class Hashes:
    """64-bit hashes of any stretch of a buffer."""

    def __init__(self, buf: np.ndarray, base: int):
        up, self.down = powers(base, len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(BYTE[buf] * up[: len(buf)], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])


def triggers(buf: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes, the hash of its trigger (upper bits) and its place in the buffer (lower bits)."""
    m = np.uint64(0x9E3779B97F4A7C15)

    def join(left, right, at, size):  # hash of two neighbouring stretches; `size` bytes in the right one
        n = len(right) - at
        return left[:n] * np.uint64(pow(int(m), size, 1 << 64)) + right[at : at + n]

    h1 = BYTE[buf]
    h2 = join(h1, h1, 1, 1)
    h4 = join(h2, h2, 2, 2)
    h8 = join(h4, h4, 4, 4)
    h16 = join(h8, h8, 8, 8)
    key = mixed(join(h16, h4, 16, 4))  # GRAM = 16 + 4
    key &= ~_PLACE
    key |= np.arange(len(key), dtype=np.uint64)
    pad = -len(key) % SPAN
    rows = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(buf) - LENGTH + 1
    return np.minimum(behind[:n], ahead[SPAN - 1 : SPAN - 1 + n])


def pieces(doc_ids, raws):
    """(doc ids, texts, CRCs of the whole texts, place of the texts in their documents) of at most about PIECE bytes; longer
    texts are cut with LENGTH - 1 bytes in common, so that each window lies in one piece."""
    hold, size = [], 0
    for i, raw in zip(doc_ids, raws):
        if i is None or len(raw) < LENGTH:
            continue
        crc = zlib.crc32(raw)
        if len(raw) > PIECE:
            for at in range(0, len(raw) - LENGTH + 1, PIECE):
                yield [i], [raw[at : at + PIECE + LENGTH - 1]], [crc], at
            continue
        if size + len(raw) > PIECE and hold:
            yield *map(list, zip(*hold)), 0
            hold, size = [], 0
        hold.append((i, raw, crc))
        size += len(raw)
    if hold:
        yield *map(list, zip(*hold)), 0


def parse(ids: list[int], raws: list[bytes], crcs: list[int], shift: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of one piece and the buckets of their triggers."""
    buf = np.frombuffer(b"".join(raws), np.uint8)
    length = np.array([len(r) for r in raws])
    end = np.cumsum(length)
    which = triggers(buf)
    doc = np.repeat(np.arange(len(raws)), length)[: len(which)]
    at = np.flatnonzero(np.arange(len(which)) + LENGTH <= end[doc])
    place = (which[at] & _PLACE).astype(np.int64)
    new = np.r_[True, (np.diff(place) != 0) | (np.diff(at) != 1)]
    first = at[new]
    last = np.r_[at[np.flatnonzero(new)[1:] - 1], at[-1]]
    gram = mixed(which[first] >> np.uint64(PLACE_BITS))
    d = doc[first]
    out = np.zeros(len(first), UNIT)
    h1, h2 = (Hashes(buf, b)(first, last + LENGTH) for b in BASES)
    out["c1"], out["c2"], out["gram"] = h1, (h2 >> np.uint64(32)).astype(np.uint32), (gram >> np.uint64(32)).astype(np.uint32)
    out["doc"], out["crc"], out["at"], out["n"] = np.array(ids, np.int64)[d], np.array(crcs, np.uint32)[d], first - (end - length)[d] + shift, last - first + 1
    return out, ((gram & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def repeats(keys: tuple[np.ndarray, ...], doc: np.ndarray, crc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by keys and corpus order, and which of them are not the first place of their key."""
    order = np.lexsort((at, crc, doc, *reversed(keys)))
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    begin = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0)) if len(order) else order
    head = order[begin]
    return order, (doc[order] != doc[head]) | (crc[order] != crc[head]) | (at[order] != at[head])


def runs(doc: np.ndarray, crc: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of window starts, joined where they touch."""
    order = np.lexsort((at, crc, doc))
    doc, crc, at, stop = doc[order], crc[order], at[order].astype(np.int64), (at[order].astype(np.int64) + n[order])
    out = np.zeros(0, RUN)
    if len(doc):
        new = np.r_[True, (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]) | (at[1:] > stop[:-1])]
        first = np.flatnonzero(new)
        out = np.zeros(len(first), RUN)
        out["doc"], out["crc"], out["at"], out["n"] = doc[first], crc[first], at[first], np.maximum.reduceat(stop, first) - at[first]
    return out


def dealt(kind: str, rows: np.ndarray, groups: int):
    """(kind, group of the document, bytes of its rows)"""
    if not len(rows):
        return
    g = group_of(rows["doc"], groups)
    order = np.argsort(g, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(g[order]) != 0])
    for a, b in zip(cut, np.r_[cut[1:], len(rows)]):
        yield kind, int(g[order[a]]), rows[order[a:b]].tobytes()


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    """As Spark deals them: pmod(xxhash64(doc_id), groups)."""
    return np.mod(spark_hash(doc), groups)


def joined(col, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for c in col.chunks for x in c), kind)


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """The rank of every place of a text by its next LENGTH bytes: equal bytes, equal rank. Prefix doubling."""
    padded = np.r_[text, np.zeros(LENGTH + 8, np.uint8)].astype(np.uint64)
    rank = np.zeros(len(text) + LENGTH, np.uint64)
    for k in range(8):
        rank = rank << np.uint64(8) | padded[k : k + len(rank)]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    done = 8
    while done < LENGTH:
        step = min(done, LENGTH - done)
        ahead = np.r_[rank[step:], np.zeros(step, np.uint64)]
        rank = np.unique(rank << np.uint64(32) | ahead, return_inverse=True)[1].astype(np.uint64)
        done += step
    return rank[: len(text)]


def together(rows: np.ndarray) -> list[slice]:
    """Rows of phrases, in order of their triggers, cut into whole triggers of about ARRAY bytes."""
    size = rows["n"].astype(np.int64) - 1 + LENGTH
    begin = np.cumsum(size) - size
    heads = np.flatnonzero(np.r_[True, np.diff(rows["gram"]) != 0][: len(rows)])
    cuts = heads[np.r_[True, np.diff(begin[heads] // ARRAY) != 0][: len(heads)]]
    return [slice(a, b) for a, b in zip(cuts, np.r_[cuts[1:], len(rows)])]


def repeated_windows(rows: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Runs of the windows of phrases that are not the first of their bytes; body: the phrases' bytes, in the order of rows."""
    size = rows["n"].astype(np.int64) - 1 + LENGTH
    order = np.argsort(rows["gram"], kind="stable")
    rows, begin, out = rows[order], (np.cumsum(size) - size)[order], [np.zeros(0, RUN)]
    for some in together(rows):
        r, n = rows[some], rows["n"][some].astype(np.int64)
        size = n - 1 + LENGTH
        first = np.cumsum(size) - size
        rank = suffix_ranks(body[np.repeat(begin[some] - first, size) + np.arange(size.sum())])
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rank = rank[np.repeat(first, n) + inner]
        doc, crc, at = np.repeat(r["doc"], n), np.repeat(r["crc"], n), np.repeat(r["at"].astype(np.int64), n) + inner
        order, again = repeats((rank,), doc, crc, at)
        found = order[again]
        out.append(runs(doc[found], crc[found], at[found], np.ones(len(found), np.int64)))
    return np.concatenate(out)


def prints(rows: np.ndarray, body: np.ndarray) -> np.ndarray:
    """The 128-bit hashes and places of all windows of phrases; body: as above."""
    n = rows["n"].astype(np.int64)
    first = np.cumsum(n - 1 + LENGTH) - (n - 1 + LENGTH)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(first, n) + inner
    p = np.zeros(len(begin), PRINT)
    p["f1"], p["f2"] = (Hashes(body, x)(begin, begin + LENGTH) for x in BASES)
    p["doc"], p["crc"], p["at"] = np.repeat(rows["doc"], n), np.repeat(rows["crc"], n), np.repeat(rows["at"].astype(np.int64), n) + inner
    return p


def _out(rows, names, types):
    import pyarrow as pa

    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)


def removed_runs(docs: DataFrame, buckets: int, groups: int) -> tuple[DataFrame, DataFrame]:
    """Runs of repeated windows as (kind, grp, rows), and docs with their group."""
    import pyarrow as pa

    by = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    grouped = docs.select("doc_id", "text", F.pmod(by, F.lit(groups)).cast("int").alias("grp"))

    def cut(batches):
        for batch in blocks(batches, TOGETHER):
            rows, places = [], []
            for *piece, shift in pieces(batch.column("doc_id").to_pylist(), batch.column("text").cast("binary").to_pylist()):
                u, b = parse(*piece, shift, buckets)
                rows.append(u)
                places.append(b)
            if not rows:
                continue
            u, b = np.concatenate(rows), np.concatenate(places)
            order, again = repeats((u["c1"], u["c2"]), u["doc"], u["crc"], u["at"])
            found = u[order[again]]
            out = [(buckets + g, x) for _, g, x in dealt("R", runs(found["doc"], found["crc"], found["at"], found["n"]), groups)]
            u, b = u[order[~again]], b[order[~again]]
            order = np.argsort(b, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(b[order]) != 0])
            out += [(int(b[order[x]]), u[order[x:y]].tobytes()) for x, y in zip(cuts, np.r_[cuts[1:], len(u)])]
            yield from _out(out, ["bucket", "rows"], [pa.int32(), pa.binary()]).to_batches()

    def look_up(key, part):
        bucket = key[0].as_py()
        if bucket >= buckets:
            out = list(dealt("R", runs(*(joined(part.column("rows"), RUN)[c] for c in ("doc", "crc", "at", "n"))), groups))
        else:
            u = joined(part.column("rows"), UNIT)
            order, again = repeats((u["c1"], u["c2"]), u["doc"], u["crc"], u["at"])
            found, u = u[order[again]], u[order[~again]]
            out = list(dealt("R", runs(found["doc"], found["crc"], found["at"], found["n"]), groups))
            _, of, n = np.unique(u["gram"], return_inverse=True, return_counts=True)
            some = n[of] > 1
            ask = np.zeros(int(some.sum()), ASK)
            for c in ("doc", "crc", "at", "n", "gram"):
                ask[c] = u[c][some]
            ask["hot"], ask["bucket"] = n[of][some] > HOT, bucket
            out += dealt("Q", ask, groups)
        return _out(out, ["kind", "grp", "rows"], [pa.string(), pa.int32(), pa.binary()])

    def fetch(key, part, asked):
        out = []
        ask = joined(asked.column("rows"), ASK)
        asked_for = set(ask["doc"].tolist())
        texts_of = {(i, zlib.crc32(x)): x for i, x in zip(part.column("doc_id").to_pylist(), part.column("text").cast("binary").to_pylist()) if i in asked_for}
        ask = ask[np.lexsort((ask["at"], ask["crc"], ask["doc"]))]

        def body_of(rows):
            return b"".join(texts_of[d, c][a : a + n - 1 + LENGTH] for d, c, a, n in zip(*(rows[x].tolist() for x in ("doc", "crc", "at", "n"))))

        cold = ask[ask["hot"] == 0]
        for b, rows in _by(cold[np.argsort(cold["bucket"], kind="stable")], "bucket"):
            out.append((b, rows.tobytes(), body_of(rows)))
        hot = ask[ask["hot"] > 0]
        most = ARRAY // (SPAN - 1 + LENGTH)
        for i in range(0, len(hot), most):
            p = prints(hot[i : i + most], np.frombuffer(body_of(hot[i : i + most]), np.uint8))
            b = (p["f1"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(b[order]) != 0])
            out += [(buckets + int(b[order[x]]), p[order[x:y]].tobytes(), b"") for x, y in zip(cuts, np.r_[cuts[1:], len(p)])]
        return _out(out, ["bucket", "rows", "body"], [pa.int32(), pa.binary(), pa.binary()])

    def combine(key, part):
        if key[0].as_py() >= buckets:
            p = joined(part.column("rows"), PRINT)
            order, again = repeats((p["f1"], p["f2"]), p["doc"], p["crc"], p["at"])
            doc, crc, at = (p[x][order[again]] for x in ("doc", "crc", "at"))
            found = runs(doc, crc, at, np.ones(len(doc), np.int64))
        else:
            found = repeated_windows(joined(part.column("rows"), ASK), joined(part.column("body"), np.dtype(np.uint8)))
        return _out(list(dealt("R", found, groups)), ["kind", "grp", "rows"], [pa.string(), pa.int32(), pa.binary()])

    found = written(docs.mapInArrow(cut, "bucket int, rows binary").groupBy("bucket").applyInArrow(look_up, "kind string, grp int, rows binary"))
    asked = found.where("kind = 'Q'")
    brought = grouped.where("doc_id is not null").groupBy("grp").cogroup(asked.groupBy("grp")).applyInArrow(fetch, "bucket int, rows binary, body binary")
    parts = brought.groupBy("bucket").applyInArrow(combine, "kind string, grp int, rows binary")
    return found.where("kind = 'R'").unionByName(written(parts)), grouped


def _by(rows: np.ndarray, column: str):
    cuts = np.flatnonzero(np.r_[True, np.diff(rows[column]) != 0]) if len(rows) else np.zeros(0, int)
    for a, b in zip(cuts, np.r_[cuts[1:], len(rows)]):
        yield int(rows[column][a]), rows[a:b]


def spans_of(rows: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Bytes to remove of each document, as maximal runs."""
    r = runs(rows["doc"], rows["crc"], rows["at"], rows["n"].astype(np.int64) + LENGTH - 1)
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, c, a, n in zip(*(r[x].tolist() for x in ("doc", "crc", "at", "n"))):
        out.setdefault((d, c), []).append((a, a + n))
    return out


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `with_text`, text_crc (crc32 of the whole text) and kept_text:
    the bytes that are left, without the parts of characters that a removed run has cut through."""
    import pyarrow as pa

    spark = docs.sparkSession
    full = texts(docs)
    size = full.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))
    found, grouped = removed_runs(full, buckets, groups)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text_crc", "kept_text"] * with_text
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.int64(), pa.string()] * with_text

    def drop(key, part, repeated):
        spans = spans_of(joined(repeated.column("rows"), RUN))
        out = []
        for i, raw in zip(part.column("doc_id").to_pylist(), part.column("text").cast("binary").to_pylist()):
            crc = zlib.crc32(raw)
            cut = spans.get((i, crc), [])
            edges = [0, *(x for ab in cut for x in ab), len(raw)]
            left = [raw[a:b] for a, b in zip(edges[::2], edges[1::2])]
            kept = b"".join(left)
            row = (i, len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest())
            out.append((*row, crc, "".join(x.decode(errors="ignore") for x in left)) if with_text else row)
        return _out(out, names, types)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text_crc long, kept_text string" * with_text
    return grouped.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(drop, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
