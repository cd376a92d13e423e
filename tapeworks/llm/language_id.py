"""Language ID: scripts narrow the candidates, Viterbi with a switching penalty labels spans.

Learned from labelled texts: for each language the log frequency of its words' character 1-, 2- and 3-grams, hashed into
`SLOTS` slots, and the scripts that its letters belong to. A word (what stands between white space) is scored under each
language by its grams' mean log frequency times its letters, at most `MOST` apart; a language none of whose texts use the
word's script is no candidate. The best path over a text's words pays `PENALTY` for each change of language. The text's
language is the one with most letters on the path (ties: the first by name), the score its share of the letters, and
`spans` gives the path as runs of words.

Learning reads at most `TRAIN_ROWS` labelled rows, those with the least xxhash64(doc_id): a bound on the classifier's
fit alone. Null texts and texts without a letter are `und` with score 0 and no span; without any labelled row all are.
Texts are read whole; repeated rows give repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeworks.llm.common import Ids, blocks, mixed, spread, table, texts

SLOTS = 1 << 16
TRAIN_ROWS = 16_000
PENALTY, MOST, NEVER = 12.0, 8.0, -40.0
MOST_WORDS = 400_000
#: Where a script's letters begin, by code point; each range ends where the next begins.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"),
    (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"), (0x0800, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Canadian"), (0x1680, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Canadian"),
    (0x1900, "Other"), (0x1B00, "Balinese"), (0x1B80, "Sundanese"), (0x1BC0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C00, "Glagolitic"), (0x2C60, "Latin"), (0x2C80, "Coptic"), (0x2D00, "Georgian"),
    (0x2D30, "Tifinagh"), (0x2D80, "Ethiopic"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x2E80, "Han"), (0x2FE0, "Other"), (0x3005, "Han"),
    (0x3008, "Other"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Other"), (0x31A0, "Bopomofo"), (0x31C0, "Other"),
    (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0x4DC0, "Other"), (0x4E00, "Han"), (0xA000, "Yi"), (0xA4D0, "Lisu"), (0xA500, "Vai"),
    (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xA980, "Javanese"), (0xA9E0, "Other"), (0xAB30, "Latin"),
    (0xAB70, "Cherokee"), (0xABC0, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0xFFE0, "Other"), (0x1B000, "Kana"), (0x1B170, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
)
STARTS = [a for a, _ in SCRIPTS]
NAMES = sorted({n for _, n in SCRIPTS})
OF_RANGE = [NAMES.index(n) for _, n in SCRIPTS]


def script(word: str) -> int:
    """The script of a word's first letter, as a place in NAMES."""
    for c in word:
        if c.isalpha():
            return OF_RANGE[bisect_right(STARTS, ord(c)) - 1]
    return -1


def letters(word: str) -> int:
    return len(word) if word.isalpha() else sum(map(str.isalpha, word))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the grams of all words, one after another, and how many each word has. Words are put in lower case; what
    is no letter counts as a word's edge."""
    edged = [f" {w.lower() if w.isalpha() else ''.join(c if c.isalpha() else ' ' for c in w.lower())} " for w in words]
    length = np.fromiter(map(len, edged), np.int64, len(edged))
    c = np.frombuffer("".join(edged).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.repeat(np.arange(len(edged)), length)
    gap = c == 32
    slot, of = [], []
    for n in (1, 2, 3):
        key = c[: len(c) - n + 1].copy()
        ok = word[: len(key)] == word[n - 1 :]
        blank = gap[: len(key)].copy()
        for k in range(1, n):
            key = key * np.uint64(0x110000) + c[k : len(c) - n + 1 + k]
            blank &= gap[k : len(c) - n + 1 + k]
        ok &= ~blank
        slot.append((mixed(key[ok] + np.uint64(n << 62)) & np.uint64(SLOTS - 1)).astype(np.int64))
        of.append(word[: len(ok)][ok])
    slot, of = np.concatenate(slot), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return slot[order], np.bincount(of, minlength=len(edged))


def learn(labelled: DataFrame) -> dict:
    """From labelled (text, lang): languages by name, a table of log frequencies by slot and language, and which
    languages each script may be. The counts that reach the driver are SLOTS + scripts for each language at most."""

    def count(batches):
        import pyarrow as pa
        from collections import Counter, defaultdict

        held = defaultdict(lambda: np.zeros(SLOTS + len(NAMES), dtype=np.int64))
        for batch in blocks(batches):
            of = defaultdict(Counter)
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                of[lang].update(text.split())
            for lang, words in of.items():
                names, times = list(words), np.fromiter(words.values(), np.int64)
                slot, n = grams(names)
                held[lang] += np.bincount(slot, np.repeat(times, n), SLOTS + len(NAMES)).astype(np.int64)
                for w, k in words.items():
                    if (s := script(w)) >= 0:
                        held[lang][SLOTS + s] += k * letters(w)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "slot", "n"])

    counts = spread(labelled.select("doc_id", "text", "lang"), "doc_id").mapInArrow(count, "lang string, slot int, n long")
    got = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    langs = sorted(set(got["lang"]))
    at = {x: i for i, x in enumerate(langs)}
    n = np.zeros((SLOTS + len(NAMES), len(langs)))
    n[np.array(got["slot"], np.int64), [at[x] for x in got["lang"]]] = got["n"]
    scripts = n[SLOTS:]
    may = scripts >= 0.01 * np.maximum(scripts.sum(0), 1)
    rate = np.log((n[:SLOTS] + 0.5) / (n[:SLOTS].sum(0) + 0.5 * SLOTS))
    return {"langs": langs, "rate": rate.astype(np.float32), "may": may}


class Scorer:
    """Scores, letters of words under each language; kept between texts."""

    def __init__(self, model: dict):
        self.model = model
        self.new()

    def new(self):
        self.ids, self.score, self.letters = Ids(), np.zeros((0, len(self.model["langs"])), np.float32), np.zeros(0, np.int64)

    def add(self, words: list[str]) -> None:
        if not words:
            return
        slot, n = grams(words)
        total = np.zeros((len(words), len(self.model["langs"])), np.float32)
        some = n > 0
        if some.any() and self.model["langs"]:
            begin = (np.cumsum(n) - n)[some]
            sums = np.add.reduceat(self.model["rate"][slot], begin, axis=0)
            count = np.fromiter(map(letters, words), np.int64, len(words))
            total[some] = sums / n[some][:, None] * count[some][:, None]
            total[some] -= total[some].max(1, keepdims=True)
            total = np.maximum(total, -MOST)
            kind = np.fromiter(map(script, words), np.int64, len(words))
            may = self.model["may"][kind] & (kind >= 0)[:, None]
            narrow = may.any(1) & some
            total[narrow] = np.where(may[narrow], total[narrow], NEVER)
            total[narrow] -= total[narrow].max(1, keepdims=True)
            total[~narrow] = 0
        else:
            count = np.zeros(len(words), np.int64)
        self.score, self.letters = np.concatenate([self.score, total]), np.concatenate([self.letters, count])

    def number(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) * max(4, len(self.model["langs"])) > 4 * MOST_WORDS:
            self.new()
        known = len(self.ids)
        get, rows = self.ids.__getitem__, []
        for t in many:
            w = t.split()
            rows.append(np.fromiter(map(get, w), np.int32, len(w)))
        from itertools import islice

        self.add(list(islice(self.ids, known, None)))
        return np.concatenate(rows) if rows else np.zeros(0, np.int32), np.cumsum([0, *map(len, rows)])


def best_paths(score: np.ndarray, word: np.ndarray, bounds: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word on its text's best path. All texts of the block advance together, a word at a time,
    the longest first, so a step is a few array operations over the texts that still have words."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    begin, length = bounds[:-1][order], length[order]
    k = score.shape[1]
    stays, best = np.zeros((len(word), k), bool), np.zeros(len(word), np.int32)
    live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")  # texts longer than t
    v = np.zeros((len(length), k), np.float32)
    for t, n in enumerate(live.tolist()):
        at = begin[:n] + t
        x = v[:n]
        if t:
            top = x.argmax(1)
            best[at] = top
            change = x[np.arange(n), top][:, None] - np.float32(penalty)
            stays[at] = x >= change
            x = np.maximum(x, change)
        v[:n] = x + score[word[at]]
        v[:n] -= v[:n].max(1, keepdims=True)  # the path does not change; sums stay small
    path = np.zeros(len(word), np.int32)
    now = v.argmax(1).astype(np.int32)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        path[at] = now[:n]
        if t:
            now[:n] = np.where(stays[at, now[:n]], now[:n], best[at])
    return path


def label(docs: DataFrame, model: dict, with_spans: bool = True) -> DataFrame:
    """docs with a column text: its other columns, lang_pred, score and, with `with_spans`, spans of words."""
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c != "text"] + ["lang_pred string", "score double"] + ["spans array<struct<first:int,last:int,lang:string>>"] * with_spans)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches):
        import pyarrow as pa

        langs = sent.value["langs"]
        scorer = Scorer(sent.value)
        for batch in blocks(batches, 64_000_000 // max(4, len(langs))):
            many = batch.column("text").to_pylist()
            word, bounds = scorer.number(many)
            del many
            n = len(bounds) - 1
            share = np.zeros((n, max(1, len(langs))))
            path = np.zeros(len(word), np.int32)
            if langs and len(word):
                path = best_paths(scorer.score, word, bounds)
                of = np.repeat(np.arange(n), np.diff(bounds))
                share = np.bincount(of * len(langs) + path, scorer.letters[word], n * len(langs)).reshape(n, -1)
            total = share.sum(1)
            top = share.argmax(1)
            p = share[np.arange(n), top] / np.maximum(total, 1)
            out = [*(batch.column(c) for c in kept), pa.array([langs[j] if t else "und" for j, t in zip(top.tolist(), total.tolist())], pa.string()), pa.array(p)]
            names = [*kept, "lang_pred", "score"]
            if with_spans:
                spans = []
                for a, b, t in zip(bounds[:-1], bounds[1:], total.tolist()):
                    cut = np.r_[0, np.flatnonzero(np.diff(path[a:b])) + 1, b - a] if t else np.zeros(0, int)
                    spans.append([{"first": int(i), "last": int(j) - 1, "lang": langs[path[a + i]]} for i, j in zip(cut[:-1], cut[1:])])
                out.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.withColumn("text", F.coalesce("text", F.lit(""))).mapInArrow(find, schema)


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    chosen = usable.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return usable.select("doc_id", "text", "lang").join(F.broadcast(chosen.distinct()), "doc_id")  # at most `rows` ids


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return label(spread(texts(docs, held.alias("held_out")), "doc_id"), learn(training_rows(docs)), with_spans=False)
