"""BPE encoding and decoding by batched numpy merge rounds.

`WordBPE` reads a `tokenizers` file of the word-end kind (NFC, white space, lower case; byte-level symbols; the last
symbol of a word carries `</w>`). The words of many texts are numbered; the symbols of all words not seen before lie in
one flat array. Each round looks every adjacent pair up by binary search in the sorted pair keys, takes the lowest rank
of each word and merges all its places at once; words without a pair leave the array.

A pair of a merge list is made of symbols that lower ranks have made, so no merge of rank r makes a pair of a rank
below r: all places of a word's lowest pair can be merged in one round.

Nulls encode as the empty text, which has no ids and decodes to the empty text. Texts of any length are handled whole;
repeated rows give repeated results; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from tapeworks.llm.common import Ids, blocks, spread, table, texts

END = "</w>"
NOT_SPACE = regex.compile("[\x1c-\x1f]")
#: White space in Unicode's sense, as the file's \s has it; str.split() also splits at the four characters of NOT_SPACE.
SPACE = "\t-\r \x85\xa0  -     　"
#: What the file's own Split pattern matches, with \s spelled out.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"
#: Words kept between batches; beyond them the table of words starts anew.
MOST_WORDS = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Ragged:
    """Rows of numbers of different lengths, one after another in one array."""

    def __init__(self, flat: np.ndarray, length: np.ndarray):
        self.flat, self.length = flat, length

    def extend(self, flat: np.ndarray, length: np.ndarray) -> None:
        self.flat, self.length = np.concatenate([self.flat, flat]), np.concatenate([self.length, length])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these rows one after another, and the bounds of each row."""
        begin = (np.cumsum(self.length) - self.length)[rows]
        length = self.length[rows]
        bounds = np.r_[0, np.cumsum(length)]
        return self.flat[np.repeat(begin - bounds[:-1], length) + np.arange(bounds[-1])], bounds


class WordBPE:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.uint32)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.uint32)
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.uint32)
        self.last = np.array([vocab[c + END] for c in chars], dtype=np.uint32)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.find = regex.compile(WORD).findall
        self._new()

    def _new(self) -> None:
        """Two tables: chunks (what lies between white space) and the words that they hold."""
        self.chunks, self.words = Ids(), Ids()
        for s in self.special:
            self.words[s]  # no word that `find` makes is equal to one: it would be cut at the letters
        self.word_ids = Ragged(np.array(list(self.special.values()), np.uint32), np.ones(len(self.special), np.int64))
        self.chunk_ids = Ragged(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def pieces(self, chunk: str) -> list[str]:
        """The words of a chunk; a special token of the file, found before any other step, is a piece of its own."""
        if chunk in self.special:
            return [chunk]
        return self.find(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())

    def cut(self, text: str) -> list[str]:
        """Chunks of a text. No word crosses white space, so each chunk can be encoded by itself."""
        if "<|" in text and self.split.search(text):
            return [c for part in self.split.split(text) for c in ([part] if part in self.special else self.cut(part))]
        if NOT_SPACE.search(text):
            return regex.split("[" + SPACE + "]+", text)
        return text.split()

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        ends = np.cumsum(length)
        sym[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(raw), dtype=np.int32), length)
        done_sym, done_word = [], []
        none = len(self.keys)
        while len(sym):
            key = sym[:-1] << np.uint32(16) | sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == none] = 0
            rank = np.full(len(sym), none, dtype=np.int32)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.ranks[at[hit]]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(sym)])
            low = np.repeat(low, count)
            over = low == none
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, low = sym[~over], word[~over], rank[~over], low[~over]
                if not len(sym):
                    break
            take = rank == low
            if (take[1:] & take[:-1]).any():  # a pair of equal symbols in a run: every second place, from the left
                begin = np.flatnonzero(take & ~np.r_[False, take[:-1]])
                place = np.arange(len(take))
                since = place - begin[np.maximum(np.searchsorted(begin, place, side="right") - 1, 0)]
                take &= since % 2 == 0
            at = np.flatnonzero(take)
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(raw))

    def encode(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the bounds of each text's ids."""
        if len(self.chunks) > MOST_WORDS:
            self._new()
        known, known_words = len(self.chunks), len(self.words)
        number, chunks = self.chunks.__getitem__, [self.cut(t) for t in many]
        index = np.fromiter((number(c) for cs in chunks for c in cs), np.int64)
        if len(self.chunks) > known:
            pieces = [self.pieces(c) for c in islice(self.chunks, known, None)]
            within = np.fromiter((self.words[w] for ws in pieces for w in ws), np.int64)
            if len(self.words) > known_words:
                self.word_ids.extend(*self.merge(list(islice(self.words, known_words, None))))
            flat, upto = self.word_ids.take(within)
            bounds = upto[np.cumsum([0, *map(len, pieces)])]
            self.chunk_ids.extend(flat, np.diff(bounds))
        ids, upto = self.chunk_ids.take(index)
        return ids.astype("<u4"), upto[np.cumsum([0, *map(len, chunks)])]

    def decode(self, ids) -> str:
        """The tokens of the ids, with one space between: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


_loaded: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    """One tokenizer for each Python worker and file."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with `with_ids`, ids and decoded of every text."""
    path = path or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def encode(batches):
        import pyarrow as pa

        bpe = loaded(path)
        for batch in blocks(batches, 4_000_000):
            ids, upto = bpe.encode(batch.column("text").to_pylist())
            parts = [ids[a:b] for a, b in zip(upto[:-1], upto[1:])]
            decoded = [bpe.decode(p.tolist()) for p in parts]
            out = [
                batch.column("doc_id"),
                pa.array(np.diff(upto)),
                pa.array([hashlib.sha256(p.tobytes()).hexdigest() for p in parts]),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out += [pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())), pa.array(decoded)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return spread(texts(docs), "doc_id").mapInArrow(encode, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
