"""Models and searches against brute force; what held-out rows may not change; rows without an id."""

import collections
import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import bpe, decontaminate, language_id, minhash, quality_classifier, quality_rules, registry, suffix_dedup, wavelet
from tapeworks.llm.common import scratch, table
from tests.llm.test_llm import DOCS, SF, WORDS, frame, prose

Q = quality_classifier


def test_ftrl_against_a_plain_one():
    rng = random.Random(1)
    model, z, n = Q.FTRL(), collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= Q.L1 else -(z[i] - math.copysign(Q.L1, z[i])) / ((Q.BETA + math.sqrt(n[i])) / Q.ALPHA + Q.L2)

    for _ in range(300):
        slots = np.array(sorted(rng.sample(range(40), 6)))
        x = np.array([rng.random() for _ in slots], np.float32)
        y = int(sum(slots) % 7 < 3)
        model.learn(slots, x, y)
        pairs = [*zip(slots.tolist(), x.tolist()), (Q.SIZE, 1.0)]
        w = {i: weight(i) for i, _ in pairs}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
        for i, v in pairs:
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / Q.ALPHA * w[i]
            n[i] += g * g
    got = model.weights()
    assert all(abs(got[i] - weight(i)) < 1e-9 for i in [*range(40), Q.SIZE])


def test_calibration():
    rng = np.random.default_rng(2)
    sums = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.7 * sums - 0.8)))).astype(int)
    slope, offset = Q.calibration(sums, y)
    assert abs(slope - 1.7) < 0.15 and abs(offset + 0.8) < 0.15
    assert Q.calibration(sums, np.ones(4000, int)) == (1.0, 0.0) == Q.calibration(np.zeros(0), np.zeros(0, int))


def held(spark, tmp_path, name, change):
    """The query over tables whose held-out rows `change` has altered."""
    for t in ("documents", "labels"):
        change(t, table(spark, SF, t)).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
    keep = [c for c in ("doc_id", "score", "lang_pred", "predicted")]
    out = registry.QUERIES[name](spark, str(tmp_path))
    return sorted(tuple(r) for r in out.select(*[c for c in keep if c in out.columns]).collect())


def test_held_out_labels_change_no_score(spark, tmp_path):
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    plain = held(spark, tmp_path / "a", "op10_quality_classifier", lambda t, d: d)
    flipped = held(spark, tmp_path / "b", "op10_quality_classifier", lambda t, d: d.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))) if t == "labels" else d.withColumns({"lang": F.lit("zz"), "source": F.lit("zz")}))
    assert plain == flipped and len({s for _, s, _ in plain}) > 20


def test_held_out_languages_change_no_prediction(spark, tmp_path):
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    plain = held(spark, tmp_path / "a", "op3_language_id", lambda t, d: d)
    changed = held(spark, tmp_path / "b", "op3_language_id", lambda t, d: d.withColumn("lang", F.when(out, F.lit("zz")).otherwise(F.col("lang"))) if t == "documents" else d)
    assert plain == changed


def test_best_paths_against_all_paths():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3):
        for n in (1, 2, 5, 6):
            score = rng.normal(0, 2, (8, k)).astype(np.float32)
            word = rng.integers(0, 8, n)
            path = language_id.best_paths(score, word, np.array([0, n]), penalty=1.5)
            worth = lambda p: sum(float(score[w, x]) for w, x in zip(word, p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
            assert worth(path.tolist()) == pytest.approx(max(map(worth, itertools.product(range(k), repeat=n))), abs=1e-4)


def test_two_hundred_languages(spark):
    """Each language has words of its own letters, in four scripts."""
    rng, rows, want = random.Random(4), [], {}
    for k in range(200):
        base = (0x61, 0x3B1, 0x430, 0x561)[k % 4]
        letters = rng.sample(range(20), 6)
        words = ["".join(chr(base + rng.choice(letters)) for _ in range(5)) for _ in range(30)]
        for _ in range(3):
            rows.append((len(rows), " ".join(rng.choice(words) for _ in range(40)), f"l{k:03}", "s", 0))
        want[len(rows)] = f"l{k:03}"
        rows.append((len(rows), " ".join(rng.choice(words) for _ in range(40)), None, "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.learn(docs.where("lang is not null").select("doc_id", "text", "lang"))
    got = {r.doc_id: r.lang_pred for r in language_id.label(docs.where("lang is null").select("doc_id", "text"), model).collect()}
    assert sum(got[i] == x for i, x in want.items()) >= 0.95 * len(want)
    assert {x for i, x in want.items() if got[i] == x} & {f"l{k:03}" for k in range(129, 200)}


def test_scripts():
    for word, name in (("word", "Latin"), ("λόγος", "Greek"), ("слово", "Cyrillic"), ("שלום", "Hebrew"), ("كلمة", "Arabic"), ("शब्द", "Devanagari"), ("คำ", "Thai"), ("ቃል", "Ethiopic"), ("కథ", "Telugu"), ("ភាសា", "Khmer"), ("日本", "Han"), ("かな", "Kana"), ("한국", "Hangul"), ("ĳsłŁ", "Latin")):
        assert language_id.NAMES[language_id.script(word)] == name
    assert language_id.script("123 --") == -1


def brute_leaks(items, texts):
    """Every item in every text, as step 4 has it, over all places of the text."""
    import re

    out = set()
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    for i, x in enumerate(items):
        item = re.findall(r"\w+", (x or "").lower())
        for d, ws in enumerate(words):
            if item and any(ws[k : k + len(item)] == item for k in range(len(ws) - len(item) + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("size", [1, 3, 5, 8, 12, 20, 90])
def test_verbatim_items_of_any_length(spark, size):
    rng = random.Random(size)
    word = lambda: rng.choice(WORDS) + rng.choice(WORDS)
    items = [" ".join(word() for _ in range(size)) for _ in range(30)]
    texts = [" ".join(word() for _ in range(300)) for _ in range(60)]
    for k in range(30):
        w = texts[k].split()
        at = rng.randrange(len(w))
        texts[k] = " ".join(w[:at] + items[k].split() + w[at:])
    brute = brute_leaks(items, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, texts), bench).collect()}
    assert len(brute & got) >= 0.9 * len(brute) and len(brute) >= 30
    assert not got - brute


def test_changed_items(spark):
    """Items of 40 words of which a part is replaced: those that keep enough for step 4 are found."""
    rng = random.Random(21)
    word = lambda: rng.choice(WORDS) + rng.choice(WORDS)
    items = [[word() for _ in range(40)] for _ in range(40)]
    texts, planted = [" ".join(word() for _ in range(300)) for _ in range(60)], {}
    for k in range(40):
        changed = list(items[k])
        for j in rng.sample(range(40), 12 if k % 2 else 8):
            changed[j] = word()
        w = texts[k].split()
        texts[k] = " ".join(w[:100] + changed + w[100:])
        planted[k] = k
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, texts), bench).collect()}
    assert len(set(planted.items()) & got) >= 36 and not got - set(planted.items())


def test_words_of():
    import re

    texts = ["", "É x_1—ok ‘quote’ ÀB", "日本語、テスト。", "a" * 3_000_000 + " b", "²½ ٣ don't", "x y z"]
    flat, bounds = decontaminate.words_of(texts)
    assert np.diff(bounds).tolist() == [len(re.findall(r"\w+", t.lower())) for t in texts]
    one = {w: int(decontaminate.words_of([w])[0][0]) for t in texts for w in re.findall(r"\w+", t.lower())}
    assert flat.tolist() == [one[w] for t in texts for w in re.findall(r"\w+", t.lower())] and len(set(one.values())) == len(one)


def test_compression_bands(spark):
    """A corpus too small for limits of its own: the wide fixed bands, for whole texts and every chunk."""
    rng = random.Random(5)
    good, junk = prose(rng, 3000)[: quality_rules.CHUNK], " x" * (quality_rules.CHUNK // 2 - 1)
    noise = "".join(chr(rng.randrange(33, 127)) + " " * (k % 60 == 0) for k in range(9000))
    texts = [good + junk, junk + good, prose(rng, 5000), noise, good]
    rows = quality_rules.judge(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)).orderBy("doc_id").collect()
    assert [(r.n_chunks, r.n_bad_chunks) for r in rows[:2]] == [(2, 1), (2, 1)] and rows[2].n_chunks > 5 and rows[2].n_bad_chunks == 0
    assert [r.kept for r in rows] == [False, False, True, False, True] and not rows[3].base_failed and rows[3].zstd_ratio < 1.3


def plain_verdicts(texts):
    """Compression bands of a corpus by plain Python: classes, quartiles, smoothed middles, limits, verdicts."""
    import math
    import statistics

    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    ratio = lambda b: len(b) / len(squeeze(b))
    of = lambda n: math.floor(2 * math.log2(n))
    raw = [(t or "").encode() for t in texts]
    failed = [quality_rules.base_rules(b)[-1] for b in raw]
    classes = collections.defaultdict(set)
    for b, f in zip(raw, failed):
        if not f:
            classes[of(len(b))].add((len(b), ratio(b)))
    q = {}
    for k, pairs in classes.items():
        v = sorted(r for _, r in pairs)
        if len(v) >= 30:
            q[k] = [v[max(0, math.ceil(p * len(v)) - 1)] for p in (0.25, 0.5, 0.75)]
    assert len(q) >= 4
    ks = sorted(q)
    slope = statistics.median((q[j][1] - q[i][1]) / (j - i) for i in ks for j in ks if i < j)

    def limits(n):
        k = of(n)
        to = min(max(k, ks[0]), ks[-1])
        near = [c for c in ks if abs(c - to) <= 2] or [min(ks, key=lambda c: abs(c - to))]
        m = statistics.median(q[c][1] - slope * (c - to) for c in near) + slope * (k - to)
        w = max(0.03, statistics.median((q[c][2] - q[c][0]) / 1.349 for c in near))
        return m - 8 * w, m + 3 * w, m + 4 * w

    out = []
    for b, f in zip(raw, failed):
        good = bool(b) and limits(len(b))[0] <= ratio(b) <= limits(len(b))[1]
        parts = [b[k : k + 4096] for k in range(0, len(b), 4096)] if len(b) >= 4096 else []
        bad = sum(not limits(len(p))[0] <= ratio(p) <= limits(len(p))[2] for p in parts)
        out.append(not f and good and bad <= 0.34 * len(parts))
    return out


def test_bands_from_the_corpus(spark):
    """All verdicts of a table against a plain re-computation; bands decide rows, nearly none of them clean ones; a third of
    all rows being copies of one text, and a large family of near-copies, change no verdict on the rest."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    judged = lambda texts: quality_rules.judge(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)).orderBy("doc_id").collect()
    got = judged([r.text for r in rows])
    assert [r.kept for r in got] == plain_verdicts([r.text for r in rows])
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    by_bands = [label.get(r.doc_id) for r, g in zip(rows, got) if not g.base_failed and not g.kept]
    passed = collections.Counter(label.get(r.doc_id) for r, g in zip(rows, got) if not g.base_failed)
    assert by_bands.count(0) >= 0.7 * passed[0] and by_bands.count(1) <= 0.02 * passed[1]
    base = next(r.text for r, g in zip(rows, got) if g.kept and 3000 < len(r.text) < 3500)
    words, rng = base.split(), random.Random(3)
    family = [base] * 400
    for _ in range(200):
        w = list(words)
        w[rng.randrange(len(w))] = rng.choice(words)
        family.append(" ".join(w))
    again = judged([r.text for r in rows] + family)
    moved = sum(a.kept != b.kept for a, b in zip(got, again))
    assert moved <= 0.02 * len(rows), moved


def test_rows_without_an_id(spark):
    """What each docstring says of a null doc_id, with columns whose names operators use inside."""
    rng = random.Random(6)
    same = prose(rng, 60)
    rows = [(None, same, "en", "s", 0), (None, None, None, None, None), (4, same, "en", "s", 0), (7, same, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("a", "b", "n", "deal", "deals", "crc", "words", "counts", "part", "size", "host", "kept_text")})
    by = lambda df: [r for r in df.collect() if r.doc_id is None]
    assert sorted(r.n_tokens for r in by(bpe.encode_documents(docs)))[0] == 0
    assert {r.kept for r in by(minhash.near_duplicates(docs))} == {True} and {r.component_id for r in by(minhash.near_duplicates(docs))} == {None}
    assert {(r.doc_id, r.kept) for r in minhash.near_duplicates(docs).where("doc_id is not null").collect()} == {(4, True), (7, False)}
    assert {r.n_removed for r in by(suffix_dedup.remove_repeats(docs))} == {0}
    assert len(by(quality_rules.judge(docs))) == 2
    assert len(by(language_id.label(docs.select("doc_id", "text"), language_id.learn(language_id.training_rows(docs))))) == 2
    assert len(by(Q.score(docs.select("doc_id", "text"), np.zeros(Q.SIZE + 1)))) == 2
    wavelet.write_shards(docs, path := scratch(spark))
    assert sorted(r.start for r in wavelet.read_shards(spark, path).collect() if r.doc_id is None)[0] == 0
    bench = spark.createDataFrame([(1, " ".join(same.split()[:20])), (None, same), (1, " ".join(same.split()[:20]))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).orderBy("doc_id").collect()] == [(4, 1), (7, 1)]


def test_pipeline_against_planted_rows(spark, tmp_path):
    """Junk goes, of each group of copies the least id stays, repeated passages and leaks go, clean rows keep their text."""
    import corpus_pipeline as P

    rng = random.Random(7)
    word = lambda: rng.choice(WORDS) + rng.choice(WORDS)
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [text(150) for _ in range(30)]
    near = clean[3].split()
    near[70] = "changed"
    item, passage = text(40), text(30)
    texts = clean + [clean[0], " ".join(near), text(100) + " " + item + " " + text(60), text(90) + " " + passage, text(80) + " " + passage, "word " * 200, "short", None]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(30), 33, 34}
    from hashlib import sha256

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    cut = texts[34].replace(passage, "").rstrip()
    for i in range(34):
        if i in got:
            ids = t.encode(texts[i], add_special_tokens=False).ids
            assert got[i].ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert abs(got[34].n_tokens - len(t.encode(cut, add_special_tokens=False).ids)) <= 3


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0), (3, 0)], [(1, None), (2, None)], [(None, 1), (1, 1), (1, 0), (2, None), (6, 1)]])
def test_classifier_of_few_labels(spark, labels):
    """No label, one row, one class, null labels and ids, a doc_id with two labels: a score for each text, and the same one again."""
    texts = ["", None, *(f"{w} some words of a text {w}" for w in WORDS[:8])]
    docs = frame(spark, texts)
    given = spark.createDataFrame(labels, "doc_id long, quality long")
    weights = Q.fit(Q.training_rows(docs, given))
    again = Q.fit(Q.training_rows(docs, given))
    assert np.array_equal(weights, again) and np.isfinite(weights).all()
    rows = Q.score(docs.select("doc_id", "text"), weights).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    if not any(y is not None and d is not None for d, y in labels):
        assert not weights.any() and {r.score for r in rows} == {0.5}


CLASHES = ["key", "deal", "n", "id", "a", "b", "words", "counts", "chosen", "size", "set_id", "sig", "bands", "rows", "grp", "bucket", "part", "z", "y", "slots", "x", "payload", "host", "tree", "chunk_no", "place", "kept", "digest", "keep_id", "leaf", "form", "unit"]


def test_columns_that_clash(spark):
    """Further columns of names that operators use inside change no result."""
    from tapeworks.llm import exact_dedup, html_extract, warc

    rng = random.Random(31)
    base = prose(rng, 60)
    texts = [base, base + " more", base, None, "", *(prose(rng, 50) for _ in range(6))]
    docs, item = frame(spark, texts), texts[7]
    pages = spark.createDataFrame([(i, f"http://h{i % 2}/{i}", f"<html><body><h1>T {i}</h1><p>{t}</p></body></html>") for i, t in enumerate(texts)], "page_id long, url string, html string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    more = lambda df: df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES if c not in df.columns})

    def archived(p):
        warc.write_archive(p, path := scratch(spark))
        return warc.read_archive(spark, path)

    for work in (minhash.near_duplicates, suffix_dedup.remove_repeats, lambda d: decontaminate.leaks(d, bench), lambda d: decontaminate.leaks(docs, more(bench)) if d is not docs else decontaminate.leaks(d, bench), quality_rules.judge, bpe.encode_documents, exact_dedup.exact_duplicates):
        plain = work(docs)
        assert sorted(map(str, plain.collect())) == sorted(map(str, work(more(docs)).select(*plain.columns).collect()))
    for work in (html_extract.extract, archived):
        plain = work(pages)
        assert sorted(map(str, plain.collect())) == sorted(map(str, work(more(pages)).select(*plain.columns).collect()))


def test_latent_space_against_a_full_decomposition():
    """The directions hold nearly all that as many of a plain SVD of the weighted passages hold, however the sample is cut."""
    D = decontaminate
    rng = random.Random(37)
    word = lambda: rng.choice(WORDS) + rng.choice(WORDS)
    docs = [D.words_of([" ".join(word() for _ in range(rng.randrange(1, 400)))])[0].astype("<u4") for _ in range(40)]
    flat, bounds = D.words_of([" ".join(word() for _ in range(40)) for _ in range(12)])
    idf = np.random.default_rng(5).random(D.SLOTS) + 0.5
    _, begin, end = D.passages(bounds)
    items = (*D.vectors(flat, begin, end, idf), len(begin))
    every, limits = np.concatenate(docs), np.cumsum([0, *map(len, docs)])
    _, first, last = D.passages(limits)
    row, slot, v = D.vectors(every, first, last, idf)
    a = np.zeros((len(first) + items[3], D.SLOTS), np.float32)
    a[row, slot] = v
    a[len(first) + items[0], items[1]] = items[2] * np.sqrt(D.WEIGHT * len(first) / items[3])
    best = (np.linalg.svd(a, compute_uv=False)[: D.RANK] ** 2).sum()
    raw = [x.tobytes() for x in docs]
    space = D.latent_space(raw, items, idf)
    assert space.shape == (D.SLOTS, D.RANK) and np.allclose(space.T @ space, np.eye(D.RANK), atol=1e-4)
    assert 0.97 * best < ((a @ space) ** 2).sum() <= 1.001 * best
    whole, D.PART_BYTES = D.PART_BYTES, 900
    try:
        parts = D.latent_space(raw, items, idf)
    finally:
        D.PART_BYTES = whole
    assert ((a @ parts) ** 2).sum() > 0.97 * best
    assert D.latent_space([], items, idf).shape == space.shape


def test_suffix_arrays_of_a_bucket(monkeypatch):
    """A bucket of 4 MB is worked on in arrays of whole triggers, so in less than 80 MB (one array of all: over 300); what is found
    doesn't hang on where they are cut."""
    rng = np.random.default_rng(8)
    pick = rng.integers(0, 12_000, 30_000)
    rows = np.zeros(len(pick), suffix_dedup.ASK)
    rows["doc"], rows["crc"], rows["at"], rows["n"], rows["gram"] = rng.permutation(len(pick)), 7, rng.integers(0, 9999, len(pick)), 41, pick // 4
    stem = rng.integers(97, 123, (12_000, 140), dtype=np.uint8)
    body = stem[pick]
    body[np.arange(len(pick)), rng.integers(0, 140, len(pick))] = 65 + rng.integers(0, 26, len(pick))
    tracemalloc.start()
    found = suffix_dedup.repeated_windows(rows, body.ravel())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    first: dict[bytes, tuple[int, int]] = {}
    windows = [((int(d), int(a) + i), x[i : i + 100].tobytes()) for d, a, x in zip(rows["doc"], rows["at"], body) for i in range(41)]
    for place, w in windows:
        first[w] = min(first.get(w, place), place)
    want = {place for place, w in windows if first[w] != place}
    assert want and {(int(r["doc"]), int(r["at"]) + i) for r in found for i in range(r["n"])} == want
    cuts = []
    for size in (1, 5000, 1 << 30):
        monkeypatch.setattr(suffix_dedup, "ARRAY", size)
        cuts.append(sorted(suffix_dedup.repeated_windows(rows[:9000], body[:9000].ravel()).tolist()))
    assert cuts[0] and cuts[0] == cuts[1] == cuts[2]
