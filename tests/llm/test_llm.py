"""The operators against brute force, exact round trips and planted cases, and on awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tapeworks.llm import bpe, decontaminate, html_extract, language_id, minhash, quality_classifier, quality_rules, registry, suffix_dedup, warc, wavelet
from tapeworks.llm.common import scratch, table

SF = "/root/testdata/sf0.001"
LARGE = "/root/testdata/sf0.1"
DOCS = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
WORDS = [a + b + c for a in ("ta", "re", "mo", "li") for b in ("n", "st", "b", "rk", "w") for c in ("e", "or", "ing", "a", "us", "ey")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, white space, ties, repeated rows, a long text, odd characters; columns that operators use inside."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    texts = [None, "", " \n\t", "a", long, "x" * 5000, "same text of some words here", "same text of some words here", "ÄÖ 日本語 \x1c Σ ΑΣ", "\n".join(["line one"] * 50)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(3, "a", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("key", F.lit(1)).withColumn("score", F.lit(0.5)).withColumn("grp", F.lit("g")).withColumn("kept", F.lit(True)).withColumn("bucket", F.lit(1))


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(1)
    odd = ["", "aaaa AAAA", "İ ΣΑΣ it's I'LL <|endoftext|> x<|startoftext|>", "é é \x1c a\x1fb \x00 ², Ⅷ ٣ 😀 ​ﬁ", "!!'s", "日本 テ", "\x85a　b", "xyz" * 999]
    texts = odd + ["".join(rng.choice("abé'! \n٣Σ<|>") for _ in range(40)) for _ in range(200)]
    got = {r.doc_id: r for r in bpe.encode_documents(frame(spark, texts)).collect()}
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert got[i].ids == e.ids
        assert got[i].decoded == t.decode(e.ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()


def test_bpe_merges_make_no_lower_rank():
    b = bpe.WordBPE(bpe.default_path())
    at = {int(m): int(r) for m, r in zip(b.made, range(len(b.made)))}
    rank = dict(zip(b.keys.tolist(), b.ranks.tolist()))
    assert len(at) == len(b.made)
    for key, r in rank.items():
        assert at.get(key >> 16, -1) < r and at.get(key & 0xFFFF, -1) < r


def test_token_shards(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(120)] + [None, "<|endoftext|> x", "a\x1cb"]
    path = scratch(spark)
    wavelet.write_shards(frame(spark, texts), path, shard=500)
    got = {r.doc_id: r for r in wavelet.read_shards(spark, path).collect()}
    start = 0
    for i, e in enumerate(t.encode_batch([x or "" for x in texts], add_special_tokens=False)):
        ids = np.array([*e.ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_wavelet_matrix():
    a = np.random.default_rng(1).integers(0, 300, 3000)
    w = wavelet.WaveletMatrix.of(a)
    m = wavelet.WaveletMatrix.from_bytes(w.to_bytes(), len(w.bits))
    assert (m.all() == a).all() and (m.access(np.arange(3000)) == a).all()
    assert m.count(7) == (a == 7).sum() and m.count(7, 100, 2000) == (a[100:2000] == 7).sum() and m.count(4000) == 0
    assert m.locate(7) == np.flatnonzero(a == 7).tolist()


def brute_repeats(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(4)
    shared, line = prose(rng, 40), prose(rng, 14)
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.randrange(5, 60))]
        parts += [shared[rng.randrange(40) :]] * (rng.random() < 0.5) + [line] * (rng.random() < 0.6)
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += [texts[3], texts[5][:150], "ab" * 400, "z" * 350, None, "", "é" * 120 + texts[7]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_suffix_dedup_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = random.Random(5)
    base = prose(rng, 500)
    texts = [base, base[700:2600] + prose(rng, 100), prose(rng, 50)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def test_minhash_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SEEKERS", 8)
    monkeypatch.setattr(minhash, "HELD", 16)
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(1, 80)) for _ in range(60)]
    base = prose(rng, 100).split()
    for _ in range(150):  # a chain of copies, some nearer than others
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [texts[3], texts[3].upper(), None, "", "one", "One", " "]
    comp, sizes = brute_components(texts, 2, 80)
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts), 2, 80).collect()}
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_minhash_hot_keys(spark, monkeypatch):
    """One group of near copies that holds most rows, dealt out over several tasks."""
    monkeypatch.setattr(minhash, "HOT", 3)
    monkeypatch.setattr(minhash, "SEEKERS", 8)
    rng = random.Random(16)
    base = prose(rng, 80).split()
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [prose(rng, 60) for _ in range(10)]
    comp, _ = brute_components(texts, 2, 80)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts), 2, 80).collect()}
    assert [got[i] for i in range(len(texts))] == comp


def test_minhash_templated_family(spark, monkeypatch):
    """A family that shares most of its text below the threshold, too large for a bucket: only its pairs that share something
    rare are compared, and all links are found."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "HOT", 20)
    rng = random.Random(23)
    word = lambda: rng.choice(WORDS) + rng.choice(WORDS) + str(rng.randrange(1000))
    template = [word() for _ in range(66)]
    texts = []
    for k in range(150):
        own = [word() for _ in range(36)]
        texts.append(" ".join(template + own))
        if k % 10 == 0:
            for n in (4, 11):  # one that is within the threshold, one that is not
                other = list(own)
                for j in rng.sample(range(36), n):
                    other[j] = word()
                texts.append(" ".join(template + other))
    seen = []
    plain = minhash.rare_shingles

    def watched(*args):
        out = plain(*args)
        seen.extend((r.n, r.id) for r in out.select("id", "n").collect())
        return out

    monkeypatch.setattr(minhash, "rare_shingles", watched)
    comp, _ = brute_components(texts, 2, 80)
    assert 10 <= sum(c != i for i, c in enumerate(comp)) < 40
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts), 2, 80).collect()}
    assert [got[i] for i in range(len(texts))] == comp
    assert seen and max(n for n, _ in seen) <= 3  # the template's shingles stand in no prefix


def test_minhash_rare_shingles_join_prefixes_only(spark, monkeypatch):
    """Of a large family's sets only the prefixes are joined by shingle, and any two within the threshold share one of these, also
    where shingles have to share counters."""
    rng = random.Random(29)
    template = [f"t{i}" for i in range(80)]
    texts = []
    for k in range(40):
        own = [f"o{k}x{i}" for i in range(20)]
        texts += [" ".join(template + own), " ".join(template + own[:-3] + [f"n{k}x{i}" for i in range(3)])]
    rng.shuffle(texts)
    docs = frame(spark, texts)
    members = docs.select(F.col("doc_id").alias("id"))
    sets = [minhash.Shingles(2)(t.text.encode()) for t in docs.orderBy("doc_id").collect()]
    close = {(i, j) for j in range(len(sets)) for i in range(j) if minhash.linked(sets[i], sets[j], 80)}
    assert len(close) >= 40
    joined, plain = [], minhash.dealt

    def watched(rows, *args):
        joined.append(rows.count())
        return plain(rows, *args)

    monkeypatch.setattr(minhash, "dealt", watched)
    prefixes = sum(len(s) - -(-80 * len(s) // 100) + 1 for s in sets)

    def shared():
        joined.clear()
        by = {}
        for r in minhash.rare_shingles(members, docs, 2, 80).collect():
            by.setdefault(r.key, set()).add(r.id)
        assert sum(joined) <= prefixes < sum(map(len, sets)) / 4
        return {(i, j) for ids in by.values() for i in ids for j in ids if i < j}

    assert shared() == close
    monkeypatch.setattr(minhash, "SLOTS", 16)
    assert shared() >= close


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 3), (10, 11), (11, 12), (12, 13), (13, 14), (14, 10)]
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 4: 4, 5: 4, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}


def test_quality_rules_base():
    rng = random.Random(8)
    for _ in range(100):
        words = [rng.choice(["a", "b", "cé", "d#", "e"]) for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", "\n", "\t", " "]) for w in words)
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        rep = {j for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expect = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), len(ws) < 10 or 100 * len(rep) > 20 * len(ws))
        assert quality_rules.base_rules(text.encode()) == expect


def test_quality_rules_verdict(spark):
    rng = random.Random(9)
    texts = [prose(rng, 200), " ".join(["word"] * 200), "".join(f"{rng.randrange(10**9):x} " for _ in range(5)) * 2, None, prose(rng, 5000)]
    assert [r.kept for r in quality_rules.judge(frame(spark, texts)).orderBy("doc_id").collect()] == [True, False, False, False, True]


def test_language_id(spark):
    docs = table(spark, SF, "documents")
    got = registry.QUERIES["op3_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    model = language_id.learn(language_id.training_rows(docs))
    rows = docs.where("n_chars > 300").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).where("lang in ('de', 'fr')").orderBy("lang").collect()
    mixed = frame(spark, [" ".join(" ".join(r.text.split()[:40]) for r in rows), "12 34", None])
    spans = language_id.label(mixed.select("doc_id", "text"), model).orderBy("doc_id").collect()
    assert {s.lang for s in spans[0].spans} >= {"de", "fr"} and len(spans[0].spans) <= 6
    assert [(r.lang_pred, r.score) for r in spans[1:]] == [("und", 0.0)] * 2


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    got = registry.QUERIES["op10_quality_classifier"](spark, sf).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert got and sum(r.quality == r.predicted for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_warc(spark):
    long = "<p>é" * 60_000
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "x"), (5, None, None), (3, "http://c/", ""), (4, "u r\nl", long), (4, "u r\nl", long), (9, "http://d/", long)], "page_id long, url string, html string")
    path = scratch(spark)
    warc.write_archive(pages, path, chunk=1000)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect())
    n = len(long.encode())
    assert got == [(1, 1, "revisit", 2), (2, 1, "response", None), (3, 0, "revisit", 5), (4, n, "revisit", 9), (4, n, "revisit", 9), (5, 0, "response", None), (9, n, "response", None)]
    rows = spark.read.parquet(path).where("page_id = 9").orderBy("chunk_no").collect()
    import zstandard

    whole = b"".join(zstandard.ZstdDecompressor().decompress(bytes(r.data)) for r in rows)
    head, _, body = whole.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\n") and body == long.encode() + b"\r\n\r\n" and len(rows) > 100


def test_html(spark):
    page = """<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">ok?</div><div class="banner-text">Big Site</div>
    <article><h1>Head &amp; line</h1><p>One <b>two<br>three<p>Four&nbsp;five <script>x</script><ul><li>a<li>b</ul><div class=comments><p>me too</div></article><aside>s</aside><footer>f"""
    root = html_extract.parse(page)
    assert html_extract.text_of(root, set()) == "Head & line\nOne two three\nFour five\na\nb"
    assert html_extract.text_of(html_extract.parse(""), set()) == ""
    # without articles, what is the same on a host's pages is template
    rows = [(i, f"http://h/{i}", f"<body><div class=top>Site name</div><div class=body><p>text {i}</p></div></body>") for i in range(8)] + [(8, None, None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r.text for r in got] == [f"text {i}" for i in range(8)] + [""]


def test_tree_matching():
    a, b = (html_extract.fold(html_extract.parse(x)) for x in ("<div><p>1<ul><li>2</ul><span>3</span></div>", "<div><h1>0</h1><p>1</p><span>4</span></div>"))
    assert [x.name for x, _ in sorted(html_extract.matched(a[0], b[0]), key=lambda p: p[0].number)] == ["#root.", "div.", "p.", "span."]


def test_decontaminate(spark):
    rng = random.Random(11)
    pair = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    items = [pair(40) for _ in range(20)] + [None, ""]
    texts = [pair(300) for _ in range(60)] + [None, ""]
    leaked = {}
    for d, i in ((3, 5), (10, 7), (20, 5)):
        w = texts[d].split()
        texts[d] = " ".join(w[:100] + items[i].split() + w[100:])
        leaked[d] = i
    para = items[9].split()
    for k in range(2, 40, 6):
        para[k] = "zz" + para[k]
    texts[30] = texts[30] + " " + " ".join(para)
    leaked[30] = 9
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, texts), bench).collect()} == set(leaked.items())
    assert decontaminate.clean(frame(spark, texts), bench).count() == len(texts) - 4


def test_lcs():
    rng = random.Random(12)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        bits = {}
        for k, w in enumerate(a):
            bits[w] = bits.get(w, 0) | 1 << k
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(bits, len(a), b) == t[-1][-1]


def test_awkward_tables(spark, awkward):
    n = awkward.count()
    for docs, rows in ((awkward, n), (awkward.where("doc_id < 0"), 0)):
        assert len(bpe.encode_documents(docs).collect()) == rows
        assert len(quality_rules.judge(docs).collect()) == rows
        assert len(minhash.near_duplicates(docs).collect()) == rows
        assert len(suffix_dedup.remove_repeats(docs).collect()) == rows
        assert len(quality_classifier.score(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), np.zeros(quality_classifier.SIZE + 1)).collect()) == rows
        path = scratch(spark)
        wavelet.write_shards(docs, path)
        assert len(wavelet.read_shards(spark, path).collect()) == rows
        model = language_id.learn(language_id.training_rows(docs))
        assert {r.lang_pred for r in language_id.label(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model).collect()} <= {"und"}
        bench = spark.createDataFrame([(1, "some words that nothing holds at all here")], "item_id long, text string")
        assert decontaminate.leaks(docs, bench).count() == 0
        assert decontaminate.leaks(docs, bench.where("item_id > 1")).count() == 0
        pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "key", "score")
        assert html_extract.extract(pages).count() == rows
        warc.write_archive(pages, path := scratch(spark))
        assert warc.read_archive(spark, path).count() == rows


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns and 0 < out.count() <= docs.count(), name
    assert set(P.run(spark, SF).columns) >= {"doc_id", "n_tokens"}


def test_decontaminate_large_benchmark(spark):
    """Verbatim copies of items of 15 to 59 words, among a benchmark of thousands, against a search for every item's words."""
    rng = random.Random(5)
    texts = [r.text for r in table(spark, LARGE, "documents").where("length(text) > 1500").orderBy("doc_id").limit(1500).collect()]
    words = [w for t in texts for w in t.split()]
    real = [r.text for r in table(spark, LARGE, "benchmark").orderBy("item_id").collect()]
    items = real + [" ".join(rng.choice(words) for _ in range(rng.randrange(15, 60))) for _ in range(2000 - len(real))]
    for d, i in enumerate(i for i in range(len(real)) for _ in range(3)):
        at = texts[d].split()
        k = rng.randrange(len(at))
        texts[d] = " ".join(at[:k] + items[i].split() + at[k:])
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    whole = [plain(t) for t in texts]
    brute = {(d, i) for i, x in enumerate(map(plain, items)) for d, t in enumerate(whole) if x in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    by_length = collections.Counter((len(items[i].split()) // 10 * 10, (d, i) in got) for d, i in brute)
    assert len(brute) >= 3 * len(real) and brute <= got, sorted(by_length.items())


def test_spark_hash(spark):
    from tapeworks.llm.common import spark_hash

    got = spark.range(-50, 50).selectExpr("id * 1234567890123 AS v").selectExpr("v", "xxhash64(v) AS h").collect()
    assert spark_hash(np.array([r.v for r in got])).tolist() == [r.h for r in got]


def test_suffix_dedup_of_one_id_and_of_none(spark, monkeypatch):
    """Different texts of one doc_id are documents of their own, by CRC; rows without an id stay whole and count for none."""
    monkeypatch.setattr(suffix_dedup, "SHARE", 500)
    rng = random.Random(14)
    shared = prose(rng, 40)
    texts = [shared + prose(rng, 30), prose(rng, 10) + shared, prose(rng, 20) + shared, shared, shared]
    ids = [2, 2, 1, None, None]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame_of(spark, ids, texts)).collect())
    order = sorted(range(3), key=lambda k: (ids[k], zlib.crc32(texts[k].encode())))
    want = [(ids[k], n, gone, sha) for k, (n, gone, _, sha) in zip(order, brute_repeats([texts[k] for k in order]))]
    want += [(None, len(shared), 0, hashlib.sha256(shared.encode()).hexdigest())] * 2
    assert got == collections.Counter(want)
    assert sum(r[2] > 100 for r in want) == 2


def frame_of(spark, ids, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], DOCS)


def test_token_look_ups(spark):
    rng = random.Random(15)
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(150)]
    wavelet.write_shards(frame(spark, texts), path := scratch(spark), shard=400)
    assert spark.read.parquet(path).count() > 5
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    docs = [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]
    flat = [(x, d, at) for d, ids in enumerate(docs) for at, x in enumerate(ids)]
    common = collections.Counter(x for x, _, _ in flat).most_common(40)
    ids = [2, common[0][0], common[20][0], common[-1][0], 48_000, 70_000]
    assert {r.id: r.n for r in wavelet.count_ids(spark, path, ids).collect()} == {x: sum(x == y for y, _, _ in flat) for x in ids}
    want = sorted((x, k, d, at) for k, (x, d, at) in enumerate(flat) if x in ids)
    assert sorted(tuple(r) for r in wavelet.locate_ids(spark, path, ids).collect()) == want
    places = [0, 1, 777, len(flat) - 1, len(flat), 10**12]
    assert {r.place: r.id for r in wavelet.access(spark, path, places).collect()} == {p: flat[p][0] for p in places if p < len(flat)}


def test_planes_are_inflated_when_asked_for():
    m = wavelet.WaveletMatrix.of(np.arange(1000) % 100 + 1000)
    packed = wavelet.WaveletMatrix.from_bytes(m.to_bytes(), m.planes)
    assert packed.count(3) == 0 and isinstance(packed._bits[-1], memoryview)
    assert packed.select(1007, 3) == 307 and packed.locate(1007) == list(range(7, 1000, 100))
