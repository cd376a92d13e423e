"""Exact dedup, fill-in-the-middle and the Merkle manifest against brute force, and on awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F, types as T

from tapeworks.llm import exact_dedup, fill_in_middle, merkle, registry

DOCS = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
WORDS = "alpha beta ÄÖ 日本語 😀😀 x yy\x85z \xa0nb <P > a<b".split(" ")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", "\t\r\n", "\x0b\x0c"]) for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns that the operators use inside."""
    rng = random.Random(7)
    long = words(rng, 40_000)
    texts = [None, "", " ", "\n \t", "a", "a ", "a\n\n", long, long, "has <S> in it", "😀", "b"] + [words(rng, rng.randrange(60)) for _ in range(150)]
    rows = [(i, t, rng.choice([None, "en"]), rng.choice([None, "", "s0", "s1", "é"]), rng.choice([None, 3])) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], rows[30], (None, "a", None, None, None), (None, "b", "en", "s0", 1), (None, "only here", None, None, None), (None, "only here", None, None, None), (31, "other text of one id", "en", "s1", 2)]
    rng.shuffle(rows)
    clash = {c: F.lit("x") for c in ("row", "digest", "first", "size", "n", "idx", "tree", "hash", "run", "path", "_key", "_again", "form", "end", "key")}
    return rows, spark.createDataFrame(rows, DOCS).withColumns(clash)


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_dedup(rows):
    """Of each group its least id, size and digest; rows of one id and text can't be told apart, so as a multiset."""
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[plain(t)].append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), k == 0, sha(t)) for k, i in enumerate(ids)]
    return collections.Counter(out)


@pytest.mark.parametrize("least", [1, 64])
def test_exact_dedup(spark, monkeypatch, least):
    monkeypatch.setattr(exact_dedup, "LEAST", least)
    rows, df = awkward(spark)
    rows = rows + [(1000 + i, "one  text", "en", "s0", 1) for i in range(90)]
    df = df.unionByName(spark.createDataFrame(rows[-90:], DOCS), allowMissingColumns=True).repartition(5)
    got = exact_dedup.exact_duplicates(df)
    assert collections.Counter(map(tuple, got.collect())) == brute_dedup(rows)
    stay = exact_dedup.without_duplicates(df)
    assert stay.columns == df.columns
    kept = collections.Counter((k[0], k[4]) for k, n in brute_dedup(rows).items() if k[3] for _ in range(n))
    assert collections.Counter((r.doc_id, sha(plain(r.text))) for r in stay.collect()) == kept


def test_exact_dedup_of_repeated_rows_of_a_frequent_text(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST", 2)
    df = spark.createDataFrame([(5, "same", None, None, None)] * 40 + [(9, "same", None, None, None), (None, "same", None, None, None)], DOCS)
    assert exact_dedup.exact_duplicates(df).where("kept").count() == 1
    assert [r.doc_id for r in exact_dedup.without_duplicates(df).collect()] == [5]


def test_misra_gries_finds_every_frequent_value(spark):
    rng = random.Random(4)
    values = [b"%d" % int(rng.paretovariate(0.6)) for _ in range(30_000)]
    df = spark.createDataFrame([(bytearray(v),) for v in values], "digest binary").repartition(6)
    n, k = collections.Counter(values), 40
    got = {bytes(r.digest): r.n for r in exact_dedup.misra_gries(df, k).collect()}
    slack = len(values) / (k + 1)
    assert all(n[v] - slack <= got.get(v, 0) <= n[v] for v in n)
    assert sum(c > slack for c in n.values()) >= 3


def brute_fim(i, text, seed="42", cut=50, spm=80):
    text = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = [int(sha(f"{seed}:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return len(u), "plain", None, None, text
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("cut, spm", [(50, 80), (100, 50)])
def test_fill_in_middle(spark, cut, spm):
    rows, df = awkward(spark)
    made = fill_in_middle.fill_in_middle(df, "7", cut, spm)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert collections.Counter(map(tuple, made.collect())) == collections.Counter((i, *brute_fim(i, t, "7", cut, spm)) for i, t, *_ in rows)
    back = made.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("t"))
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter((i, t or "") for i, t, *_ in rows)
    assert {r.form for r in made.collect()} == {"plain", "spm", "psm"}


def brute_merkle(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, (r[0], r[3], r[2], r[4], r[1]))))

    def climb(nodes):
        """The last node, and each leaf's steps: digests before and after."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for s, k in zip(steps, range(len(steps))):
                lo = at[k] // 16 * 16
                run = nodes[lo : lo + 16]
                s.append((run[: at[k] - lo], run[at[k] - lo + 1 :]))
                at[k] //= 16
            nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        return (nodes[0] if nodes else None), steps

    trees = collections.defaultdict(list)
    for r in rows:
        trees["" if r[3] is None else "=" + r[3]].append(r)
    names = sorted(trees, key=str.encode)
    tops, own = [], {}
    for n in names:
        trees[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, own[n] = climb([leaf(r) for r in trees[n]])
        tops.append(top)
    root, over = climb(tops)
    out = []
    for n, top, up in zip(names, tops, over):
        for r, s in zip(trees[n], own[n]):
            other = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                other = (r[0], r[1].translate({c: c + 32 for c in range(65, 91)}), *r[2:])
            acc = leaf(other)
            for before, after in s + up:
                acc = sha("".join([*before, acc, *after]))
            out.append((r[0], leaf(r), top, root, sha("".join(x for b, a in s + up for x in b + a)), acc, acc == root))
    return collections.Counter(out)


def test_merkle(spark, tmp_path):
    rng = random.Random(9)
    rows, _ = awkward(spark)
    rows = rows + [(2000 + i, rng.choice(["Text", "text", None]), None, "hot", i) for i in range(600)] + [(5000, "Alone", None, "lone", 1)] + [(6000 + i, "T", None, f"z{i}", 1) for i in range(20)]
    for k, n in enumerate((2, 16, 17, 257)):  # runs of one node at the end of a level
        rows += [(10_000 * (k + 1) + i, "Ab", None, f"of {n}", 1) for i in range(n)]
    clash = {c: F.lit("x") for c in ("tree", "n", "idx", "hash", "row", "part", "run", "path", "top", "name", "key")}
    spark.createDataFrame(rows, DOCS).withColumns(clash).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = collections.Counter(map(tuple, merkle.op13_merkle(spark, f"file://{tmp_path}").collect()))
    want = brute_merkle(rows)
    assert got == want
    assert {k[6] for k in want} == {True, False}


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    empty.write.parquet(f"file://{tmp_path}/documents.parquet")
    for name in ("op11_exact_dedup", "op12_fill_in_middle", "op13_merkle"):
        assert registry.QUERIES[name](spark, f"file://{tmp_path}").count() == 0
    assert exact_dedup.without_duplicates(empty).count() == 0
    one = spark.createDataFrame([(1, "Ab", None, None, None)], DOCS)
    one.write.parquet(f"file://{tmp_path}/one/documents.parquet")
    assert collections.Counter(map(tuple, merkle.op13_merkle(spark, f"file://{tmp_path}/one").collect())) == brute_merkle([(1, "Ab", None, None, None)])


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_fill_in_middle", "op13_merkle"])
def test_queries_equal_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = registry.QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.SQL[name]})").fetchall()
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
