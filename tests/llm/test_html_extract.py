"""Wrapper induction: planted templates, tree matching against brute force, pages where names mislead."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from tapeworks.llm import html_extract as H
from tapeworks.llm.common import table

SCHEMA = "page_id long, url string, html string"


def extracted(spark, rows):
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def brute_size(a, b):
    """Size of the largest matching of two trees with equal roots: simple tree matching's recursion, as it is defined."""

    @functools.cache
    def size(x, y):
        if x[0] != y[0]:
            return 0
        m = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
        for i, c in enumerate(x[1]):
            for j, d in enumerate(y[1]):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + size(c, d))
        return 1 + m[-1][-1]

    return size(a, b)


def test_tree_matching_against_brute_force():
    rng = random.Random(1)

    def tree(depth):
        names = rng.sample("abcdefg", rng.randrange(0, 5)) if depth else []
        return tuple((n, tree(depth - 1)) for n in names)

    def folded(name, children, out):
        f = H.Folded(name, [], [])
        f.number = len(out)
        out.append(f)
        f.children = [folded(n, c, out) for n, c in children]
        return f

    for _ in range(300):
        x, y = tree(3), tree(3)
        a, b = folded("r", x, []), folded("r", y, [])
        pairs = H.matched(a, b)
        assert len(pairs) == brute_size(("r", x), ("r", y))
        assert all(p.name == q.name for p, q in pairs)
        assert len({p.number for p, _ in pairs}) == len({q.number for _, q in pairs}) == len(pairs)




def test_wrapper_finds_the_slot_without_article(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) + str(rng.randrange(99)) for _ in range(n))
    rows, want = [], {}
    for i in range(8):
        h, a, b, side = words(4), words(30), words(20), words(3)
        html = f"""<body><div class=q>Site name</div><ul class=m><li><a href=x>{words(1)}</a></ul><div class=k><h2>{h}</h2><p>{a}</p><div class=zz>Read us daily</div><p>{b} <b>always</b></p></div>
        <div class=r>{side}</div><div class=w>All rights</div></body>"""
        rows.append((i, f"http://h/{i}", html))
        want[i] = f"{h}\n{a}\n{b} always"
    assert extracted(spark, rows) == want


PARTS = [
    ("<p>{}</p>", 30), ("<p>{} <em>more</em></p>", 20), ("<ul><li>{}</li></ul>", 8), ("<blockquote>{}</blockquote>", 12), ("<pre>{}</pre>", 6),
]
SHARED = '<table><tr><th>Price</th><th>Size</th></tr><tr><td>{}</td><td>{}</td></tr></table><dl><dt>Colour</dt><dd>{}</dd></dl><p>The committee met on Monday and agreed the following.</p><blockquote>All shall have prizes, said the chair.</blockquote>'


def shared_text(a, b, c):
    return ["Price", "Size", a, b, "Colour", c, "The committee met on Monday and agreed the following.", "All shall have prizes, said the chair."]


@pytest.mark.parametrize("pages", [2, 4, 8])
@pytest.mark.parametrize("box", ["article", "div class=content"])
def test_text_of_made_up_hosts(spark, pages, box):
    """Pages of many layouts whose text is known by construction: passages, table heads and labels that a host's pages share stay on
    hosts of any size; varying teasers and readers' answers beside the slot go, by no name that the rules list."""
    rng = random.Random(pages)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(999))
    words = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for host in range(6):
        wrap = rng.randrange(3)
        for k in range(pages):
            title, blocks, lines = words(5), [], []
            for _ in range(rng.randrange(3, 7)):
                form, n = rng.choice(PARTS)
                t = words(n)
                blocks.append(form.format(t))
                lines.append(t + " more" if "<em>" in form else t)
            cells = [words(2) for _ in range(3)]
            at = rng.randrange(len(blocks) + 1)
            blocks.insert(at, SHARED.format(*cells))
            lines[at:at] = shared_text(*cells)
            content = f"<{box}><h1>{title}</h1>{''.join(blocks)}</{box.split()[0]}>"
            page = f"<div class=brand>The daily thing {host}</div><div class=row>{content}<div class=teaser>{words(40)}</div></div><div class=responses>{''.join(f'<p>{words(9)}</p>' for _ in range(k % 3))}</div><div class=legal>(c) all rights</div>"
            page = "<div>" * wrap + page + "</div>" * wrap
            i = host * 100 + k
            rows.append((i, f"http://host{host}/{k}", f"<html><body>{page}</body></html>"))
            want[i] = "\n".join([title, *lines])
    assert extracted(spark, rows) == want


def test_one_page_of_a_host_without_an_article(spark):
    html = "<body><div class=a>Home About</div><div class=b><h1>Title</h1><p>Some words of the page.</p><p>And more of them.</p></div><div class=c>(c) all rights</div></body>"
    assert extracted(spark, [(1, "http://alone/", html)]) == {1: "Title\nSome words of the page.\nAnd more of them."}


def test_constant_headings_and_words_in_a_paragraph_stay(spark):
    rows = [(i, f"http://h/{i}", f"<article><h1>Report</h1><p><b>Rome:</b> text {i} {'of some length ' * 4}</p><div class=zz>Join now</div></article>") for i in range(6)]
    rows += [(7, "http://two/1", "<article><p>shared words</p><p>one</p></article>"), (8, "http://two/2", "<article><p>shared words</p><p>two</p></article>")]
    got = extracted(spark, rows)
    assert got[3] == f"Report\nRome: text 3 {'of some length ' * 4}".strip()
    assert got[7] == "shared words\none"


def test_names_that_mislead(spark):
    html = """<article><div class="article-header">Standfirst</div><p class="share-price">The share price fell</p><div class="share-buttons">Like</div><div class="comment-list"><p>me too</p></div>
    <div hidden>kept</div><aside>out</aside><footer>out</footer><form><p>out</p></form></article>"""
    assert H.text_of(H.parse(html)) == "Standfirst\nThe share price fell\nkept"


def test_deep_pages_and_one_host_with_most_pages(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT", 4)
    deep = lambda i: "<div>" * 3000 + f"<div class=name>Big site</div><div class=body><p>text {i} of the page</p><p>more {i}</p></div>" + "</div>" * 3000
    rows = [(i, f"http://h/{i}", deep(i)) for i in range(12)] + [(20 + i, f"http://other{i}/", f"<p>only {i}") for i in range(4)]
    got = extracted(spark, rows)
    assert got == {i: f"text {i} of the page\nmore {i}" for i in range(12)} | {20 + i: f"only {i}" for i in range(4)}


def test_copies_of_a_page_are_one_tree(spark):
    rows = [(i, "http://h/", "<body><p>the very same text</p></body>") for i in range(9)] + [(None, "http://h/", "<body><p>the very same text</p></body>"), (11, None, None), (12, None, "")]
    got = H.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text for r in got) == ["", ""] + ["the very same text"] * 10


def test_wrapper_alone_gives_the_given_pages(spark, monkeypatch):
    """The slot decides: without any rule on tags, roles and names the texts are the same."""
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    ruled = {r.page_id: r.text for r in H.extract(pages).collect()}
    root = H.wrapper
    for name in ("DROP_TAGS", "DROP_NAMES", "DROP_ROLES"):
        monkeypatch.setattr(H, name, set())
    slots = H.induce(pages.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1)).select("host", "html"))
    assert root and slots.count() > 0
    assert {r.page_id: r.text for r in H.extract(pages).collect()} == ruled
