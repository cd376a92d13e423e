"""HTML extraction by wrapper induction.

1. Each page is read into a DOM tree and folded: block elements of one tag and class that stand side by side (or below folded
   ones) are one node, in order of first appearance; a node keeps a hash and the length of each of its blocks' texts, in
   which inline elements are text.
2. Of each host's distinct trees, the one with most nodes (ties: the least tree) is the host's exemplar.
3. Each distinct tree of the host is aligned with it by simple tree matching: the largest set of node pairs of equal tag and
   class that keeps parents and order. For each exemplar node the trees that have it are counted, and for each
   text in it the trees that have that text there, as partial sums.
4. Constant text is template: what at least two trees, and `CONSTANT` of those that have the node, hold at one node. The rest
   varies. From the root of the exemplar, the way leads down to the content slot: to the child below which an article or
   else the highest varying heading stands, if it has `HEADED` of the varying text, or else to the one that has `MOST` of it; an article ends the
   way, and so does a varying heading among the children. What varies beside the way is none of the article: teasers, readers'
   answers, lists of news. Within the slot, text that pages share stays (a passage, the head of a table, a label), but for
   blocks without a prose element's tag (`PROSE`) below which nothing varies on any page.
5. A page's text is that of its nodes that are aligned with the content slot, without template text. Varying elements in it that
   are no part of an article go by what they are: menus, headers without a heading, footers, sidebars, forms, notices, adverts, reader
   comments (`DROP_TAGS`, `DROP_ROLES`, `DROP_NAMES`).
6. A page without such a slot (its host has one distinct tree, or it is not aligned with the slot) goes by element rules: the
   text of its articles (`article`, `main`, or a node whose role says so), less boilerplate elements and lists of links. Where it
   has none, the same way leads down its own tree, all its text taken as varying.

Blocks are joined in page order by one line feed; white space in a block is one space; character references are decoded.
A null or empty html, or one without text, gives the empty text. Pages without host share one that is empty. Pages of any
length and depth are read whole, unclosed and stray tags are mended as browsers do in the main cases; repeated rows give
repeated results; an empty table gives an empty table; other columns are ignored. A row of a null page_id is kept.
Hosts with a large share of the pages are dealt out over several tasks.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeworks.llm.common import HOT, blocks, dealt, each_deal, hot_keys, spread, table, written

CONSTANT, MOST, HEADED = 0.7, 0.75, 0.3
#: Names of elements and of classes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template svg iframe xmp".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "option": {"select"}}
P_SCOPE = {"article", "aside", "main", "section", "div", "td", "th", "li", "body", "html", "blockquote", "nav", "footer", "header", "form", "figure", "button", "table"}
DROP_TAGS = set("head script style noscript template svg iframe nav aside footer form button select input textarea dialog menu object canvas audio video map title".split())
DROP_NAMES = set("ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar widget related recommended share sharing social comment comments disqus replies footer header masthead login signup subscribe toolbar pagination pager skip".split())
#: What may follow one of these names in a class or id that names a part of the page: comment-list, but not share-price.
PARTS = set("area bar block body box button buttons container content form frame footer header inner item items link links list msg message notice panel popup row section slot text thread top unit widget wrap wrapper".split())
DROP_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = HEADINGS | set("p li dt dd td th caption blockquote pre figcaption summary address article main body html #root".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "article")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.parent, self.items, self.article = tag, attrs or {}, parent, [], False

    def children(self):
        return [x for x in self.items if isinstance(x, Node)]


def parse(page: str) -> Node:
    """The DOM tree of a page: items of a node are its texts and child nodes in page order."""
    root = now = Node("#root")
    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            now.items.append(page[at:])
            break
        if m.start() > at:
            now.items.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            node = now
            while node.parent and node.tag != tag:
                node = node.parent
            if node.parent:
                now = node.parent
            continue
        if tag in ENDS_P:
            now = _closed(now, {"p"}, P_SCOPE)
        if tag in SCOPES:
            now = _closed(now, {"td", "th"} if tag in ("td", "th") else {"dd", "dt"} if tag in ("dd", "dt") else {tag}, SCOPES[tag])
        attrs = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3].strip(" /\n\t\r") else {}
        node = Node(tag, attrs, now)
        now.items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            now = node
        if tag in ("article", "main") or attrs.get("role") in ("article", "main"):
            x = node
            while x and not x.article:
                x.article, x = True, x.parent
    return root


def _closed(now: Node, tags: set[str], scope: set[str]) -> Node:
    """Where a new element goes: beside an open element of `tags` that is not beyond one of `scope`."""
    node = now
    while node.parent and node.tag not in scope:
        if node.tag in tags:
            return node.parent
        node = node.parent
    return now


def signature(node: Node) -> str:
    return node.tag + "." + ".".join(sorted(node.attrs.get("class", "").split()))


def split(node: Node) -> tuple[str, list[Node]]:
    """A block's own text, its strings and those of inline elements in it; and the blocks in it. An inline element beside
    blocks counts as a block."""
    among = any(c.tag in BLOCK for c in node.children())
    out, inner, stack = [], [], [(x, among) for x in reversed(node.items)]
    while stack:
        x, beside = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append(" ")
        elif x.tag in RAW or x.tag in VOID:
            continue
        elif x.tag in BLOCK or beside:
            inner.append(x)
        else:
            stack += [(c, False) for c in reversed(x.items)]
    return " ".join(entities.unescape("".join(out)).split()), inner


class Folded:
    """Like siblings as one node: what the alignment works on. texts: hash and length of each block's text."""

    __slots__ = ("name", "nodes", "children", "texts", "number")

    def __init__(self, name: str, nodes: list[Node], texts: list[tuple[int, int]]):
        self.name, self.nodes, self.children, self.texts, self.number = name, nodes, [], texts, -1


def text_hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode(errors="replace")) >> 1


def fold(root: Node) -> list[Folded]:
    """All folded nodes in pre-order; the first is the root."""
    top = Folded("#root.", [root], [])
    out, stack = [], [top]
    while stack:
        f = stack.pop()
        f.number = len(out)
        out.append(f)
        like: dict[str, list[Node]] = {}
        for n in f.nodes:
            words, inner = split(n)
            if words:
                f.texts.append((text_hash(words), len(words)))
            for c in inner:
                like.setdefault(signature(c), []).append(c)
        f.children = [Folded(k, v, []) for k, v in like.items()]
        stack += reversed(f.children)
    return out


def packed(nodes: list[Folded]) -> str:
    """A folded tree as text: a line for each node, with its depth, its texts and its name."""
    lines, stack = [], [(nodes[0], 0)]
    while stack:
        f, d = stack.pop()
        lines.append(f"{d} {','.join(f'{h:x}:{n}' for h, n in f.texts)} {f.name}")
        stack += [(c, d + 1) for c in reversed(f.children)]
    return "\n".join(lines)


def unpacked(text: str) -> list[Folded]:
    out, path = [], []
    for line in text.split("\n"):
        depth, words, name = line.split(" ", 2)
        f = Folded(name, [], [(int(h, 16), int(n)) for h, _, n in (w.partition(":") for w in words.split(",") if w)])
        f.number = len(out)
        out.append(f)
        del path[int(depth) :]
        if path:
            path[-1].children.append(f)
        path.append(f)
    return out


def heaviest(places: list[int], weights: list[int]) -> list[int]:
    """The rising subsequence of (distinct) places with the largest weight, as indices: sums of the best ending at or before
    each place are kept in a Fenwick tree."""
    order = {p: k + 1 for k, p in enumerate(sorted(places))}
    tree, before, best = [(0, -1)] * (len(places) + 1), [], (0, -1)
    for i, p in enumerate(places):
        k, top = order[p] - 1, (0, -1)
        while k:
            top, k = max(top, tree[k]), k & (k - 1)
        before.append(top[1])
        now, k = (top[0] + weights[i], i), order[p]
        best = max(best, now)
        while k < len(tree):
            tree[k], k = max(tree[k], now), k + (k & -k)
    out, i = [], best[1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def matched(a: Folded, b: Folded) -> list[tuple[Folded, Folded]]:
    """Simple tree matching: node pairs of the largest matching of two trees of the same name at the root. As children of
    a folded node have different names, each has one possible partner, so the pairs to be weighed are no more than the nodes."""
    pairs, parent = [(a, b)], [-1]
    for k, (x, y) in enumerate(pairs):  # grows
        at = {c.name: c for c in y.children}
        for c in x.children:
            if c.name in at:
                pairs.append((c, at[c.name]))
                parent.append(k)
    inside: list[list[int]] = [[] for _ in pairs]
    for k, p in enumerate(parent):
        if p >= 0:
            inside[p].append(k)
    size = [1] * len(pairs)
    for k in range(len(pairs) - 1, -1, -1):
        if inside[k]:
            inside[k] = [inside[k][i] for i in heaviest([pairs[j][1].number for j in inside[k]], [size[j] for j in inside[k]])]
            size[k] += sum(size[j] for j in inside[k])
    out, stack = [], [0]
    while stack:
        k = stack.pop()
        out.append(pairs[k])
        stack += reversed(inside[k])
    return out


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether an element is, by what it is called, no part of an article. inside: it stands in the content."""
    if node.article and not (node.tag in ("article", "main") and inside):
        return False  # an article stands in it: an unclosed element around it doesn't take it away
    if node.tag in DROP_TAGS:
        return True
    if node.tag == "header":
        return not (inside and any(c.tag in HEADINGS for c in node.children()))
    return bool(node.attrs) and (node.attrs.get("role") in DROP_ROLES or node.tag not in HEADINGS | {"p", "body", "html"} and _named(node.attrs))


def _named(a: dict) -> bool:
    """A class or the id is one of DROP_NAMES, or one of these and then only PARTS."""
    for token in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        first, *rest = [x for x in re.split(r"[^a-z]+", token) if x] or [""]
        if first in DROP_NAMES and PARTS.issuperset(x for x in rest if x not in DROP_NAMES):
            return True
    return False


def links_only(node: Node) -> bool:
    """A list (or a block that is one) of links alone."""
    if node.tag not in ("ul", "ol", "div", "section"):
        return False
    links, stack = 0, [(node, False)]
    while stack:
        n, linked = stack.pop()
        for x in n.items:
            if isinstance(x, str):
                if x.strip() and not linked:
                    return False
            elif x.tag == "a":
                links += 1
                stack.append((x, True))
            else:
                stack.append((x, linked))
    return links > 1


def text_of(root: Node, template: set[int] = frozenset(), content: list[Node] | None = None) -> str:
    """The text of the content nodes, or by element rules that of the page; template: ids of blocks whose own text is the
    host's."""
    out, block = [], []

    def flush():
        words = " ".join(entities.unescape("".join(block)).split())
        if words:
            out.append(words)
        block.clear()

    #: (item, in the content, its block's own text goes, leave: a block ends here)
    stack = [(root, False, False, False)] if content is None else [(x, True, False, False) for x in reversed(content)]
    tops = set(map(id, content or []))
    while stack:
        x, inside, gone, leave = stack.pop()
        if leave:
            flush()
            continue
        if isinstance(x, str):
            block.append("" if gone else x)
            continue
        if x.tag in RAW or x.tag in VOID - {"br", "hr"}:
            continue
        if id(x) not in tops and (boilerplate(x, inside) or (not inside and not x.article and links_only(x))):
            continue
        article = inside or x.tag in ("article", "main") or x.attrs.get("role") in ("article", "main")
        if x.tag in ("br", "hr"):
            block.append(" ")
        if x.tag in BLOCK or id(x) in tops:
            flush()
            stack.append((None, False, False, True))
            gone = False
        gone = gone or id(x) in template
        # beside an article, only what leads to one
        items = x.items if article or not root.article else [c for c in x.items if isinstance(c, Node) and c.article]
        stack += [(c, article, gone, False) for c in reversed(items)]
    flush()
    return "\n".join(out)


def _arrow(rows, names, types):
    import pyarrow as pa

    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)


def votes(trees, model: list[Folded], held: dict[tuple[int, int], list[int]]) -> None:
    """Add to held, by (exemplar node, text): trees that have the text there, and its length; under text -1, trees that have the node."""
    for tree in trees:
        for x, y in matched(unpacked(tree)[0], model[0]):
            for h, n in {(-1, 0), *x.texts}:
                held.setdefault((y.number, h), [0, n])[0] += 1


def wrapper(tree: str, rows: list[tuple[int, int, int, int]]) -> tuple[int, list[int]]:
    """The content slot's node number (-1: none) and the template, as node numbers and hashes in turn, from an exemplar and its
    votes (node, text, trees, length)."""
    model = unpacked(tree)
    have = {node: n for node, h, n, _ in rows if h == -1}
    total = max(have.values(), default=0)
    if total < 2:
        return -1, []
    constant, mass = [], [0] * len(model)
    for node, h, n, size in rows:
        if h != -1:
            if n >= 2 and n >= CONSTANT * have[node]:
                constant.append((node, h))
            else:
                mass[node] += n * size
    at, below = slot_of(model, mass)
    if at < 0:
        return -1, []
    varies = list(mass)
    for k in range(len(model) - 1, 0, -1):
        varies[below[k][0]] += varies[k]
    inner = lambda node: at <= node <= below[at][1]
    generic = lambda node: node != at and model[node].name.split(".")[0] not in PROSE and not varies[node]
    kept = [(k, h) for k, h in constant if not inner(k) or generic(k)]
    return at, [x for pair in sorted(kept) for x in pair]


def slot_of(model: list[Folded], own: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """The content slot's node number (-1: none), and of each node its parent and the last node below it; own: varying text of
    each node."""
    parent, last, mass, top = [-1] * len(model), list(range(len(model))), list(own), [7] * len(model)
    for f in model:
        for c in f.children:
            parent[c.number] = f.number
    tags = [f.name.split(".")[0] for f in model]
    for k in range(len(model) - 1, 0, -1):
        element = Node(tags[k], {"class": model[k].name.partition(".")[2].replace(".", " ")})
        if tags[k] in HEADINGS and own[k]:
            top[k] = int(tags[k][1])
        if tags[k] in ("article", "main") and mass[k]:
            top[k] = 0
        if boilerplate(element, False):
            mass[k], top[k] = 0, 7
        up = parent[k]
        mass[up] += mass[k]
        top[up] = min(top[up], top[k])
        last[up] = max(last[up], last[k])
    at = 0
    while mass[at] and tags[at] != "article":
        inside = model[at].children
        if any(own[c.number] for c in inside if c.name.split(".")[0] in HEADINGS):
            break
        best = max(inside, key=lambda c: mass[c.number], default=None)
        headed = max((c for c in inside if top[c.number] == top[at] < 7), key=lambda c: mass[c.number], default=None)
        if headed is not None and headed.children and mass[headed.number] >= HEADED * mass[at]:
            best = headed
        elif best is None or not best.children or mass[best.number] < MOST * mass[at]:
            break
        at = best.number
    return (at if mass[at] else -1), list(zip(parent, last))


def induce(pages: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """host, exemplar (its folded tree), slot and template of every host whose pages (id, host, html) have several trees."""
    import pyarrow as pa

    def skeletons(batches):
        for batch in blocks(batches, 2_000_000, "html"):
            rows = []
            for host, page in zip(*(batch.column(c).to_pylist() for c in ("host", "html"))):
                nodes = fold(parse(page))
                rows.append((host, len(nodes), packed(nodes)))
            yield _arrow(rows, ["host", "n", "tree"], [pa.string(), pa.int32(), pa.string()])

    # equal trees are one: a page's copies don't make its text constant
    trees = pages.mapInArrow(skeletons, "host string, n int, tree string").withColumn("id", F.xxhash64("tree"))
    trees = written(trees.groupBy("host", "id", F.xxhash64("tree", F.lit(1)).alias("id2")).agg(F.first("n").alias("n"), F.first("tree").alias("tree")))
    exemplar = written(trees.groupBy("host").agg(F.max_by("tree", F.struct("n", "tree")).alias("exemplar"), F.count(F.lit(1)).alias("trees")).where("trees > 1"))

    def align(batches):
        held, last, model = {}, None, None
        for batch in batches:
            for host, tree, example in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "exemplar"))):
                if example != last:
                    last, model = example, unpacked(example)
                votes([tree], model, held.setdefault(host, {}))
            if sum(map(len, held.values())) > 200_000:
                yield from send(held)
                held = {}
        yield from send(held)

    def send(held):
        rows = [(host, k, h, n, size) for host, counts in held.items() for (k, h), (n, size) in counts.items()]
        yield _arrow(rows, ["host", "node", "text", "n", "size"], [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])

    def decide(batches):
        for batch in batches:
            rows = []
            for host, tree, found in zip(*(batch.column(c).to_pylist() for c in ("host", "exemplar", "found"))):
                slot, template = wrapper(tree, [(r["node"], r["text"], r["n"], r["size"]) for r in found])
                rows.append((host, tree, slot, template))
            yield _arrow(rows, ["host", "exemplar", "slot", "template"], [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())])

    pair = dealt(trees.select("host", "id", "tree"), hot, "host", "id").join(written(each_deal(exemplar.select("host", "exemplar"), hot, "host")), ["host", "deal"])
    counted = pair.mapInArrow(align, "host string, node int, text long, n long, size long").groupBy("host", "node", "text").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    # a text of one tree varies: these are added up first, as one row for each node
    once = F.col("n") == 1
    some = counted.groupBy("host", "node", F.when(~once | (F.col("text") == -1), F.col("text")).alias("text")).agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.sum(F.col("n") * F.col("size")).alias("mass"))
    some = written(some)
    have = some.where("text = -1").select("host", "node", F.col("n").alias("have"))
    told = dealt(some, hot, "host", F.coalesce("text", F.lit(0))).join(each_deal(have, hot, "host"), ["host", "node", "deal"])
    told = told.withColumn("text", F.when((F.col("text") == -1) | (F.col("n") >= CONSTANT * F.col("have")), F.col("text")))
    few = told.groupBy("host", "node", "text").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.sum("mass").alias("mass"))
    varies = F.col("text").isNull()
    row = F.struct("node", F.coalesce("text", F.lit(-2)).alias("text"), F.when(varies, 1).otherwise(F.col("n")).alias("n"), F.when(varies, F.col("mass")).otherwise(F.col("size")).alias("size"))
    of_host = few.groupBy("host").agg(F.collect_list(row).alias("found"))
    return exemplar.join(of_host, "host").select("host", "exemplar", "found").mapInArrow(decide, "host string, exemplar string, slot int, template array<long>").where("slot >= 0")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    import pyarrow as pa

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[^:/?#]*:?//([^/?#:]*)", 1)), F.lit(""))
    full = spread(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")), "page_id").withColumn("host", host)
    hot = hot_keys(written(full.groupBy("host").agg(F.count(F.lit(1)).alias("n"))), "host", HOT)
    wrappers = written(induce(full.select("host", "html"), hot))

    def read(batches):
        last, model, known = None, None, set()
        for batch in blocks(batches, 2_000_000, "html"):
            rows = []
            for i, url, page, example, slot, template in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "exemplar", "slot", "template"))):
                root, content, fixed = parse(page), None, set()
                if example is not None:
                    if (example, template) != last:
                        last, model, known = (example, template), unpacked(example), set(zip(template[::2], template[1::2]))
                    for x, y in matched(fold(root)[0], model[0]):
                        if y.number == slot:
                            content = x.nodes
                        if known:
                            fixed.update(id(n) for n in x.nodes if (y.number, text_hash(split(n)[0])) in known)
                if content is None and not root.article:
                    own = fold(root)
                    slot_here, _ = slot_of(own, [sum(n for _, n in f.texts) for f in own])
                    content = own[slot_here].nodes if slot_here > 0 else None
                text = text_of(root, fixed, content)
                rows.append((i, url, text, len(text)))
            yield _arrow(rows, ["page_id", "url", "text", "n_chars"], [pa.int64(), pa.string(), pa.string(), pa.int64()])

    named = dealt(full, hot, "host", F.coalesce("page_id", F.xxhash64("html")))
    return named.join(written(each_deal(wrappers, hot, "host")), ["host", "deal"], "left").mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
