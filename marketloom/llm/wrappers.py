"""Main text of pages by wrapper induction over same-host pages.

1. Up to SAMPLE pages of a host are parsed and their trees (siblings of one label taken together) aligned one after
   another by simple tree matching into the host's wrapper tree, which only names nodes.
2. Every page is aligned with it. A block that SHARE of the pages with its node, and LEAST of them, have there word for
   word is template, over all pages of the host.
3. What is left is summed by node over all pages, copies included: pages, text length and its variance, share of link text, children
   of one label. From the root the wrapper goes down into the child that varies most, as long as one child does, and
   stops where children of one label repeat, text stands on its own, or an article element is reached: that node is
   the content slot. Constant structure round it (menus, adverts, footers ...) is template even if its words change.
4. Text is the slot's blocks and varying h1 headings, without template blocks, without nodes made of links, and
   without zones that HTML itself keeps apart (nav, aside, forms, adverts, reader comments ...).

In step 2 pages of a host with the same sequence of article blocks count once. Every page is parsed once; its blocks are
written, and the later steps read them. A page that has nothing in the slot (a layout that few pages of its host have) is judged
by its own markup (article element, zones, class names) without the template blocks, which are counted over all pages whatever
their layout; a page whose host has fewer than LEAST pages by its markup alone.

Defined results: null or empty html gives an empty text of 0 characters; a null url has its page judged by its own
markup; repeated rows get equal rows; pages with equal hash take part once in a sample; an empty table gives none;
other columns, whatever their names, are ignored; depth and length of a page are not limited; unclosed comments and
scripts run to the end of the page.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import RAW, VOID, tokens
from ..session import ship
from .common import join_hot, map_arrow, materialize, text_chunks

SAMPLE = 8
RAW_TAGS = frozenset(RAW.split("|"))
#: A block is template if this share of the pages with its node, and LEAST of them, have it there.
SHARE, LEAST = 0.6, 3
#: Nodes of which this share is link text hold no content.
LINKS = 0.6
#: A child with this share of the strongest child's score is content beside it.
RIVAL = 0.5
HELD_BYTES = 32 << 20
#: Wrappers of more bytes in all are joined by a shuffle, except those of hosts with very many pages.
BROADCAST_BYTES = 32 << 20

#: Element classes of HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ZONES = frozenset("nav aside footer form head button menu dialog label input select option fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SELF_CLOSING = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
NAMES = re.compile(
    r"(?:^|[-_\s])(?:nav|navbar|navigation|menus?|breadcrumbs?|masthead|footer|sidebars?|aside|ads?|adverts?|advertisements?|advertising"
    r"|sponsor(?:s|ed)?|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|alerts?|newsletters?|subscribe|subscription|signup|popups?|modals?|overlay"
    r"|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommended|recommendations|widgets?|toolbar"
    r"|pagination|pager|login|search|skip|copyright|legal|navigation|contentinfo|complementary|dialog)(?:$|[-_\s])",
    re.I,
)
HEADER_NAME = re.compile(r"(?:^|[-_\s])(?:header|banner)(?:$|[-_\s])", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
#: Names that set a zone apart whatever the wrapper says: adverts and reader comments.
APART = re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:s|ed)?|comments?|commentlist|disqus|replies|respond)(?:$|[-_\s])", re.I)
COMMENTS = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|disqus|replies|respond)(?:$|[-_\s])", re.I)
DIGITS = re.compile(r"\d+")
BLANK = re.compile(r"\s+")


#: How far an element is set apart: by a telling name, by HTML or as an advert, as reader comments.
NAMED, APART_ZONE, COMMENT_ZONE = 1, 2, 3


class Node:
    __slots__ = ("kids", "label", "shape", "tag", "zone")

    def __init__(self, tag: str, names: str = "", zone: int = 0):
        self.tag, self.label, self.zone, self.kids, self.shape = tag, f"{tag}.{names}" if names else tag, zone, [], None


@lru_cache(maxsize=65536)
def describe(tag: str, attributes: str) -> tuple[str, int]:
    """(class and id names without digits, how far the element is set apart)."""
    names, zone = [], APART_ZONE if tag in ZONES else 0
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            zone = max(zone, APART_ZONE)
        elif name != "aria-hidden":
            if tag not in ("body", "html", "main", "article"):
                zone = max(zone, COMMENT_ZONE if COMMENTS.search(value) else APART_ZONE if APART.search(value) else NAMED if NAMES.search(value) else 0)
            names.append(DIGITS.sub("", value))
    return " ".join(names), zone


def parse(html: str) -> Node:
    root = Node("html")
    stack, at, opened = [root], 0, Counter()

    def close(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    for start, end, tag, closing, attrs, _ in tokens(html):
        if start > at:
            stack[-1].kids.append(html[at:start])
        at = end
        if tag is None or tag in RAW_TAGS:
            continue
        if closing:
            if opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag == "html":
            continue
        if tag in ENDS_P or tag in SELF_CLOSING:
            closes, within = SELF_CLOSING.get(tag, ("p", ("td", "th", "table", "button")))
            closes = closes.split()
            for i in range(len(stack) - 1, 0, -1) if any(opened[c] > 0 for c in closes) else ():
                t = stack[i].tag
                if t in closes:
                    close(i)
                    break
                if t in within or (t in BLOCK and t not in closes):
                    break
        node = Node(tag, *describe(tag, attrs))
        stack[-1].kids.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if at < len(html):
        stack[-1].kids.append(html[at:])
    return root


# ---------------------------------------------------------------- blocks


class Block:
    """A text block of a page: its element, how many of its characters are links, its zone, whether in an article."""

    __slots__ = ("inside", "links", "node", "text", "zone")

    def __init__(self, node: Node, text: str, links: int, zone: int, inside: bool):
        self.node, self.text, self.links, self.zone, self.inside = node, text, links, zone, inside


def gather(root: Node) -> list[Block]:
    """Blocks in page order. A block's zone is the strongest of the elements round it; text of an element within a block
    that is set apart (a button, say) is left out. Of headers only an article's headings are in no zone."""
    out: list[Block] = []
    words: list[str] = []
    owners = [(root, 0, False)]
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = BLANK.sub(" ", unescape("".join(words))).strip() if words else ""
        if text:
            node, zone, inside = owners[-1]
            out.append(Block(node, text, min(linked, len(text)), zone, inside))
        words.clear()
        linked = 0

    todo = [(iter(root.kids), False, False, False)]  # children, in a link, in a header, whether a block ends with them
    while todo:
        kids, link, header, block = todo[-1]
        for k in kids:
            if isinstance(k, str):
                words.append(k)
                linked += len(k) * link
                continue
            if k.tag == "br":
                words.append(" ")
                continue
            _, zone, inside = owners[-1]
            inside = inside or k.tag in ("article", "main")
            heading = inside and k.tag in HEADINGS
            in_header = (header or k.tag == "header" or bool(HEADER_NAME.search(k.label.partition(".")[2]))) and not heading
            mine = 0 if heading else max(k.zone, APART_ZONE if in_header else 0)
            if k.tag in BLOCK:
                flush()
                owners.append((k, mine if heading else max(zone, mine), inside))
                todo.append((iter(k.kids), link, in_header, True))
                break
            if mine >= APART_ZONE:
                continue
            todo.append((iter(k.kids), link or k.tag == "a", in_header, False))
            break
        else:
            todo.pop()
            if block:
                flush()
                owners.pop()
    flush()
    return out


def own_choice(zones: list[int], inside: list[bool]) -> list[bool]:
    """Which blocks stay by the page's own markup: those of its articles if it has any, else those in no zone."""
    plain = [not z for z in zones]
    within = [p and i for p, i in zip(plain, inside, strict=True)]
    return within if any(within) else plain


def own_text(html: str) -> list[str]:
    """Block texts that stay by the page's own markup."""
    found = gather(parse(html))
    keep = own_choice([b.zone for b in found], [b.inside for b in found])
    return [b.text for b, k in zip(found, keep, strict=True) if k]


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def number(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


# ---------------------------------------------------------------- alignment


class Tree:
    """A tree that is aligned; siblings have different labels. nodes: the page's elements taken together, if any."""

    __slots__ = ("key", "kids", "label", "name", "nodes")

    def __init__(self, label: str, nodes: list[Node] | None = None):
        self.label, self.nodes, self.kids, self.name, self.key = label, nodes or [], [], 0, 0


def shape_of(root: Node) -> Tree:
    """The page's tree with siblings of one label taken together."""
    top = Tree(root.label, [root])
    todo = [top]
    while todo:
        s = todo.pop()
        one: dict[str, Tree] = {}
        for n in s.nodes:
            n.shape = s
            for k in n.kids:
                if not isinstance(k, str):
                    if k.label in one:
                        one[k.label].nodes.append(k)
                    else:
                        one[k.label] = Tree(k.label, [k])
        s.kids = list(one.values())
        todo += s.kids
    return top


def encode(tree: Tree) -> str:
    """Labels and numbers of children in page order, as JSON."""
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        out.append([t.label, len(t.kids)])
        todo += reversed(t.kids)
    return json.dumps(out)


def decode(text: str) -> tuple[Tree, list[Tree], list[int]]:
    """(tree, its nodes in page order, place of each node's parent); nodes are named by their place."""
    nodes, parents, todo = [], [], []
    for label, n in json.loads(text):
        t = Tree(label)
        t.name = t.key = len(nodes)
        parents.append(todo[-1][0].name if todo else -1)
        if todo:
            todo[-1][0].kids.append(t)
            todo[-1][1] -= 1
        nodes.append(t)
        todo.append([t, n])
        while todo and not todo[-1][1]:
            todo.pop()
    return nodes[0], nodes, parents


def heaviest_run(items: list[tuple[int, int]]) -> list[int]:
    """Places of the increasing subsequence of (value, weight) with the largest weight; values differ."""
    if not items:
        return []
    rank = {v: i + 1 for i, v in enumerate(sorted(v for v, _ in items))}
    best: list[tuple[int, int]] = [(0, -1)] * (len(items) + 1)  # prefix maxima by rank, as a Fenwick tree
    back, end = [], (0, -1)
    for k, (v, w) in enumerate(items):
        r, top = rank[v] - 1, (0, -1)
        while r:
            top, r = max(top, best[r]), r & (r - 1)
        back.append(top[1])
        now, r = (top[0] + w, k), rank[v]
        end = max(end, now)
        while r < len(best):
            best[r], r = max(best[r], now), r + (r & -r)
    out, k = [], end[1]
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(a: Tree, b: Tree) -> list[tuple[Tree, Tree]]:
    """Pairs of the best top-down alignment of two trees that keeps order (simple tree matching)."""
    pairs, inner = [(a, b)], []
    for x, y in pairs:  # grows: children follow their parents
        place = {k.label: i for i, k in enumerate(x.kids)}
        own = []
        for k in y.kids:
            if k.label in place:
                own.append((place[k.label], len(pairs)))
                pairs.append((x.kids[place[k.label]], k))
        inner.append(own)
    weight, chosen = [1] * len(pairs), [[]] * len(pairs)
    for p in range(len(pairs) - 1, -1, -1):
        run = heaviest_run([(at, weight[q]) for at, q in inner[p]])
        chosen[p] = [inner[p][k][1] for k in run]
        weight[p] += sum(weight[q] for q in chosen[p])
    out, todo = [], [0]
    while todo:
        p = todo.pop()
        out.append(pairs[p])
        todo += chosen[p]
    return out


def induce(pages: list[Tree]) -> Tree:
    """The host's wrapper tree: the first page, and from each other page the nodes that align with none."""
    wrapper = pages[0]
    for page in pages[1:]:
        partner = {id(y): x for x, y in align(wrapper, page)}
        for y in [p for p in [page] if id(p) in partner]:
            todo = [y]
            while todo:
                y = todo.pop()
                x, at = partner[id(y)], 0
                labels = {k.label for k in x.kids}
                for k in y.kids:
                    if id(k) in partner:
                        at = next(i for i, w in enumerate(x.kids) if w is partner[id(k)]) + 1
                        todo.append(k)
                    elif k.label not in labels:
                        x.kids.insert(at, k)
                        at += 1
    return wrapper


def place(root: Node, wrapper: Tree) -> Tree:
    """Names the page's tree: name is the wrapper node of a node or of its nearest aligned ancestor, key also tells nodes
    without a partner apart, by their labels."""
    top = shape_of(root)
    partner = {id(y): x.name for x, y in align(wrapper, top)}
    todo = [(top, 0, 0)]
    while todo:
        t, name, key = todo.pop()
        if id(t) in partner:
            t.name = t.key = partner[id(t)]
        else:
            t.name, t.key = name, number(key, t.label)
        todo += [(k, t.name, t.key) for k in t.kids]
    return top


class Placed:
    """What a page says of its host, as lists by block: text, wrapper node, key, mark of key and text, whether no earlier
    block has the mark, link characters, zone, whether in an article; and (node, its elements) of all aligned nodes."""

    LISTS = ("texts", "names", "keys", "marks", "first", "sizes", "links", "zones", "inside", "runs")

    def __init__(self, html: str, wrapper: Tree | None):
        root = parse(html)
        top = place(root, wrapper) if wrapper else None
        found = gather(root)
        self.texts, self.sizes = [b.text for b in found], [len(b.text) for b in found]
        self.links, self.zones, self.inside = [b.links for b in found], [b.zone for b in found], [b.inside for b in found]
        keep = own_choice(self.zones, self.inside)
        self.seq = number(*(t for t, k in zip(self.texts, keep, strict=True) if k))
        self.names = [b.node.shape.name for b in found] if wrapper else []
        self.keys = [b.node.shape.key for b in found] if wrapper else []
        self.marks = [number(k, t) for k, t in zip(self.keys, self.texts, strict=False)]
        seen: set[int] = set()
        self.first = [not (m in seen or seen.add(m)) for m in self.marks]
        self.runs, todo = [], [top] if top else []
        while todo:
            t = todo.pop()
            if t.name == t.key:
                self.runs += (t.name, len(t.nodes))
                todo += t.kids


# ---------------------------------------------------------------- content slot


class Totals:
    """Sums of one node over the pages of a host: pages, elements, text, its square, link text, own text."""

    FIELDS = ("pages", "elements", "text", "square", "links", "own")


def page_totals(names, marks, sizes, links, zones, runs, parents: list[int], template: frozenset[int]) -> dict[int, list[int]]:
    """name -> Totals of one page, template blocks and reader comments left out."""
    out = {name: [1, n, 0, 0, 0, 0] for name, n in zip(runs[::2], runs[1::2], strict=True)}
    for at, mark, size, link, zone in zip(names, marks, sizes, links, zones, strict=True):
        if mark in template or zone == COMMENT_ZONE:
            continue
        out[at][5] += size
        while at >= 0:
            out[at][2] += size
            out[at][4] += link
            at = parents[at]
    for row in out.values():
        row[3] = row[2] * row[2]
    return out


def content_slot(nodes: list[Tree], totals: dict[int, list[int]], markup: bool = True) -> tuple[int, list[int], list[int]]:
    """(slot, varying h1 headings, nodes made of links) of a host. markup: an article element is the slot."""
    pages = totals[0][0]

    def score(t: Tree) -> float:
        if t.name not in totals:
            return 0.0
        _, _, text, square, links, _ = totals[t.name]
        mean = text / pages
        return (max(0.0, square / pages - mean * mean) ** 0.5 + 0.1 * mean) * (1 - links / text) if text else 0.0

    node = nodes[0]
    while not markup or node.label.split(".")[0] not in ("article", "main"):
        ranked = sorted(((score(k), -k.name) for k in node.kids), reverse=True)
        if not ranked or ranked[0][0] <= 0 or 2 * totals[node.name][5] >= totals[node.name][2]:
            break
        best = nodes[-ranked[0][1]]
        rival = len(ranked) > 1 and ranked[1][0] >= RIVAL * ranked[0][0]
        if rival or totals[best.name][1] >= 1.5 * totals[best.name][0]:
            break
        node = best
    heads = [t.name for t in nodes if t.label.split(".")[0] == "h1" and t.name in totals and totals[t.name][2]]
    linky = [n for n, x in totals.items() if n != node.name and x[2] and x[4] >= LINKS * x[2]]
    return node.name, heads, linky


class Wrapper:
    """A host's wrapper as tasks use it."""

    def __init__(self, tree: str, template=(), slot: int | None = None, heads=(), linky=()):
        self.tree, self.nodes, self.parents = decode(tree)
        self.template = frozenset(template or ())
        if slot is not None:
            self.inside = [False] * len(self.nodes)
            heads, linky = set(heads or ()), set(linky or ())
            out = [False] * len(self.nodes)
            for t in self.nodes:
                up = self.parents[t.name]
                out[t.name] = t.name in linky or (up >= 0 and out[up] and t.name != slot)
                self.inside[t.name] = (t.name == slot or t.name in heads or (up >= 0 and self.inside[up])) and not out[t.name]


def choose(wrapper: Wrapper | None, names, marks, zones, inside, markup: bool = True) -> tuple[list[bool], bool]:
    """(which blocks are main text, whether the wrapper decided)."""
    if wrapper:
        keep = [(z < APART_ZONE or not markup) and m not in wrapper.template and wrapper.inside[n] for n, m, z in zip(names, marks, zones, strict=True)]
        if any(keep):
            return keep, True
    own = own_choice(zones, inside) if markup else [True] * len(zones)
    if wrapper:  # a layout outside the slot: blocks that its pages share are template all the same
        keep = [k and m not in wrapper.template for k, m in zip(own, marks, strict=True)]
        own = keep if any(keep) else own
    return own, False


def host_of(url: str | None) -> str:
    if not url or "://" not in url:
        return ""
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower()


# ---------------------------------------------------------------- jobs


def sampled(pages: DataFrame) -> DataFrame:
    """(host, salt, h, tree): the page of smallest hash of each host and salt, combined in the task first."""

    def run(batches):
        held: dict[tuple[str, int], tuple[int, str]] = {}
        size = 0

        def emit():
            rows = [(*k, h, encode(shape_of(parse(html)))) for k, (h, html) in held.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = [pa.string(), pa.int32(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["host", "salt", "h", "tree"])

        for part, col in text_chunks(batches, "html"):
            for page, url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), col.to_pylist(), strict=True):
                host = host_of(url)
                if not host or not html:
                    continue
                h = zlib.crc32(f"{page}|{url}".encode("utf-8", "replace"))
                key, h = (host, h % SAMPLE), h // SAMPLE
                old = held.get(key)
                if old is None or h < old[0]:
                    size += len(html) - (len(old[1]) if old else 0)
                    held[key] = (h, html)
                if size > HELD_BYTES:
                    yield emit()
                    held, size = {}, 0
        yield emit()

    best = map_arrow(pages.select("page_id", "url", "html"), run, "host string, salt int, h long, tree string")
    return best.groupBy("host", "salt").agg(F.min_by("tree", "h").alias("tree"))


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """(host, tree) of each host; at most SAMPLE small rows a host."""

    def run(rows: pa.Table) -> pa.Table:
        w = induce([decode(x)[0] for x in dict.fromkeys(rows.sort_by("salt")["tree"].to_pylist())])
        return pa.table({"host": rows["host"].to_pylist()[:1], "tree": [encode(w)]}, schema=pa.schema([("host", pa.string()), ("tree", pa.string())]))

    ship(pages.sparkSession)
    return sampled(pages).groupBy("host").applyInArrow(run, "host string, tree string")


def with_host(pages: DataFrame) -> DataFrame:
    at = F.instr("url", "://")
    low = F.translate(F.regexp_extract(F.substring(F.col("url"), at + 3, F.length("url")), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.col("page_id").cast("long"), "url", "html", F.when(at > 0, low).alias("host"))


def join_hosts(rows: DataFrame, hosts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """rows joined with hosts(host, pages, tree, ...): broadcast if small, else with hot hosts apart."""
    lists = [F.greatest(F.size(c), F.lit(0)) * 8 for c in ("template", "heads", "linky") if c in hosts.columns]
    size = hosts.agg(F.sum(sum(lists, F.length("tree") + 64))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(hosts.drop("pages")), "host", how)
    if how == "inner":
        return join_hot(rows, hosts, "host", "pages", total).drop("pages")
    known = join_hot(rows.where("host is not null"), hosts, "host", "pages", total, how).drop("pages")
    return known.unionByName(rows.where("host is null"), allowMissingColumns=True)


def cached(cache: dict, key, tree: str, *rest) -> Wrapper:
    if key not in cache:
        if len(cache) > 256:
            cache.clear()
        cache[key] = Wrapper(tree, *rest)
    return cache[key]


def placed(pages: DataFrame, trees: DataFrame, total: int) -> DataFrame:
    """page_id, url, host, seq (digest of the article blocks) and the lists of Placed, one row a page: the only step that
    parses every page."""
    rows = join_hosts(with_host(pages), trees, total, "left").select("page_id", "url", "host", "tree", "html")
    integers = pa.list_(pa.int32())
    types = {"texts": pa.list_(pa.string()), "names": integers, "keys": pa.list_(pa.int64()), "marks": pa.list_(pa.int64()), "first": pa.list_(pa.bool_()),
             "sizes": integers, "links": integers, "zones": integers, "inside": pa.list_(pa.bool_()), "runs": integers}
    kinds = {"texts": "string", "keys": "long", "marks": "long", "first": "boolean", "inside": "boolean"}
    schema = "page_id long, url string, host string, seq long, " + ", ".join(f"{k} array<{kinds.get(k, 'int')}>" for k in Placed.LISTS)

    def run(batches):
        cache: dict[str, Wrapper] = {}
        for part, col in text_chunks(batches, "html"):
            found = [Placed(html, cached(cache, tree, tree).tree if tree and html else None) for tree, html in zip(part.column(3).to_pylist(), col.to_pylist(), strict=True)]
            lists = [pa.array([getattr(f, k) for f in found], types[k]) for k in Placed.LISTS]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([f.seq for f in found], pa.int64()), *lists], ["page_id", "url", "host", "seq", *Placed.LISTS])

    return map_arrow(rows, run, schema)


def template_marks(rows: DataFrame) -> DataFrame:
    """(host, template, distinct): marks of its template blocks from all pages; those of one article sequence count
    once, and hosts with fewer than LEAST of them drop out."""
    once = F.filter(F.arrays_zip("keys", "marks", "first"), lambda x: x["first"])
    pairs = F.transform(once, lambda x: F.struct(x["keys"].alias("key"), x["marks"].alias("mark")))
    own = F.transform(F.array_distinct("keys"), lambda x: F.struct(x.alias("key"), F.lit(None).cast("long").alias("mark")))
    one = rows.where("size(marks) > 0").select("host", "seq", F.concat(own, pairs).alias("found"))
    one = materialize(one.groupBy("host", "seq").agg(F.min("found").alias("found")), "distinct-pages")
    counts = one.select("host", F.explode("found").alias("x")).groupBy("host", "x.key", "x.mark").agg(F.count("*").alias("n"))
    counts = materialize(counts.where(F.col("n") >= LEAST), "blocks")
    layouts = counts.where("mark is null").select("host", "key", F.col("n").alias("pages"))
    often = counts.where("mark is not null").join(layouts, ["host", "key"]).where(F.col("n") >= SHARE * F.col("pages"))
    often = often.groupBy("host").agg(F.collect_set("mark").alias("template"))
    return one.groupBy("host").agg(F.count("*").alias("distinct")).where(F.col("distinct") >= LEAST).join(often, "host", "left")


def slots(found: DataFrame, wrappers: DataFrame, total: int, markup: bool) -> DataFrame:
    """(host, slot, heads, linky) of each host, from sums over all its pages that are combined in the task first."""
    fields = ["names", "marks", "sizes", "links", "zones", "runs"]
    rows = join_hosts(found.where("size(marks) > 0").select("host", *fields), wrappers, total).select("host", "tree", "template", *fields)
    names = ["host", "tree", "name", *Totals.FIELDS]
    types = [pa.string(), pa.string(), pa.int64()] + [pa.float64()] * 6

    def run(batches):
        cache: dict[str, Wrapper] = {}
        sums: dict[tuple[str, str, int], list[int]] = {}

        def emit():
            cols = list(zip(*((*k, *v) for k, v in sums.items()), strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            for host, tree, template, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = cached(cache, host, tree, template)
                for name, x in page_totals(*lists, w.parents, w.template).items():
                    key = (host, tree if not name else "", name)
                    sums[key] = [a + b for a, b in zip(sums[key], x, strict=True)] if key in sums else list(map(float, x))
            if len(sums) > 1 << 17:
                yield emit()
                sums.clear()
        yield emit()

    parts = map_arrow(rows, run, "host string, tree string, name long, " + ", ".join(f"{f} double" for f in Totals.FIELDS))
    nodes = parts.groupBy("host", "name").agg(F.max("tree").alias("tree"), *(F.sum(f).alias(f) for f in Totals.FIELDS))
    schema = "host string, slot long, heads array<long>, linky array<long>"

    def decide(table: pa.Table) -> pa.Table:
        rows = {r["name"]: [r[f] for f in Totals.FIELDS] for r in table.to_pylist()}
        tree = next(r["tree"] for r in table.to_pylist() if r["name"] == 0)
        slot, heads, linky = content_slot(decode(tree)[1], rows, markup)
        kinds = pa.schema([("host", pa.string()), ("slot", pa.int64()), ("heads", pa.list_(pa.int64())), ("linky", pa.list_(pa.int64()))])
        return pa.table({"host": [table["host"][0].as_py()], "slot": [slot], "heads": [heads], "linky": [linky]}, schema=kinds)

    return nodes.groupBy("host").applyInArrow(decide, schema)


def learn_wrappers(pages: DataFrame, markup: bool = True) -> tuple[DataFrame, DataFrame]:
    """(wrappers(host, pages, tree, template, slot, heads, linky) of the hosts with LEAST different pages, placed pages)."""
    own = with_host(pages).where("host <> '' and html <> ''")
    sizes = own.groupBy("host").agg(F.count("*").alias("pages"))
    total = pages.count()
    trees = materialize(sizes.join(induce_wrappers(pages), "host"), "trees")
    found = materialize(placed(pages, trees, total), "placed")
    marked = materialize(trees.join(template_marks(found), "host").select("host", "pages", "tree", "template"), "templates")
    return materialize(marked.join(slots(found, marked, total, markup), "host"), "wrappers"), found


def extract_main_text(pages: DataFrame, markup: bool = True, withheld: bool = False) -> DataFrame:
    """One row per page of pages(page_id, url, html): page_id, url, text, n_chars, n_template (blocks that the wrapper
    left out). Without markup, zones and article elements that the pages declare say nothing: the wrappers alone decide,
    and pages without one keep all their text. withheld: no page gets a wrapper, for comparison."""
    wrappers, found = learn_wrappers(pages, markup)
    rows = join_hosts(found, wrappers.where("false") if withheld else wrappers, found.count(), "left")
    fields = ["host", "tree", "template", "slot", "heads", "linky", "names", "marks", "zones", "inside", "texts"]
    schema = "page_id long, url string, text string, n_chars long, n_template long"

    def run(batches):
        cache: dict[str, Wrapper] = {}
        for batch in batches:
            texts, out = [], []
            for host, tree, template, slot, heads, linky, names, marks, zones, inside, blocks in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                wrapper = cached(cache, host, tree, template, slot, heads, linky) if tree and marks else None
                keep, decided = choose(wrapper, names, marks, zones, inside, markup)
                texts.append("\n\n".join(t for t, k in zip(blocks, keep, strict=True) if k))
                out.append(decided * keep.count(False))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(out, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_template"],
            )

    return map_arrow(rows.select("page_id", "url", *fields), run, schema)
