"""Main text of web pages by wrapper induction.

A page is parsed into a tree (implied end tags, raw text, void elements, broken nesting), and each
page is aligned with its host's reference pages by simple tree matching: the order-keeping
assignment of two trees' nodes, tag for tag, that pairs the most. References are, in each of
REFERENCES classes of pages by hash, the page whose length is nearest to the host's median, so one
odd page decides nothing. From all pages of the host, two things are learned of a reference's nodes:

- constant ones: blocks that read the same as the reference's in nearly all pages (SHARE of those
  with different text, MIN_PAGES of these at least) are template;
- the slot of the content: from the root down, the child that holds over half of the varying
  prose (text outside links), until a node holds headings, paragraphs or text itself.

A page's text is what lies in the slot, less the template. What elements, roles, classes and ids
say is a prior: if an article (or else a main element) overlaps the slot, it takes the slot's
place; without a slot it decides alone; menus, headers, footers, asides, forms, adverts, notices
and comments are left out, unless the slot itself lies in them. In an article, and for paragraphs
and headings, only few class names count (STRONG). Scripts, styles and the like have no text.

Blocks are what block-level elements part; white space in a block becomes one blank; blocks
are joined by line feeds in page order.

Defined results: null and empty html have no text; null urls, and urls without a host, form one
host each for themselves (nothing is learned); rows with the same id are separate pages; ties
between children go to the first. Columns text and n_chars are replaced.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import discard, map_arrow, materialize, without

#: Different pages a host must have, and the share of them that must agree, for a block to be its template.
MIN_PAGES, SHARE = 4, 0.9
#: Reference pages of a host.
REFERENCES = 2
#: Cells of an alignment's table that are kept at once; larger ones are halved.
CELLS = 4_000_000
#: Hosts whose parsed references a task keeps, and shapes of subtrees that a reference remembers.
HOSTS, SHAPES = 150, 50_000
#: Reference pages and templates that may be broadcast; beyond it the joins shuffle.
MAX_BROADCAST_BYTES = 64 << 20

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile("[A-Za-z]+")
# Fixed values of HTML: elements without content, with raw text, that part blocks, and what ends an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
SILENT = frozenset("head title script style noscript template iframe svg select textarea button canvas audio video map noembed noframes".split())
PLACES = frozenset("nav header footer aside form dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar note".split())
# Words of class names and ids that mark what isn't content: anywhere, and only outside of articles.
STRONG = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo sidebar nav navbar menu breadcrumb breadcrumbs comment comments replies respond disqus cookie cookies consent newsletter pagination".split())
NOISE = STRONG | frozenset("promotion promotions navigation header masthead footer reply notice notices gdpr alert popup modal subscribe signup share sharing social related recommended recommendations widget pager login toolbar banner".split())
SPARED = frozenset("html body article main".split())
CARDS = frozenset("comment comments reply replies ad ads advert sponsored promo related".split())
# Elements whose class names say nothing, and those that show a node to hold content itself.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th".split())
TELLING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


class Node:
    __slots__ = ("tag", "kids", "noise", "index", "main", "inside", "shape", "size", "elements")

    def __init__(self, tag: str, noise: bool = False, main: bool = False, inside: bool = False):
        self.tag, self.kids, self.noise, self.main, self.inside, self.index = tag, [], noise, main, inside, -1
        self.elements: list[Node] = []


def marked(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element's name and attributes speak against content, and whether it is a main element."""
    main = tag == "main"
    noise = tag in PLACES
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                words = {w.lower() for w in WORDS.findall(value)}
                known = CARDS if tag == "article" else () if tag in SPARED or tag in PROSE else STRONG if inside else NOISE
                noise |= not words.isdisjoint(known)
            elif name == "role":
                noise |= value.lower() in ROLES
                main |= value.lower() == "main"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                noise = True
    return noise, main


def parse(page: str) -> Node:
    """The page's tree; strings among the children are decoded text."""
    root = Node("#root")
    stack, at = [root], 0
    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            stack[-1].kids.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if m[5] and m[0][-1] != ">":
            break  # the page ends inside a tag
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "body", "table", "main") and tag not in ("body", "html", "main", "article"):
                    break
            continue
        ends, fence = CLOSES.get(tag, ()), FENCES.get(tag, ())
        if tag in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in fence:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        above = stack[-1]
        inside = above.inside or above.main or tag == "article"  # of an article or a main element
        node = Node(tag, *marked(tag, attributes, inside), inside)
        above.kids.append(node)
        above.elements.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag == "xmp":
                node.kids.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    return root


def numbered(root: Node) -> list[Node]:
    """Nodes in page order, each with its place as index."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        x.index = len(out)
        out.append(x)
        todo += reversed(x.elements)
    return out


def shaped(nodes: list[Node], shapes: dict) -> None:
    """Give each node the number of its subtree's shape (tags only) and its size; nodes in page order."""
    for x in reversed(nodes):
        key = (x.tag, *[k.shape for k in x.elements])
        x.shape = shapes.setdefault(key, len(shapes))
        x.size = 1 + sum(k.size for k in x.elements)


def _middle(a: Node, b: Node) -> tuple[int, list[Node], list[Node]]:
    """Equal subtrees at either end match each other in some best matching; how many lead, and what is left of the children."""
    xs, ys = a.elements, b.elements
    most = min(len(xs), len(ys))
    start = 0
    while start < most and xs[start].shape == ys[start].shape:
        start += 1
    behind = 0
    while behind < most - start and xs[-1 - behind].shape == ys[-1 - behind].shape:
        behind += 1
    return start, xs[start : len(xs) - behind], ys[start : len(ys) - behind]


def _weights(xs: list[Node], ys: list[Node], memo: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the distinct shapes on either side, and each node's place among them."""
    left, right = {x.shape: x for x in xs}, {y.shape: y for y in ys}
    table = np.array([[x.size if x.shape == y.shape else memo[x.shape, y.shape] if x.tag == y.tag else 0 for y in right.values()] for x in left.values()], dtype=np.int64)
    row, column = {s: i for i, s in enumerate(left)}, {s: i for i, s in enumerate(right)}
    return table, np.array([row[x.shape] for x in xs]), np.array([column[y.shape] for y in ys])


def _rows(table: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the table of best sums for matching in order the beginnings of two lists."""
    row = np.zeros(len(j) + 1, dtype=np.int64)
    yield row
    for k in i:
        new = row.copy()
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + table[k][j]), out=new[1:])
        row = new
        yield row


def _chosen(table: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Places matched in a best matching of two lists. A table of over CELLS cells is parted where its halves' sums are best."""
    if not len(i) or not len(j):
        return []
    if len(i) * len(j) > CELLS and len(i) > 1:
        half = len(i) // 2
        for above in _rows(table, i[:half], j):
            pass
        for below in _rows(table, i[half:][::-1], j[::-1]):
            pass
        cut = int((above + below[::-1]).argmax())
        return _chosen(table, i[:half], j[:cut]) + [(half + x, cut + y) for x, y in _chosen(table, i[half:], j[cut:])]
    best, out = list(_rows(table, i, j)), []
    x, y = len(i), len(j)
    while x and y:
        w = table[i[x - 1], j[y - 1]]
        if best[x][y] == best[x - 1][y]:
            x -= 1
        elif best[x][y] == best[x][y - 1]:
            y -= 1
        else:
            assert w and best[x][y] == best[x - 1][y - 1] + w
            x, y = x - 1, y - 1
            out.append((x, y))
    return out[::-1]


def _scored(a: Node, b: Node, memo: dict) -> int:
    """The most nodes of two shaped trees that match in order, level by level. memo: what is known of pairs of shapes."""
    if a.tag != b.tag:
        return 0
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if x.shape == y.shape or (x.shape, y.shape) in memo:
            todo.pop()
            continue
        start, xs, ys = _middle(x, y)
        right = {q.shape: q for q in ys}
        need = [(p, q) for p in {p.shape: p for p in xs}.values() for q in right.values() if p.tag == q.tag and p.shape != q.shape and (p.shape, q.shape) not in memo]
        if need:
            todo += need
            continue
        total = 1 + sum(k.size for k in x.elements) - sum(k.size for k in xs)
        if xs and ys:
            for row in _rows(*_weights(xs, ys, memo)):
                pass
            total += int(row[-1])
        memo[x.shape, y.shape] = total
        todo.pop()
    return a.size if a.shape == b.shape else memo[a.shape, b.shape]


def align(a: Node, b: Node, pairs: list[tuple[Node, Node]], shapes: dict | None = None, memo: dict | None = None) -> int:
    """Simple tree matching: the most nodes of two trees that match in order, level by level; collects the matched pairs."""
    shapes, memo = {} if shapes is None else shapes, {} if memo is None else memo
    shaped(numbered(a), shapes)
    shaped(numbered(b), shapes)
    score = _scored(a, b, memo)
    todo = [(a, b)] if score else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if x.shape == y.shape:
            todo += zip(x.elements, y.elements, strict=True)
            continue
        start, xs, ys = _middle(x, y)
        todo += zip(x.elements[:start], y.elements[:start], strict=True)
        todo += zip(x.elements[start + len(xs) :], y.elements[start + len(ys) :], strict=True)
        if xs and ys:
            todo += [(xs[i], ys[j]) for i, j in _chosen(*_weights(xs, ys, memo))]
    return score


def headed(node: Node) -> bool:
    todo = list(node.elements)
    while todo:
        x = todo.pop()
        if x.tag in ("h1", "h2"):
            return True
        if x.tag in ("hgroup", "div"):
            todo += x.elements
    return False


class Piece:
    """A block's text: its owner, marks against it, the article (or main element, negative) it lies in, where it stands in the references."""

    __slots__ = ("text", "prose", "owner", "noise", "area", "at")

    def __init__(self, text, prose, owner, noise, area, at):
        self.text, self.prose, self.owner, self.noise, self.area, self.at = text, prose, owner, noise, area, at


def pieces(root: Node, maps: tuple[dict[int, int], ...] = ()) -> list[Piece]:
    """The blocks of a numbered tree. maps: from this tree's nodes to those of each reference."""
    out: list[Piece] = []
    buffer: list[str] = []
    linked = areas = 0

    def flush(context):
        nonlocal linked
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            out.append(Piece(text, max(0, len(text) - linked), *context))
        linked = 0

    # a context: owner, noise, area, places in the references
    todo: list = [(root, (0, 0, 0, tuple(m.get(0, -1) for m in maps)), False, False)]
    while todo:
        x, context, in_link, leaving = todo.pop()
        if leaving:
            flush(context)
        elif isinstance(x, str):
            buffer.append(x)
            linked += len(" ".join(x.split())) if in_link else 0
        elif x.tag == "br" or x.tag in SILENT:
            buffer.append(" ")
        elif x.tag not in BLOCKS and x.noise and not x.main:
            pass
        else:
            if x.tag in BLOCKS or x.main:
                flush(context)
                owner, noise, area, at = context
                noise += x.noise and not x.main and not (x.tag == "header" and x.inside and headed(x))
                if not noise and area <= 0 and (x.tag == "article" or x.main and not area):
                    areas += 1
                    area = areas if x.tag == "article" else -areas
                context = (x.index, noise, area, tuple(m.get(x.index, old) for m, old in zip(maps, at, strict=True)))
                todo.append((x, context, in_link, True))
            in_link = in_link or x.tag == "a"
            todo += [(k, context, in_link, False) for k in reversed(x.kids)]
    flush((0, 0, 0, tuple(m.get(0, -1) for m in maps)))
    return out


def content_roots(root: Node) -> list[Node]:
    """Outermost articles, else main elements, else the page, where nothing speaks against them."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [(root, False, False)]
    while todo:
        x, in_article, in_main = todo.pop()
        if x.tag == "article" and not in_article:
            found["article"].append(x)
        if x.main and not in_main:
            found["main"].append(x)
        todo += [(k, in_article or x.tag == "article", in_main or x.main) for k in reversed(x.elements) if not (k.noise and not k.main) and k.tag not in SILENT]
    return found["article"] or found["main"] or [root]


def chosen(found: list[Piece], slot: list[bool] | None = None, spared: int = 0, template: frozenset = frozenset()) -> list[str]:
    """Texts of a page's main blocks. slot: which lie in the learned slot; spared: marks against the slot itself; template: owners whose blocks are."""
    if slot is not None and any(slot):
        areas = {p.area for p, s in zip(found, slot, strict=True) if s and p.area > 0} or {p.area for p, s in zip(found, slot, strict=True) if s and p.area < 0}
    else:
        slot, areas = None, {p.area for p in found if p.area > 0} or {p.area for p in found if p.area < 0}
    if areas:  # an article that overlaps the slot stands for it, and with it the page's others
        sign = max(areas) > 0
        keep = [p.noise == 0 and (p.area > 0 if sign else p.area < 0) for p in found]
    elif slot is not None:
        keep = [s and p.noise <= spared for p, s in zip(found, slot, strict=True)]
    else:
        keep = [p.noise == 0 for p in found]
    return [p.text for p, k in zip(found, keep, strict=True) if k and p.owner not in template]


def blocks(roots: list[Node], template: set[int]) -> list[str]:
    """Texts of the blocks under some nodes, less what is marked and those of template nodes."""
    return [p.text for root in roots for p in pieces(root) if not p.noise and p.owner not in template]


def host_of(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def owned(found: list[Piece]) -> dict[int, str]:
    """Each owner's texts, joined."""
    out: dict[int, str] = {}
    for p in found:
        out[p.owner] = f"{out[p.owner]} {p.text}" if p.owner in out else p.text
    return out


class Reference:
    """A parsed reference page: its nodes' parents, where their subtrees end, their texts, and marks against them."""

    def __init__(self, page: str):
        self.root = parse(page)
        self.nodes = numbered(self.root)
        self.shapes, self.memo = {}, {}
        self.texts = owned(pieces(self.root))
        n = len(self.nodes)
        self.parent, self.end, self.marks = [0] * n, list(range(1, n + 1)), [0] * n
        for x in self.nodes:
            for k in x.elements:
                self.parent[k.index] = x.index
                self.marks[k.index] = self.marks[x.index] + (k.noise and not k.main)
        for i in range(n - 1, 0, -1):
            self.end[self.parent[i]] = max(self.end[self.parent[i]], self.end[i])

    def match(self, root: Node) -> dict[int, int]:
        """From a page's nodes to those of the reference."""
        if len(self.shapes) + len(self.memo) > SHAPES:
            self.shapes, self.memo = {}, {}
        pairs: list[tuple[Node, Node]] = []
        align(self.root, root, pairs, self.shapes, self.memo)
        return {y.index: x.index for x, y in pairs}

    def slot(self, prose: dict[int, tuple[int, int]], fixed: set[int]) -> int:
        """The node that holds the content; 0 if that is the whole page. prose: unmarked, and all, characters of each node's own blocks."""
        held = [(0, 0) if i in fixed else prose.get(i, (0, 0)) for i in range(len(self.nodes))]
        clear, whole = sum(c for c, _ in held), sum(w for _, w in held)
        own = [c if 5 * clear >= whole else w for c, w in held]
        total = list(own)
        for i in range(len(own) - 1, 0, -1):
            total[self.parent[i]] += total[i]
        x = self.nodes[0]
        while total[x.index] and not own[x.index] and not any(k.tag in TELLING and total[k.index] for k in x.elements):
            best = max(x.elements, key=lambda k: total[k.index])
            if 2 * total[best.index] <= total[x.index]:
                break
            x = best
        return x.index


def _kept(cache: dict, key, make):
    """What a task remembers of some hosts."""
    if key not in cache:
        if len(cache) >= HOSTS:
            cache.clear()
        cache[key] = make()
    return cache[key]


def references(pages: DataFrame) -> DataFrame:
    """host, refs: the html of up to REFERENCES reference pages of each host, in an order that doesn't depend on the rows'."""
    rows = pages.filter("host <> '' AND html <> ''").select("host", F.length("html").alias("size"), F.xxhash64("html").alias("h"))
    middle = materialize(rows.groupBy("host").agg(F.percentile_approx("size", 0.5, 200).alias("middle")), "middle")
    rows = rows.join(_small(middle, F.lit(48)), "host").withColumn("far", F.abs(F.col("size") - F.col("middle")))
    picked = rows.groupBy("host", F.pmod("h", F.lit(REFERENCES)).alias("r")).agg(F.min(F.struct("far", "h")).alias("x")).select(F.col("host").alias("ho"), F.col("x.h").alias("k"))
    found = pages.join(_small(picked, F.lit(64)), (F.col("host") == F.col("ho")) & (F.xxhash64("html") == F.col("k"))).select("host", "k", "html").dropDuplicates(["host", "k"])
    return found.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "html"))), lambda x: x["html"]).alias("refs"))


def _small(df: DataFrame, size) -> DataFrame:
    """df to be broadcast if its bytes are few enough; size: a column with a row's."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= MAX_BROADCAST_BYTES else df


CUT = "host string, mark long, texts array<string>, prose array<int>, owner array<int>, noise array<int>, area array<int>, at array<int>"


def cut_pages(rows: DataFrame, kept: list[str]) -> DataFrame:
    """Columns of kept and of CUT: every page's blocks, aligned. rows: kept, html, host, refs.

    at: for each block and reference, twice the place there of its nearest matched node, plus one if
    that is its owner and reads the same; -1 without a place. mark: a hash of what the prior alone
    would take, for pages that differ elsewhere only count once.
    """
    schema = T.StructType([*rows.select(*kept).schema.fields, *T._parse_datatype_string(CUT).fields])
    n = len(kept)

    def lists(values: list[list], of: pa.DataType) -> pa.Array:
        return pa.array(values, pa.list_(of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[Reference]] = {}
        for batch in batches:
            marks, cols = [], tuple([] for _ in range(6))
            for i, (page, host) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)):
                known = _kept(cache, host, lambda i=i: [Reference(x) for x in batch.column(n + 2)[i].as_py() or ()])
                root = parse(page)
                numbered(root)
                matches = tuple(r.match(root) for r in known)
                found = pieces(root, matches)
                said = owned(found)
                marks.append(int.from_bytes(hashlib.blake2b("\n".join(chosen(found)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
                at = [2 * a + (p.owner in matches[k] and said[p.owner] == r.texts.get(a)) if a >= 0 else -1 for p in found for k, (a, r) in enumerate(zip(p.at, known, strict=True))]
                for col, value in zip(cols, ([p.text for p in found], [p.prose for p in found], [p.owner for p in found], [p.noise for p in found], [p.area for p in found], at), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], batch.column(n + 1), pa.array(marks, pa.int64()), lists(cols[0], pa.string()), *(lists(c, pa.int32()) for c in cols[1:])], names=schema.names)

    return map_arrow(rows, run, schema)


def learned(cut: DataFrame) -> DataFrame:
    """host, fixed, prose: template nodes (r, node) and characters of the nodes' own blocks (r, node, clear, whole), from all pages of a host."""
    rows = cut.filter("host <> ''").select("host", "mark", (F.size("at") / F.size("texts")).cast("int").alias("refs"), "prose", "noise", F.posexplode("at").alias("i", "a")).filter("a >= 0")
    refs = F.col("refs")
    rows = rows.select("host", "mark", (F.col("i") % refs).alias("r"), F.shiftright("a", 1).alias("node"), (F.col("a") % 2 == 1).alias("same"), F.get("prose", F.floor(F.col("i") / refs).cast("int")).alias("c"), F.get("noise", F.floor(F.col("i") / refs).cast("int")).alias("noise"))
    total = cut.filter("host <> ''").select("host", "mark").distinct().groupBy("host").agg(F.count("*").alias("m")).filter(F.col("m") >= MIN_PAGES)
    same = rows.filter("same").select("host", "r", "node", "mark").distinct().groupBy("host", "r", "node").agg(F.count("*").alias("k"))
    fixed = same.join(total, "host").filter(F.col("k") >= SHARE * F.col("m")).groupBy("host").agg(F.collect_list(F.struct("r", "node")).alias("fixed"))
    prose = rows.groupBy("host", "r", "node").agg(F.sum(F.when(F.col("noise") == 0, F.col("c")).otherwise(0)).alias("clear"), F.sum("c").alias("whole"))
    prose = prose.groupBy("host").agg(F.collect_list(F.struct("r", "node", "clear", "whole")).alias("prose"))
    return prose.toDF("host", "learned").join(fixed, "host", "left")


def wrappers(hosts: DataFrame) -> DataFrame:
    """host and, for each reference, its template nodes, the slot's first and last node (0: no slot) and the marks against the slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                made = []
                for r, page in enumerate(row["refs"]):
                    ref = Reference(page)
                    drop = [x["node"] for x in row["fixed"] or () if x["r"] == r]
                    slot = ref.slot({x["node"]: (x["clear"], x["whole"]) for x in row["learned"] if x["r"] == r}, set(drop))
                    made.append({"drop": drop, "first": slot, "last": ref.end[slot] - 1, "marks": ref.marks[slot]})
                out.append(made)
            kind = pa.list_(pa.struct([("drop", pa.list_(pa.int32())), ("first", pa.int32()), ("last", pa.int32()), ("marks", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["host", "wrap"])

    return map_arrow(hosts.select("host", "refs", "learned", "fixed"), run, "host string, wrap array<struct<drop: array<int>, first: int, last: int, marks: int>>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages without the html, plus text and n_chars."""
    base = without(pages, "text", "n_chars") if html_col.lower() not in ("text", "n_chars") else pages
    kept = [c for c in base.columns if c != html_col]
    own = [f"__{i}" for i in range(len(kept))]  # the pages' own columns under names that can't clash
    rows = base.select(*[F.col(c).alias(o) for c, o in zip(kept, own, strict=True)], F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"))
    refs = materialize(references(rows.select("host", "html")), "references")
    bytes_of = F.aggregate("refs", F.lit(0), lambda n, x: n + F.octet_length(x))
    cut = materialize(cut_pages(rows.join(_small(refs, bytes_of), "host", "left").select(*own, "html", "host", "refs"), own), "cut")
    wraps = materialize(wrappers(learned(cut).join(refs, "host")), "wraps")
    discard(refs)
    rows = cut.select(*own, "texts", "owner", "noise", "area", "at", "host")
    rows = rows.join(_small(wraps, F.lit(64) + 16 * F.size("wrap") + F.aggregate("wrap", F.lit(0), lambda n, x: n + 4 * F.size(x["drop"]))), "host", "left").drop("host")
    schema = T.StructType([*base.select(*kept).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names, n = schema.names, len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for said, owner, noise, area, at, wraps in zip(*(batch.column(k).to_pylist() for k in range(n, n + 6)), strict=True):
                found = [Piece(t, 0, o, m, a, ()) for t, o, m, a in zip(said, owner, noise, area, strict=True)]
                slot, spared, template = None, 0, set()
                for r, wrap in enumerate(wraps or ()):
                    places, drop = at[r :: len(wraps)], set(wrap["drop"])
                    template.update(o for o, x in zip(owner, places, strict=True) if x >= 0 and x % 2 and x // 2 in drop)
                    if slot is None and wrap["first"]:
                        inside = [wrap["first"] <= x // 2 <= wrap["last"] for x in places]
                        if any(inside):
                            slot, spared = inside, wrap["marks"]
                texts.append("\n".join(chosen(found, slot, spared, frozenset(template))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return map_arrow(rows.toDF(*kept, *(f"__{c}" for c in rows.columns[n:])), run, schema)
