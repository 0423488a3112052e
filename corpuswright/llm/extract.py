"""Main text of web pages by wrapper induction over the pages of a host.

1. Every page becomes a tree; runs of like siblings (paragraphs, list entries)
   fold into one repeated node, so a tree has as many nodes as the layout, not
   the text.
2. A host's pivot is its most frequent tree. Every other tree of the host is
   aligned to it by simple tree matching: the largest order-preserving set of
   node pairs with equal labels under matched parents.
   Nodes the pivot lacks have a place by their labels from the root, over all layouts of the host.
3. Per host and place, the hash of the node's own text is counted with its
   smallest and largest value over all pages of different content. A node with one value on ``LEAST_PAGES`` such
   pages or more is template, the rest are slots.
4. A slot is content unless its element's role says otherwise (menus, headers,
   footers, sidebars, notices, adverts, forms, comments); where a page marks an
   article or main part, only slots inside count.

A whole name of class, id, role or itemprop gives an element its role; a part of one ("cookie-notice") only where the
element holds less than half of the page's text and no headline. Where roles leave no block, the slots of all but silent
elements count. A page whose text would all go keeps its slots by role alone, as pages of one
article under several addresses look like template.
"""

from __future__ import annotations

import hashlib
import json
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

from .common import join_side, kept_in_process, stored

LEAST_PAGES = 5
# Elements whose text is never part of an article.
SILENT = frozenset("script style template noscript head title iframe object embed svg canvas math audio video map"
                   " select textarea button input datalist form nav menu footer aside dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small"
                   " span strike strong sub sup time tt u var wbr".split())
ARTICLE = frozenset(("article", "main"))
# Words of class, id and role that name parts around an article.
AROUND = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar"
                   " navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside rail widget"
                   " widgets related recommended share sharing social comment comments disqus respond reply replies discussion"
                   " notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup"
                   " login search form pagination pager toolbar complementary contentinfo dialog".split())
CLOSED_BY = {  # an open element that the start of another ends
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
                   " header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option", "optgroup")),
    "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")),
}
SCOPES = frozenset("html body table td th ul ol dl button object article section main div".split())
_NAME = re.compile(r"[A-Za-z0-9]+")


STATES = frozenset("no not has have with without is hide show enable enabled".split())  # "has-sidebar" is no sidebar


NAMES_KEPT = 4096


def _named(marks: str) -> str:
    """:func:`_role` through a bounded cache of the worker process; a decorated function would not travel with its code."""
    known = kept_in_process("element-names", dict)
    if marks not in known:
        if len(known) >= NAMES_KEPT:
            known.clear()
        known[marks] = _role(marks)
    return known[marks]


def _role(marks: str) -> str:
    """``"whole"`` where a name of an element is one of ``AROUND``, ``"part"`` where only a part of a name is."""
    names = marks.lower().split()
    if any(n in AROUND for n in names):
        return "whole"
    parts = [_NAME.findall(n) for n in names]
    return "part" if any(AROUND & set(p) and not STATES & set(p) for p in parts) else ""


def _marks(attrs) -> tuple[str, bool, bool]:
    """Class, id, role and property of an element, whether it is marked as the main part, and whether it is hidden."""
    found = dict(attrs)
    marks = " ".join(str(found.get(k) or "") for k in ("class", "id", "role", "itemprop")).strip()
    hidden = "hidden" in found or bool(re.search(r"display\s*:\s*none", str(found.get("style") or "")))
    main = any(str(found.get(k) or "").strip().lower() == "main" for k in ("id", "role"))
    return (f"{marks} dialog".strip() if hidden else marks), main, hidden


class Node:
    __slots__ = ("label", "role", "silent", "main", "named", "children", "parent", "path", "tag")

    def __init__(self, tag: str, marks: str, parent: "Node | None", main: bool = False, hidden: bool = False):
        self.tag, self.parent, self.role = tag, parent, ""
        self.label = f"{tag}.{marks}" if marks else tag
        self.main = main or tag in ARTICLE
        self.silent = hidden or tag in SILENT or bool(parent and parent.silent)
        self.named = _named(marks) if tag not in ("html", "body") else ""
        self.children: list = []


def _set_roles(root: Node) -> None:
    """Gives every node its role: names by parts count where the element's share of the text is small."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str))
    size, headed = {}, {}
    for node in reversed(order):  # children first
        below = [c for c in node.children if not isinstance(c, str)]
        plain = not (node.silent or node.named == "whole")
        size[id(node)] = plain and sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(size[id(c)] for c in below)
        headed[id(node)] = plain and (node.tag == "h1" or any(headed[id(c)] for c in below))
    for node in order:
        above = node.parent.role if node.parent else ""
        out = (node.silent or node.named == "whole" or node.tag == "header" and above != "in"
               or node.named == "part" and 2 * size[id(node)] < size[id(root)] and not headed[id(node)])
        node.role = "out" if out or above == "out" else "in" if node.main else above


class Tree(HTMLParser):
    """Builds nodes and text; unclosed and stray tags are repaired as browsers do in the common cases."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#page", "", None)

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def handle_starttag(self, tag, attrs):
        while self.at.parent and tag in CLOSED_BY.get((block := self._block()).tag, ()):
            self.at = block.parent
        marks, main, hidden = _marks(attrs) if attrs else ("", False, False)
        node = Node(tag, marks, self.at, main, hidden)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def _block(self) -> Node:
        node = self.at
        while node.parent and node.tag in INLINE:
            node = node.parent
        return node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            if node.tag in SCOPES and tag in INLINE:
                return
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    _set_roles(tree.root)
    return tree.root


def blocks(root: Node) -> list[tuple[Node, str]]:
    """Block nodes in page order with their text, white space folded; empty ones are left out."""
    out: list[tuple[Node, list[str]]] = []
    stack: list = [(root, root)]
    current: list | None = None
    owner = None
    while stack:
        item, block = stack.pop()
        if isinstance(item, str):
            if item.strip() or current is not None:
                if owner is not block:
                    current, owner = [], block
                    out.append((block, current))
                current.append(item)
        elif item is None:
            owner = current = None
        elif item.tag in ("br", "hr"):
            if current is not None and item.tag == "br":
                current.append(" ")
        elif item.tag in INLINE and item.role == block.role:
            stack.extend((c, block) for c in reversed(item.children))
        else:
            stack.append((None, block))
            stack.extend((c, item) for c in reversed(item.children))
            stack.append((None, block))
    folded = ((n, " ".join("".join(t).split())) for n, t in out)
    return [(n, t) for n, t in folded if t]


def skeleton(root: Node) -> list:
    """``[label, children]``: block elements only, like siblings folded; gives every node its ``path``."""
    top: list = [root.label, []]
    root.path = ""
    stack = [(root, top, "")]
    while stack:
        node, shape, path = stack.pop()
        seen: dict[str, int] = {}
        for child in node.children:
            if isinstance(child, str) or child.tag in VOID:
                continue
            if child.tag in INLINE and child.role == node.role:
                child.path = path
                stack.append((child, shape, path))
                continue
            if child.label not in seen:
                seen[child.label] = next((i for i, s in enumerate(shape[1]) if s[0] == child.label), len(shape[1]))
                if seen[child.label] == len(shape[1]):
                    shape[1].append([child.label, []])
            k = seen[child.label]
            child.path = f"{path}/{k}"
            stack.append((child, shape[1][k], child.path))
    return top


def align(a: list, b: list) -> tuple[int, dict[str, str]]:
    """Simple tree matching: size of the largest matching of ``a`` onto ``b`` and the paths it pairs."""
    pairs: dict[str, str] = {}

    def size(x, y, memo):
        if x[0] != y[0]:
            return 0
        key = (id(x), id(y))
        if key not in memo:
            m, n = len(x[1]), len(y[1])
            table = [[0] * (n + 1) for _ in range(m + 1)]
            for i in range(1, m + 1):
                for j in range(1, n + 1):
                    table[i][j] = max(table[i - 1][j], table[i][j - 1],
                                      table[i - 1][j - 1] + size(x[1][i - 1], y[1][j - 1], memo))
            memo[key] = (table[m][n] + 1, table)
        return memo[key][0]

    memo: dict = {}
    total = size(a, b, memo)
    stack = [(a, b, "", "")] if total else []
    while stack:
        x, y, px, py = stack.pop()
        pairs[px] = py
        table = memo[(id(x), id(y))][1]
        i, j = len(x[1]), len(y[1])
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                stack.append((x[1][i], y[1][j], f"{px}/{i}", f"{py}/{j}"))
    return total, pairs


DEPTH = 200  # nested deeper, children join their ancestor's node, which bounds the recursion of the matching


def _shallow(shape: list, depth: int = 0) -> list:
    return [shape[0], [_shallow(c, depth + 1) for c in shape[1]] if depth < DEPTH else []]


def layout(html: str) -> tuple[str, dict[str, int], list[tuple[Node, str]]]:
    """A page's folded tree as JSON, the hash of the text at each path, and its blocks."""
    root = parse(html)
    shape = skeleton(root)
    found = blocks(root)
    texts: dict[str, list[str]] = {}
    for node, text in found:
        texts.setdefault(node.path, []).append(text)
    hashes = {p: int.from_bytes(hashlib.blake2b("\n".join(t).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
              for p, t in [*texts.items(), *((p + FIRST, t[:1]) for p, t in texts.items() if len(t) > 1),
                           *((p + LAST, t[-1:]) for p, t in texts.items() if len(t) > 1)]}
    return json.dumps(_shallow(shape), ensure_ascii=False, separators=(",", ":")), hashes, found


def content(found: list[tuple[Node, str]]) -> list[tuple[str, str, str]]:
    """Path, place and text of the blocks whose role allows content, those of an article or main part alone where there are any.

    The place is the path marked as the first or the last of its repeated node.
    """
    count: dict[str, int] = {}
    for node, _ in found:
        count[node.path] = count.get(node.path, 0) + 1
    seen: dict[str, int] = {}
    placed = []
    for node, text in found:
        k = seen[node.path] = seen.get(node.path, 0) + 1
        place = FIRST if k == 1 else LAST if k == count[node.path] else ""
        placed.append((node.role, node.silent, node.path, node.path + place if count[node.path] > 1 else node.path, text))
    allowed = [x for x in placed if x[0] != "out"] or [x for x in placed if not x[1]]
    return [x[2:] for x in [x for x in allowed if x[0] == "in"] or allowed]


FIRST, LAST = "#first", "#last"


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).alias("html"), _host(F.col("url")).alias("host"))


def _layouts(batches):
    import pyarrow as pa
    slot = pa.list_(pa.struct([("path", pa.string()), ("place", pa.string()), ("text", pa.string())]))
    for batch in batches:
        marks, shapes, paths, hashes, slots = [], [], [], [], []
        for html in batch.column(3).to_pylist():
            shape, texts, found = layout(html)
            marks.append(int.from_bytes(hashlib.blake2b(shape.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True))
            shapes.append(shape)
            paths.append(list(texts))
            hashes.append(list(texts.values()))
            slots.append([{"path": p, "place": q, "text": t} for p, q, t in content(found)])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(marks, pa.int64()), pa.array(shapes, pa.string()), pa.array(paths, pa.list_(pa.string())),
             pa.array(hashes, pa.list_(pa.int64())), pa.array(slots, slot)], names=LAYOUT_COLUMNS)


LAYOUT_COLUMNS = ["page_id", "url", "host", "mark", "shape", "paths", "hashes", "slots"]
LAYOUT_SCHEMA = ("page_id bigint, url string, host string, mark bigint, shape string, paths array<string>, hashes array<bigint>,"
                 " slots array<struct<path:string,place:string,text:string>>")


def _label_paths(shape: list) -> dict[str, str]:
    """The place of every path of a tree by the labels from its root; like siblings are folded, so no two are equal."""
    out, stack = {}, [(shape, "", b"")]
    while stack:
        (label, children), path, above = stack.pop()
        mark = hashlib.blake2b(above + label.encode("utf-8", "replace"), digest_size=12).digest()
        out[path] = f"~{mark.hex()}"
        stack.extend((c, f"{path}/{i}", mark) for i, c in enumerate(children))
    return out


def places(a: list, b: list) -> dict[str, str]:
    """Place of every path of ``a``: the path of ``b`` it pairs with, else one by its labels."""
    pairs, same = align(a, b)[1], {label: path for path, label in _label_paths(b).items()}
    return {path: pairs.get(path, same.get(label, label)) for path, label in _label_paths(a).items()}


def _alignments(batches):
    import pyarrow as pa
    for batch in batches:
        rows = [(h, m, p, q) for h, m, a, b in zip(*(c.to_pylist() for c in batch.columns))
                for p, q in places(json.loads(a), json.loads(b)).items()]
        columns = list(zip(*rows)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
             pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["host", "mark", "path", "pivot"])


def induce(read: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host, mark, template``: for every layout of a host the paths of its template nodes.

    ``mark`` is the hash of the page's folded tree. Ties for the pivot go to the smaller mark.
    """
    different = (read.select("host", "mark", "paths", "hashes", F.xxhash64("slots.text").alias("body"))
                 .dropDuplicates(["host", "mark", "body"]))  # copies of a page say nothing of its layout
    seen = stored(different.select("host", "mark", F.explode_outer(F.arrays_zip("paths", "hashes")).alias("n"))
                  .groupBy("host", "mark", F.col("n.paths").alias("path"))
                  .agg(F.count(F.lit(1)).alias("pages"), F.min("n.hashes").alias("low"), F.max("n.hashes").alias("high")), "layouts")
    shapes = (seen.groupBy("host", "mark").agg(F.max("pages").alias("pages"))
              .join(read.groupBy("host", "mark").agg(F.first("shape").alias("shape")), ["host", "mark"]))
    pivots = shapes.groupBy("host").agg(F.max_by("shape", F.struct("pages", -F.col("mark"))).alias("pivot_shape"))
    pairs = (shapes.join(pivots, "host").select("host", "mark", "shape", "pivot_shape")
             .mapInArrow(_alignments, "host string, mark bigint, path string, pivot string"))
    mark = F.regexp_extract("path", "#[a-z]+$", 0)  # the first and the last of a repeated node go with it
    placed = (seen.where("path is not null").select("host", "mark", "path", "pages", "low", "high", mark.alias("place"),
                                                    F.regexp_replace("path", "#[a-z]+$", "").alias("node"))
              .join(pairs.withColumnRenamed("path", "node"), ["host", "mark", "node"], "left")
              .withColumn("pivot", F.concat(F.coalesce("pivot", F.concat(F.lit("~"), "mark", F.lit(":"), "node")), "place")))
    fixed = (placed.groupBy("host", "pivot")
             .agg(F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"))
             .where((F.col("pages") >= least_pages) & (F.col("low") == F.col("high"))))
    return (placed.select("host", "mark", "path", "pivot").join(fixed.select("host", "pivot"), ["host", "pivot"])
            .groupBy("host", "mark").agg(F.sort_array(F.collect_set("path")).alias("template")))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: its main text, blocks joined by an empty line.

    A null or empty page gives an empty text. Pages with a null or odd address belong to no host and have no wrapper: they say
    nothing of each other. Repeated pages repeat. Markup cut off at the end, unclosed elements and text without any element are read as they
    stand. An empty table gives no rows. Each page is parsed once: its content blocks and node hashes are written, the
    wrappers come from the hashes, and template blocks are left out by a join.
    """
    read = stored(_pages(pages).select("page_id", "url", "host", "html").mapInArrow(_layouts, LAYOUT_SCHEMA), "pages")
    wrappers = stored(induce(read.where("host <> ''"), least_pages), "wrappers")
    rows = read.select("page_id", "url", "host", "mark", "slots").join(join_side(wrappers), ["host", "mark"], "left")
    rows = rows.withColumn("kept", F.expr(
        "transform(filter(slots, s -> not arrays_overlap(coalesce(template, array()), array(s.path, s.place))), s -> s.text)"))
    text = F.array_join(F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("slots.text")), "\n\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
