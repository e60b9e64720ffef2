"""Main text of web pages by wrapper induction.

Each host has one wrapper, induced from the GROUP distinct pages of least hash and applied to all its pages, so that a
page's text depends neither on partitions nor on its place among them. Pages are range-partitioned by host and sorted
by hash; the first ones of a host are its sample. A hot host is dealt over many tasks, and its sample is taken before.
The first page's tree of the sample is the wrapper, and every page is aligned with it by simple tree matching
(children in order, equal tags). Nodes whose text is equal in all pages are template; nodes whose text differs and
places where pages have additional nodes are varying. The content slot is the smallest container that holds everything
varying; a page's main text is what stands in the node that is matched with it. Inside the slot, nodes equal in all
pages are left out where they stand before or after all that varies, and containers also between; equal lines between
varying ones are text. Where there is no evidence (one page of a host, or equal pages only) the slot is the page's
article or main element, else its body. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and comments, known by element, role or class name, are cut before the alignment.

Defined results: null or empty html has empty text; unknown or null hosts form one group; repeated rows and null ids
keep their rows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from math import isqrt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks

#: Distinct pages of a host, those of least hash, that induce its wrapper.
GROUP = 64
#: Pages from which a host is dealt over several tasks, and the most hosts that are, whose samples every task gets.
HOT, MAX_HOT = 10_000, 50

_PART = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[^<]+|<""", re.S
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea svg iframe object select title xmp".split())
_CUT = frozenset("head nav header footer aside form button dialog menu label figure-ad".split()) | _RAW
_BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p "
    "pre section summary table tbody td tfoot th thead tr ul".split()
)
_BOX = frozenset("article body center div html main section td".split())
#: Elements that end an open element of the same kind, and the ones at which the search for it stops.
_CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}
_IN_P = frozenset({"p"})
_P_STOP = frozenset("article body div section td li main blockquote table".split())
#: Elements that hold others; of those that hold a line of text only advert words as whole class names are taken.
_HOLDERS = frozenset("div section ul ol dl table tbody tr td figure header footer center fieldset details iframe".split())
_ADVERT = frozenset("ad ads advert adverts advertisement sponsored sponsor promo promoted cookie cookies consent newsletter".split())
#: Roles and class or id words of what isn't the article.
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "header menu modal nav navbar navigation newsletter notice notices notification popup promo promoted related respond share "
    "sharing sidebar sidebars skip social sponsor sponsored subscribe toolbar widget".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "items", "children", "text", "key", "vary", "gaps", "template", "parent")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.items: list[Node | str] = []
        self.children: list[Node] = []
        self.text = ""
        self.key = 0
        self.vary = False  # own text or children differ between pages
        self.gaps: set[int] = set()  # places among the children where pages have additional nodes
        self.template = False  # equal on all pages and outside of what varies


def _boilerplate(tag: str, attrs: str) -> bool:
    if tag in _CUT:
        return True
    if not attrs or tag in ("article", "main", "body", "html"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name = name.lower()
        value = (a or b or c).lower()
        if (name == "role" and value in _ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name in ("class", "id") and not (_WORDS.isdisjoint(_SPLIT.split(value)) if tag in _HOLDERS else _ADVERT.isdisjoint(value.split())):
            return True
    return False


def parse(page: str) -> Node:
    """Tree of the page without boilerplate; text is decoded."""
    root = Node("#", None)
    here, skip, at = root, 0, 0  # skip: depth inside an element that is cut
    skipped = ""
    while m := _PART.match(page, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            if not skip and (m[0][0] != "<" or m[0] == "<"):
                here.items.append(html.unescape(m[0]))
            continue
        tag = tag.lower()
        if m[1]:
            if skip:
                if tag == skipped:
                    skip -= 1
                continue
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            elif tag == "p":
                here.items.append(Node("p", here))
            continue
        closed = m[3].endswith("/")
        if skip:
            if tag == skipped and tag not in _VOID and not closed:
                skip += 1
            continue
        if tag in _RAW and not closed:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        ends, stops = _CLOSES.get(tag, (_IN_P, _P_STOP) if tag in _BLOCK else (None, None))
        if ends:
            node = here
            while node is not root and node.tag not in ends and node.tag not in stops:
                node = node.parent
            if node.tag in ends:
                here = node.parent
        if _boilerplate(tag, m[3]):
            if tag not in _VOID and not closed:
                skip, skipped = 1, tag
            else:
                here.items.append(" ")
            if tag in _BLOCK or tag in _CUT:
                here.items.append(Node("hr", here))
            continue
        node = Node(tag, here)
        here.items.append(node)
        if tag not in _VOID and not closed:
            here = node
    return root


def _finish(root: Node) -> None:
    """Own text, element children and a hash of the subtree; without recursion, as trees may be deep."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.children = [x for x in node.items if isinstance(x, Node) and x.tag != "hr"]  # rules stand for what was cut, too
        node.text = " ".join("".join(x for x in node.items if isinstance(x, str)).split())
        stack += node.children
    for node in reversed(order):
        node.key = hash((node.tag, node.text, tuple(x.key for x in node.children)))


def _pairs(w: Node, p: Node) -> tuple[list[tuple[Node, Node]], list[tuple[Node, Node]]]:
    """Children matched as equal subtrees at either end, and children matched between those."""
    a, b = w.children, p.children
    low = 0
    while low < len(a) and low < len(b) and a[low].key == b[low].key:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high].key == b[-1 - high].key:
        high += 1
    ends = list(zip(a[:low], b[:low])) + (list(zip(a[-high:], b[-high:])) if high else [])
    return ends, _matched(a[low : len(a) - high], b[low : len(b) - high])


def align(wrapper: Node, page: Node) -> None:
    """Simple tree matching of page with wrapper, top down; marks the wrapper's nodes that vary."""
    stack = [(wrapper, page)]
    while stack:
        w, p = stack.pop()
        if w.key == p.key:
            continue
        if w.text != p.text:
            w.vary = True
        if not w.children and not p.children:
            continue
        ends, pairs = _pairs(w, p)
        if len(ends) + len(pairs) < max(len(w.children), len(p.children)):
            w.vary = True
            of = {id(y): x for x, y in ends + pairs}
            met = {id(x) for x in of.values()}
            for x in w.children:
                if id(x) not in met:
                    x.vary = True
            place = {id(x): i for i, x in enumerate(w.children)}
            at = 0
            for y in p.children:
                if id(y) in of:
                    at = place[id(of[id(y)])] + 1
                else:
                    w.gaps.add(at)
        stack += pairs


def _weight(a: Node, b: Node) -> int:
    """Least size of a match of two subtrees: 1 for the nodes, 1 for each pair of children in common by tag."""
    if a.tag != b.tag:
        return 0
    if a.key == b.key:
        return 2 + len(a.children)
    return 1 + min(len(a.children), len(b.children))


def _matched(a: list[Node], b: list[Node]) -> list[tuple[Node, Node]]:
    """Pairs of the heaviest ordered matching of two child lists; of equal ones the pair of the earliest nodes goes first.

    Rows of the table of best weights are made from the last to the first. Long lists keep each k-th row, k about the root of
    their number, and make the rows between again on the way back, so that memory grows with the root of the table."""
    if len(a) == len(b) and all(x.tag == y.tag for x, y in zip(a, b)):
        return list(zip(a, b))
    n, m = len(a), len(b)
    if not n or not m:
        return []
    row_of = _listed_row(b) if n * m <= 2000 else _array_row(b)
    step = n if n * m <= 2000 else max(1, isqrt(n))
    held = {}
    row = [0] * (m + 1) if n * m <= 2000 else np.zeros(m + 1, np.int64)
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            held[i + 1] = row
        row = row_of(a[i], row)
    out, j = [], 0
    for start in range(0, n, step):
        end = min(start + step, n)
        rows = [held[end]]
        for i in range(end - 1, start - 1, -1):
            rows.append(row_of(a[i], rows[-1]))
        rows.reverse()
        for i in range(start, end):
            here, below = rows[i - start], rows[i - start + 1]
            while j < m and here[j] != below[j] or j < m and (w := _weight(a[i], b[j])) and here[j] == w + below[j + 1]:
                w = _weight(a[i], b[j])
                if w and here[j] == w + below[j + 1]:
                    out.append((a[i], b[j]))
                    j += 1
                    break
                j += 1
    return out


def _listed_row(b: list[Node]):
    def row_of(x: Node, below: list[int]) -> list[int]:
        row = [0] * len(below)
        for j in range(len(b) - 1, -1, -1):
            w = _weight(x, b[j])
            top = below[j] if below[j] > row[j + 1] else row[j + 1]
            row[j] = w + below[j + 1] if w and w + below[j + 1] > top else top
        return row

    return row_of


def _array_row(b: list[Node]):
    """The same with arrays: the best to the right is a running maximum."""
    names: dict[str, int] = {}
    tags = np.array([names.setdefault(y.tag, len(names)) for y in b])
    keys = np.array([y.key for y in b], np.int64)
    sizes = np.array([len(y.children) for y in b])

    def row_of(x: Node, below: np.ndarray) -> np.ndarray:
        n = len(x.children)
        w = np.where(keys == x.key, 2 + n, 1 + np.minimum(sizes, n))
        best = np.maximum(below[:-1], np.where(tags == names.get(x.tag, -1), w + below[1:], 0))
        return np.append(np.maximum.accumulate(best[::-1])[::-1], 0)

    return row_of


def find_slot(wrapper: Node) -> Node | None:
    """Smallest container of all that varies, with its template nodes marked; None without evidence."""
    order, stack = [], [wrapper]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.children
    varied: dict[int, int] = {}  # varying children of a node; a node is varying if it or one of its nodes is
    for node in reversed(order):
        if (node.vary or varied.get(id(node))) and node.parent is not None:
            varied[id(node.parent)] = varied.get(id(node.parent), 0) + 1
    if not wrapper.vary and not varied.get(id(wrapper)):
        return None
    node = wrapper
    while not node.vary and varied.get(id(node)) == 1:
        node = next(x for x in node.children if x.vary or varied.get(id(x)))
    while node.parent is not None and node.tag not in _BOX:
        node = node.parent
    up = node
    while up is not None:  # what varies in an article may be a part of it
        if up.tag in ("article", "main"):
            node = up
        up = up.parent
    _mark(node, varied)
    return node


def _mark(slot: Node, varied: dict[int, int]) -> None:
    """Template nodes of a slot: what is equal on all pages before and after all that varies, and equal containers between.

    Equal lines between varying ones belong to the text that they stand in.
    """
    stack = [slot]
    while stack:
        node = stack.pop()
        moves = [x.vary or id(x) in varied for x in node.children]
        places = [i for i, m in enumerate(moves) if m]
        first = min(places + [g for g in node.gaps], default=0)
        last = max(places + [g - 1 for g in node.gaps], default=len(moves) - 1)
        for i, (x, m) in enumerate(zip(node.children, moves)):
            if m:
                if x.tag in _BOX and x.tag != "td":  # a table's cells stand together
                    stack.append(x)
            elif (not first <= i <= last and x.tag in _BLOCK) or x.tag in _BOX:
                x.template = True


def locate(wrapper: Node, slot: Node, page: Node) -> tuple[Node | None, set[int]]:
    """The page's node that is matched with the slot, and the ids of its nodes that equal template nodes."""
    way = [slot]
    while way[-1] is not wrapper:
        way.append(way[-1].parent)
    here = page
    for w, below in zip(reversed(way), list(reversed(way))[1:]):
        ends, pairs = _pairs(w, here)
        here = next((y for x, y in ends + pairs if x is below), None)
        if here is None:
            return None, set()
    drop: set[int] = set()
    stack = [(slot, here)]
    while stack:
        w, p = stack.pop()
        ends, pairs = _pairs(w, p)
        for x, y in ends + pairs:
            if x.template:
                if x.key == y.key:
                    drop.add(id(y))
            elif x.tag in _BOX:
                stack.append((x, y))
    return here, drop


def _outer(root: Node, tags: frozenset[str]) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in tags:
            out.append(node)
        else:
            stack += reversed(node.children)
    return out


def slots(wrapper: Node, slot: Node | None, page: Node) -> tuple[list[Node], set[int]]:
    """The page's node in the slot and what to leave out of it; without one its article or main elements, else the whole page."""
    if slot is not None:
        here, drop = locate(wrapper, slot, page)
        if here is not None:
            return [here], drop
    return _outer(page, frozenset({"article", "main"})) or [page], set()


def text_of_nodes(nodes: list[Node], drop: set[int]) -> str:
    """Blocks in page order but those of drop, white space inside a block as one space."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held and (line := " ".join("".join(held).split())):
            out.append(line)
        held.clear()

    for root in nodes:
        stack: list[Node | str | None] = [root]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                held.append(x)
            elif x is None:
                close()
            elif id(x) in drop:
                close()
            elif x.tag == "br":
                held.append(" ")
            else:
                if x.tag in _BLOCK:
                    close()
                    stack.append(None)
                stack += reversed(x.items)
        close()
    return "\n".join(out)


class Wrapper:
    """Tree and slot of a host's sample of pages; the pages must differ for a slot."""

    def __init__(self, pages: list[str]) -> None:
        self.tree, *rest = map(tree, pages)
        for t in rest:
            align(self.tree, t)
        self.slot = find_slot(self.tree)

    def text(self, page: str) -> str:
        return text_of_nodes(*slots(self.tree, self.slot, tree(page)))


def tree(page: str) -> Node:
    root = parse(page)
    _finish(root)
    return root


def extract(pages: list[str]) -> list[str]:
    """Main texts of pages of one host; the first GROUP of them induce the wrapper."""
    wrapper = Wrapper(pages[:GROUP])
    return [wrapper.text(p) for p in pages]


def _samples(rows: DataFrame, hot: DataFrame) -> dict[str, list[str]]:
    """The GROUP distinct pages of least hash of each hot host, in that order."""
    of = rows.join(F.broadcast(hot.select("host")), "host")
    order = Window.partitionBy("host").orderBy("__h")
    keys = of.select("host", "__h").distinct().withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= GROUP)
    cut = keys.groupBy("host").agg(F.max("__h").alias("__to"))
    picked = of.join(F.broadcast(cut), "host").where(F.col("__h") <= F.col("__to")).groupBy("host", "__h").agg(F.first("html").alias("html"))
    out: dict[str, list[tuple[int, str]]] = {}
    for r in picked.toLocalIterator():
        out.setdefault(r.host, []).append((r["__h"], r.html))
    return {k: [x for _, x in sorted(v, key=lambda y: y[0])] for k, v in out.items()}


def main_texts(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars; one row for each input row."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    rows = rows.withColumn("__h", F.xxhash64("page_id", "url", "html"))

    spark = pages.sparkSession
    most = max(HOT, pages.count() // MAX_HOT)
    found = pages.select(host.alias("host")).groupBy("host").count().where(F.col("count") > most).collect()  # MAX_HOT rows at most
    hot = spark.createDataFrame([(r["host"], r["count"] // most + 1) for r in found], "host string, parts long")
    samples = _samples(rows, hot) if found else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # hash -> page, its id and url and how often it came, until the host's sample is whole
        host, wrapper = None, None

        def out(found: list[tuple]) -> pa.RecordBatch:
            texts = [wrapper.text(x[2]) for x in found]
            ids, urls = [x[0] for x in found], [x[1] for x in found]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

        def release() -> Iterator[pa.RecordBatch]:
            nonlocal wrapper
            if held:
                wrapper = Wrapper([x[2] for x in held.values()])
                for page_id, url, page, n in held.values():
                    one = out([(page_id, url, page)])
                    for at in range(0, n, 1000):
                        yield pa.RecordBatch.from_arrays([c.take(pa.array([0] * min(1000, n - at))) for c in one.columns], names=one.schema.names)
                held.clear()

        for b in blocks(batches, "html"):
            ready: list[tuple] = []
            for r in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "html", "host", "__h")]):
                if r[3] != host:
                    if ready:
                        yield out(ready)
                        ready = []
                    yield from release()
                    host = r[3]
                    wrapper = Wrapper(samples[host]) if host in samples else None
                if wrapper is None and r[4] in held:
                    held[r[4]][3] += 1
                    continue
                if wrapper is None and len(held) < GROUP:
                    held[r[4]] = [*r[:3], 1]
                    continue
                if wrapper is None:
                    yield from release()
                ready.append(r)
            if ready:
                yield out(ready)
        yield from release()

    if found:
        rows = rows.join(F.broadcast(hot), "host", "left")
        rows = rows.withColumn("__part", F.pmod("__h", F.coalesce("parts", F.lit(1)))).drop("parts")
    else:
        rows = rows.withColumn("__part", F.lit(0))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a host that isn't hot has one part, and so meets in one task
    ordered = rows.repartitionByRange(n, "host", "__part").sortWithinPartitions("host", "__h")
    return ordered.select("page_id", "url", "html", "host", "__h").mapInArrow(run, "page_id long, url string, text string, n_chars long")
