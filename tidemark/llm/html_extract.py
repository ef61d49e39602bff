"""Main text of web pages by wrapper induction.

Every page is parsed once into a tree of block elements, where neighbouring siblings of one kind are one repeated node, and its text
blocks.  Pages of a host with the same tree are summarised by Spark: per node the number of pages and
whether its text is constant.  The distinct trees of a host are then aligned by simple tree matching, in levels, into one wrapper.
Nodes with constant text are template; the slot with the varying text is the content.  Elements whose name or class says what they are
(menus, footers, adverts, comments, an article) need no statistics and decide first.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import join_counted, map_arrow, read
from tidemark.session import materialize

# Trees of a host that are aligned in one task; a host with more is aligned in levels, wrappers being the trees of the next one.
TREES = 500
# A text that is constant on so many pages of a host is template.
CONSTANT_PAGES = 3
# Cells of an alignment that are held at once.
CELLS = 4_000_000
# The content slot is narrowed while one child holds this share of the varying text.
MAIN_SHARE = 0.8

# HTML element names by what they do.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset(
    "aside button canvas datalist dialog footer form head iframe input label map menu nav noscript object optgroup option script "
    "search select style svg template textarea title video audio".split()
)
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Words of class names, ids and roles.  A name is boilerplate if all its words are listed and one of them is in the first list.
MARKERS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promos promoted "
    "promotion promotions related replies share sharing sidebar signup social sponsor sponsored sponsors subscribe toolbar widget widgets "
    "contentinfo complementary alert".split()
)
NEUTRAL = frozenset(
    "area articles bar block bottom box buttons column container content form global group inner items left links list main mobile outer "
    "page panel policy posts primary right secondary section site slot top wrap wrapper".split()
)
# These elements hold the article or its headings, whatever their names say.
EXEMPT = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^'\">])*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z0-9]+")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)


@dataclass
class Page:
    """Nodes as ``parent, key, role`` in order of appearance, and text blocks as ``node, text``.

    ``role`` is ``s`` for what is skipped, ``m`` for a main element and ``-`` otherwise.
    """

    nodes: list[tuple[int, str, str]] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)

    @property
    def tree(self) -> str:
        return "\n".join(f"{parent} {role} {key}" for parent, key, role in self.nodes)


def _named_boilerplate(name: str) -> bool:
    words = _WORDS.findall(name.lower())
    return any(w in MARKERS for w in words) and all(w in MARKERS or w in NEUTRAL for w in words)


def _attributes(text: str) -> tuple[list[str], bool]:
    """Class names, ids and roles of a tag, and whether it hides its element."""
    names: list[str] = []
    hidden = False
    for name, *values in _ATTRIBUTE.findall(text):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            names += html.unescape(value).split()
        hidden = hidden or name == "hidden" or name == "style" and bool(_NO_DISPLAY.search(value))
    return names, hidden


def parse_page(source: str) -> Page:
    page = Page([(-1, "", "-")])
    # Open elements: name, node, skipped, main.  last[node] is the last child, for merging repeated siblings.
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    last: dict[int, int] = {}
    text: list[str] = []

    def flush() -> None:
        found = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if found and not stack[-1][2]:
            page.blocks.append((stack[-1][1], found))

    def close(at: int) -> None:
        flush()
        del stack[at:]

    at = 0
    while True:
        token = _TOKEN.search(source, at)
        text.append(source[at : token.start()] if token else source[at:])
        if not token:
            break
        at = token.end()
        if token.group(2) is None:
            continue
        name, attributes = token.group(2).lower(), token.group(3)
        if not source.endswith(">", at - 1, at):
            break  # a tag that the end of the page cut off
        if token.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name == "br":
            text.append(" ")
        names, hidden = _attributes(attributes) if attributes else ([], False)
        skipped = name in SKIPPED or hidden or name not in EXEMPT and any(map(_named_boilerplate, names))
        # A page header is boilerplate, the header of an article is not.
        skipped = skipped or name == "header" and not any(e[3] for e in stack)
        if name in VOID:
            if name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p" or stack[i][0] in ENDS_SAME.get(name, ()):
                    close(i)
                elif stack[i][0] not in ("td", "th") or name != "tr":
                    break
        elif not skipped:
            continue  # inline markup
        else:
            flush() if not stack[-1][2] else None
        main = not skipped and (name in ("article", "main") or "main" in names)
        if main and stack[-1][2] and all(e[0] in ("nav", "header") for e in stack if e[2] and e[0]):
            inherited = False  # an article can't lie in a menu: the menu was never closed
        else:
            inherited = stack[-1][2]
        parent = stack[-1][1]
        role = "s" if skipped or inherited else "m" if main else "-"
        key = " ".join([name, *sorted(names)])
        child = last.get(parent)
        if child is None or page.nodes[child][1:] != (key, role):
            child = len(page.nodes)
            page.nodes.append((parent, key, role))
            last[parent] = child
        stack.append((name, child, skipped or inherited, main or stack[-1][3]))
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(source, at)
            at = end.start() if end else len(source)
    flush()
    return page


_BLOCK = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))
_STAT = pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("chars", pa.int64())]))


def _parse_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees, blocks, stats = [], [], []
        for source in batch.column(3):
            page = parse_page(source.as_py() or "")
            by_node: dict[int, list[str]] = {}
            for node, text in page.blocks:
                by_node.setdefault(node, []).append(text)
            trees.append(page.tree)
            blocks.append([{"node": n, "text": t} for n, t in page.blocks])
            stats.append(
                [
                    {"node": n, "hash": (xxhash.xxh64_intdigest("\n".join(t)) >> 1), "chars": sum(map(len, t))}
                    for n, t in by_node.items()
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(trees, pa.string()), pa.array(blocks, _BLOCK), pa.array(stats, _STAT)],
            names=["page_id", "url", "host", "tree", "blocks", "stats"],
        )


@dataclass(eq=False)
class Node:
    key: str
    role: str
    children: list[Node] = field(default_factory=list)
    pages: int = 0
    low: int | None = None
    high: int | None = None
    chars: int = 0
    keep: bool = False

    def add(self, pages: int, low: int | None, high: int | None, chars: int) -> None:
        if low is not None:
            self.low = low if self.low is None else min(self.low, low)
            self.high = high if self.high is None else max(self.high, high)
            self.pages += pages
            self.chars += chars

    @property
    def constant(self) -> bool:
        return self.pages >= CONSTANT_PAGES and self.low == self.high


def tree_of(text: str, stats: dict[int, tuple]) -> tuple[Node, list[Node]]:
    nodes: list[Node] = []
    for i, line in enumerate(text.split("\n")):
        parent, role, key = line.split(" ", 2)
        node = Node(key, role)
        node.add(*stats.get(i, (0, None, None, 0)))
        if i:
            nodes[int(parent)].children.append(node)
        nodes.append(node)
    return nodes[0], nodes


def _all(root: Node) -> list[Node]:
    """All nodes, parents before children and siblings in order."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack += reversed(node.children)
    return found


class Matcher:
    """Simple tree matching by shapes: equal subtrees have one number, and pairs of shapes are matched once."""

    def __init__(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.kinds: list[tuple[str, str]] = []
        self.children: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def number(self, root: Node) -> dict[int, int]:
        """Shape of every node, by its id."""
        own: dict[int, int] = {}
        for node in reversed(_all(root)):
            below = tuple(own[id(c)] for c in node.children)
            shape = self.shapes.setdefault((node.key, node.role, below), len(self.kinds))
            if shape == len(self.kinds):
                self.kinds.append((node.key, node.role))
                self.children.append(below)
                self.sizes.append(1 + sum(self.sizes[c] for c in below))
            own[id(node)] = shape
        return own

    def score(self, a: int, b: int) -> int | None:
        """Nodes in the best matching of two shapes; None while it waits for shapes below."""
        if a == b:
            return self.sizes[a]
        return 0 if self.kinds[a] != self.kinds[b] else self.known.get((a, b))

    def settle(self, a: int, b: int) -> None:
        """Make the scores of a pair and of all pairs below it known, without recursion."""
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if self.score(x, y) is not None:
                stack.pop()
                continue
            todo = [(c, d) for c in set(self.children[x]) for d in set(self.children[y]) if self.score(c, d) is None]
            if todo:
                stack += todo
                continue
            self.known[x, y] = 1 + sum(self.score(self.children[x][i], self.children[y][j]) for i, j in self.pairs(self.children[x], self.children[y]))
            stack.pop()

    def pairs(self, xs: Sequence[int], ys: Sequence[int]) -> list[tuple[int, int]]:
        """Positions of the best alignment of two runs of shapes in order; all their scores are known.

        Equal shapes at both ends belong together in some best alignment, so only the middle is searched.
        """
        start = 0
        while start < min(len(xs), len(ys)) and xs[start] == ys[start]:
            start += 1
        end = 0
        while end < min(len(xs), len(ys)) - start and xs[-1 - end] == ys[-1 - end]:
            end += 1
        found = [(i, i) for i in range(start)]
        middle = self._middle(np.array(xs[start : len(xs) - end]), np.array(ys[start : len(ys) - end]))
        found += [(start + i, start + j) for i, j in middle]
        return found + [(len(xs) - end + k, len(ys) - end + k) for k in range(end)]

    def _weights(self, x: int, kinds: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.array([self.score(x, int(y)) for y in kinds])[place]

    def _rows(self, xs: np.ndarray, ys: np.ndarray) -> Iterator[np.ndarray]:
        """Best scores of each beginning of ``xs`` with every beginning of ``ys``."""
        kinds, place = np.unique(ys, return_inverse=True)
        cache: dict[int, np.ndarray] = {}
        row = np.zeros(len(ys) + 1, dtype=np.int64)
        yield row
        for x in xs.tolist():
            if x not in cache:
                cache[x] = self._weights(x, kinds, place)
            row = np.maximum.accumulate(np.maximum(row, np.concatenate([[0], row[:-1] + cache[x]])))
            yield row

    def _middle(self, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int]]:
        """Alignment by rows of best scores; long runs are halved where the best scores of both halves add up, to bound memory."""
        found, stack = [], [(0, len(xs), 0, len(ys))]
        while stack:
            a, b, c, d = stack.pop()
            if a == b or c == d:
                continue
            if (b - a) * (d - c) > CELLS and b - a > 1:
                half = (a + b) // 2
                for before in self._rows(xs[a:half], ys[c:d]):
                    pass
                for after in self._rows(xs[half:b][::-1], ys[c:d][::-1]):
                    pass
                cut = c + int(np.argmax(before + after[::-1]))
                stack += [(a, half, c, cut), (half, b, cut, d)]
                continue
            best = list(self._rows(xs[a:b], ys[c:d]))
            i, j = b - a, d - c
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((a + i, c + j))
        return sorted(found)


def merge(wrapper: Node, tree: Node, found: dict[int, Node]) -> None:
    """Merge ``tree`` into ``wrapper``; ``found`` maps its nodes to those of the wrapper."""
    if tree is wrapper:
        found.update((id(n), n) for n in _all(tree))
        return
    matcher = Matcher()
    shapes = matcher.number(wrapper) | matcher.number(tree)
    matcher.settle(shapes[id(wrapper)], shapes[id(tree)])
    stack = [(wrapper, tree)]
    while stack:
        known, node = stack.pop()
        found[id(node)] = known
        known.add(node.pages, node.low, node.high, node.chars)
        xs, ys = ([shapes[id(c)] for c in n.children] for n in (known, node))
        for x in set(xs):
            for y in set(ys):
                matcher.settle(x, y)
        partner = {j: i for i, j in matcher.pairs(xs, ys)}
        children, at = [], 0
        for j, child in enumerate(node.children):
            if j in partner:
                children += known.children[at : partner[j] + 1]
                at = partner[j] + 1
                stack.append((known.children[partner[j]], child))
            else:
                children.append(child)
                found.update((id(n), n) for n in _all(child))
        known.children = children + known.children[at:]


def _varying(root: Node) -> dict[int, int]:
    """Characters of varying text in every subtree, by the node's id."""
    chars: dict[int, int] = {}
    for node in reversed(_all(root)):
        own = 0 if node.role == "s" or node.constant else node.chars
        chars[id(node)] = own + sum(chars[id(c)] for c in node.children if c.role != "s")
    return chars


def label(root: Node) -> None:
    """Mark the nodes whose text is content: the varying ones of the main elements, or else of the slot with the varying text.

    Where nothing varies, as on a host with one text, constant nodes are content as well.
    """
    varying = _varying(root)
    slots = [n for n in _all(root) if n.role == "m"]
    if not slots:
        slot = root
        while True:
            whole = varying[id(slot)]
            narrower = [c for c in slot.children if c.role != "s" and c.children and varying[id(c)] >= MAIN_SHARE * whole > 0]
            if not narrower:
                break
            slot = narrower[0]
        slots = [slot]
    some = any(varying[id(slot)] > 0 for slot in slots)
    for slot in slots:
        for n in _all(slot):
            n.keep = n.role != "s" and not (n.constant and some)


_ALIGNED = (
    "host string, part string, id string, place array<int>, tree string, pages bigint,"
    " stats array<struct<node:int,pages:bigint,low:bigint,high:bigint,chars:bigint>>, keep array<boolean>, varies array<boolean>, has_main boolean"
)


def _align(rows: pd.DataFrame) -> pd.DataFrame:
    """Align the trees of one group: where each node lies in the group's wrapper, and in the first row the wrapper itself."""
    rows = rows.sort_values(["pages", "tree", "id"], ascending=[False, True, True])
    wrapper, placed = None, []
    for row in rows.itertuples():
        stats = {s["node"]: (s["pages"], s["low"], s["high"], s["chars"]) for s in row.stats}
        tree, nodes = tree_of(row.tree, stats)
        found: dict[int, Node] = {}
        wrapper = wrapper or tree
        merge(wrapper, tree, found)
        placed.append([found[id(n)] for n in nodes])
    label(wrapper)
    whole = _all(wrapper)
    number = {id(n): i for i, n in enumerate(whole)}
    parents = {id(c): number[id(n)] for n in whole for c in n.children}
    more = len(rows) - 1
    return pd.DataFrame(
        {
            "host": rows["host"],
            "part": rows["part"],
            "id": rows["id"],
            "place": [[number[id(n)] for n in nodes] for nodes in placed],
            "tree": ["\n".join(f"{parents.get(id(n), -1)} {n.role} {n.key}" for n in whole)] + [None] * more,
            "pages": int(rows["pages"].sum()),
            "stats": [
                [
                    {"node": i, "pages": n.pages, "low": n.low, "high": n.high, "chars": n.chars}
                    for i, n in enumerate(whole)
                    if n.low is not None
                ]
            ]
            + [None] * more,
            "keep": [[n.keep for n in whole]] + [None] * more,
            "varies": [[n.role != "s" and not n.constant for n in whole]] + [None] * more,
            "has_main": any(n.role == "m" for n in whole),
        }
    )


def wrapper_labels(trees: DataFrame) -> DataFrame:
    """``host, tree, keep`` for every row of ``trees(host, tree, pages, stats)``: which nodes hold content.

    Groups of ``TREES`` trees of a host are aligned into wrappers, these again in groups, until each host has one.  A wrapper's
    nodes add up the pages below them, so what is constant is decided once, over all pages of the host.  The labels of that
    wrapper then go back down the levels by the places that were written on the way up.
    """
    source = trees.withColumn("id", F.sha2("tree", 256))
    current, levels = source.select("host", "id", "tree", "pages", "stats"), []
    while True:
        parts = materialize(current.groupBy("host").agg(F.ceil(F.count("*") / TREES).cast("long").alias("parts")))
        grouped = current.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("string"))
        aligned = materialize(grouped.groupBy("host", "part").applyInPandas(_align, _ALIGNED))
        levels.append(aligned)
        wrappers = aligned.filter("tree IS NOT NULL")
        if (parts.agg(F.max("parts")).first()[0] or 1) == 1:
            break
        current = wrappers.selectExpr("host", "part AS id", "tree", "pages", "stats")
    above = wrappers.selectExpr("host", "part", "keep", "varies", "has_main")
    for aligned in reversed(levels):
        found = aligned.select("host", "part", "id", "place").join(above, ["host", "part"])
        labels = found.selectExpr(
            "host", "id", "transform(place, p -> keep[p]) AS keep", "transform(place, p -> varies[p]) AS varies", "has_main"
        )
        above = labels.withColumnRenamed("id", "part")
    # Where the host marks its articles and a page has none, only what is not template counts.
    own_main = F.col("tree").rlike(r"(?m)^-?\d+ m ")
    keep = F.when(F.col("has_main") & ~own_main, F.col("varies")).otherwise(F.col("keep"))
    return source.select("host", "id", "tree").join(labels, ["host", "id"]).select("host", "tree", keep.alias("keep"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages(page_id, url, html)``; other columns are not read.

    Null html and pages without content have the empty text; pages without a url form one host.  Character references are
    decoded, white space inside a block is one space, blocks are joined by an empty line in page order.
    """
    source = pages.select(
        "page_id", "url",
        F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit("")).alias("host"),
        F.col("html").cast("string").alias("html"),
    )
    id_type = dict(source.dtypes)["page_id"]
    parsed = materialize(
        map_arrow(
            source,
            _parse_batches,
            f"page_id {id_type}, url string, host string, tree string, blocks array<struct<node: int, text: string>>,"
            " stats array<struct<node: int, hash: bigint, chars: bigint>>",
        )
    )
    counted = parsed.groupBy("host", "tree").agg(F.count("*").alias("pages"))
    # Constant or not, by node: minimum and maximum hash combine before the shuffle, so a busy host costs no more than others.
    nodes = (
        parsed.select("host", "tree", F.explode("stats").alias("s"))
        .groupBy("host", "tree", "s.node")
        .agg(
            F.count("*").alias("pages"), F.min("s.hash").alias("low"), F.max("s.hash").alias("high"), F.sum("s.chars").alias("chars")
        )
        .groupBy("host", "tree")
        .agg(F.collect_list(F.struct("node", "pages", "low", "high", "chars")).alias("stats"))
    )
    trees = counted.join(nodes, ["host", "tree"], "left").withColumn(
        "stats", F.coalesce("stats", F.array().cast("array<struct<node:int,pages:bigint,low:bigint,high:bigint,chars:bigint>>"))
    )
    trees = materialize(trees)
    labels = materialize(wrapper_labels(trees).join(counted, ["host", "tree"]).withColumnRenamed("pages", "n"))
    kept = F.transform(F.filter("blocks", lambda b: F.get("keep", b["node"])), lambda b: b["text"])
    return join_counted(
        parsed.select("page_id", "url", "host", "tree", "blocks"), labels, ["host", "tree"], "n", parsed.count()
    ).select("page_id", "url", F.array_join(kept, "\n\n").alias("text"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )
