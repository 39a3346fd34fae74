"""HTML extraction by wrapper induction.

Pages of a host that have the same layout (the same set of paths of outer elements) share a wrapper; the page with the
least hash is its exemplar, and layouts of fewer than PAGES pages share the one of the host's most frequent layout.  Each
page is aligned with its exemplar by simple tree matching: trees of block elements, equal labels (tag and class) match,
children are aligned in order by dynamic programming, and equal texts count twice.  Two things are then added up over
all different pages of the wrapper:

* the region: how much text stands under each aligned element, links and barred elements left out.  From the root the
  way goes down to the child that holds most of it, until no child does, or an article or an element with prose of its own is reached.
* the template: runs of text inside the region that have the same text in nearly all pages that have them.  Runs that
  vary are slots.

The text of a page is what stands in the element that is aligned with the region: its slots, also those that the exemplar
lacks, without runs that have the template's constant text.  Constant texts of fewer than SURE pages go only if less
than half of the region does: such pages may be copies of one another.  A page without a wrapper is its own exemplar.

Some knowledge is prior: menus, footers, asides, forms, dialogues and what never shows are barred by tag, role or hidden
attribute; containers (no paragraphs, headings or other blocks of prose) whose class or id is one of the words
NAMES count little in the choice of the region and are left out of its text, unless they hold most of it outside an
article.

Counts are added up over all pages; a host with a third of all pages is counted like any other, as pages meet only in
sums; exemplars are broadcast below a checked size, joined by host, layout and salt beyond.

Defined results: null or empty html gives an empty text; a null or unparsable url is a host of its own kind (empty name);
broken markup is read as far as it goes; trees of any depth and lists of any length are aligned exactly, in memory that is
bounded; repeated rows count as one page in the statistics and give a result each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import SALTS, slices, table, text_of
from seqloom.session import materialize, scratch

#: Pages of a layout that make a wrapper, and the share of the different pages with a node that have its constant text.
PAGES = 3
CONSTANT = 0.95
#: A constant text of fewer pages goes only where such texts are less than half of the region: pages may be copies.
SURE = 8
#: Share of an element's text that a child must hold to be the region in its place.
MOST = 0.6
#: What text in a container with one of the NAMES counts, and what an article's counts.
LITTLE, MUCH = 0.25, 4.0
#: Depth of the paths that tell layouts apart.
DEPTH = 4
#: Cells of an alignment that are held at once.
CELLS = 1 << 22
#: Cells of an alignment that is kept from weighing to pairing.
KEPT = 1 << 16
#: Exemplars and templates are broadcast up to this size.
BROADCAST_BYTES = 16 << 20

# Elements that make blocks, and the start tags that end an open element: fixed values of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
ENDED_BY = {
    "p": BLOCKS - {"option", "optgroup", "html", "head", "body", "title", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "legend"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select xmp noembed noframes".split())
#: Never part of an article.
BARRED_TAGS = frozenset("head nav footer aside form dialog menu button fieldset search".split())
BARRED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption address summary html body article main".split())
#: Elements on the way from the root to the region, and prose that ends it where it stands beside them.
OUTER = frozenset("#root html body div section center table tbody tr td article main".split())
BESIDE_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Words for which a class or an id of a container is prior knowledge.
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs masthead "
    "footer sidebar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social "
    "comment comments commentlist respond replies disqus related recommended widget widgets toolbar pagination pager skip".split()
)
#: Words that may stand beside them, joined by ``-`` or ``_``.
BESIDE = frozenset("left right top bottom inner outer box area bar block list item items link links form thread posts site page global wrapper container icons buttons".split())
TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)


class Node:
    """An element, or a run of text (tag ``#``)."""

    __slots__ = ("tag", "label", "children", "text", "barred", "named", "links", "index", "listed")

    def __init__(self, tag: str, label: str, barred: bool = False, named: bool = False, text: str = "", links: int = 0):
        self.tag, self.label, self.barred, self.named, self.text, self.links = tag, label, barred, named, text, links
        self.children: list[Node] = []
        self.index = -1
        self.listed: Listed | None = None


@lru_cache(4096)
def prior(word: str) -> bool:
    """Whether a class or an id is one of the NAMES, alone or beside others and words like ``left``."""
    parts = re.split(r"[-_]+", word)
    return not NAMES.isdisjoint(parts) and all(p in NAMES or p in BESIDE or p.isdigit() for p in parts)


def parse(html: str) -> Node:
    """The tree of block elements and runs of text; inline markup is part of the runs."""
    root = Node("#root", "#root")
    stack, words, linked, link = [root], [], 0, 0

    def flush() -> None:
        nonlocal linked
        if words:
            text = " ".join(unescape("".join(words)).split())
            if text:
                stack[-1].children.append(Node("#", "#", text=text, links=linked))
            words.clear()
        linked = 0

    at, size = 0, len(html)
    for m in TOKEN.finditer(html):
        if m.start() < at:  # inside an element whose content is raw
            continue
        if m.start() > at:
            words.append(html[at : m.start()])
            linked += (m.start() - at) * (link > 0)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag == "a":
                link = max(0, link - 1)
            if tag == "p" and not any(n.tag == "p" for n in stack):
                flush()
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            # an inline element that is a node ends only where it stands open above all blocks
            if depth and (tag in BLOCKS or not any(n.tag in BLOCKS for n in stack[depth + 1 :])):
                flush()
                del stack[depth:]
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at) if not attributes.endswith("/") else None
            if end:
                at = end.end()
            elif tag in ("script", "style", "textarea", "title") and not attributes.endswith("/"):
                at = size
            continue
        if tag == "br" or tag == "hr":
            words.append(" ")
        if tag == "a":
            link += 1
        if tag in VOID:
            continue
        barred, named, kind = tag in BARRED_TAGS, False, ""
        if attributes and ("=" in attributes or "hidden" in attributes):
            for name, value in ATTRIBUTE.findall(attributes):
                value, name = value.strip("\"'"), name.lower()
                if name == "role":
                    barred = barred or value.lower() in BARRED_ROLES
                    if value.lower() == "main" and tag != "body":
                        tag = "main"
                elif name in ("class", "id"):
                    kind += f".{value}" if name == "class" else ""
                    named = named or any(prior(word) for word in value.lower().split())
                elif value.lower() == "true" or name == "hidden":
                    barred = barred or tag not in ("html", "body")
        named = named and tag not in PROSE
        if tag in BLOCKS or barred or named or tag == "main":
            flush()
            while len(stack) > 1 and tag in ENDED_BY.get(stack[-1].tag, ()):
                stack.pop()
            if tag in ("html", "body") and any(n.tag == tag for n in stack):
                continue
            if stack[-1].tag == "head" and tag == "body":
                stack.pop()
            if tag == "header":  # of the page, if it is not an article's
                barred = barred or not any(n.tag in ("article", "main") for n in stack)
            node = Node(tag, tag + kind, barred, named)
            stack[-1].children.append(node)
            stack.append(node)
    if at < size:
        words.append(html[at:])
    flush()
    return root


def walk(root: Node) -> Iterator[tuple[Node, Node | None]]:
    """Nodes of a tree in page order, each with its parent."""
    work: list[tuple[Node, Node | None]] = [(root, None)]
    while work:
        now, above = work.pop()
        yield now, above
        work.extend((x, now) for x in reversed(now.children))


def leaves(node: Node, named: bool = True) -> Iterator[Node]:
    """Runs of text that no barred element below ``node`` holds, in page order; ``named``: nor one with one of the NAMES."""
    work = [node]
    while work:
        now = work.pop()
        if now.tag == "#":
            yield now
        elif now is node or not (now.barred or named and now.named):
            work.extend(reversed(now.children))


def layout(root: Node) -> int:
    """A hash of the set of paths of outer containers."""
    paths, work = set(), [(root, "", 0)]
    while work:
        now, path, depth = work.pop()
        if now.tag == "#" or now.tag in PROSE and now.tag not in ("html", "body", "article", "main"):
            continue
        path = f"{path}/{now.label}"
        paths.add(path)
        if depth < DEPTH:
            work.extend((x, path, depth + 1) for x in now.children)
    return mark("\n".join(sorted(paths)))


# ---- simple tree matching -----------------------------------------------------------------------------------------


class Listed:
    """Children of an element in arrays: numbers of labels and of texts, and how many runs a leaf holds (-1: it is one)."""

    __slots__ = ("nodes", "labels", "texts", "size", "inner")

    def __init__(self, nodes: list[Node]):
        self.nodes, self.inner = nodes, []
        labels, texts, size = [], [], []
        for k, node in enumerate(nodes):
            labels.append(hash(node.label))
            children = node.children
            if node.tag == "#":
                texts.append(hash(node.text))
                size.append(-1)
            elif not children:
                texts.append(0)
                size.append(0)
            elif len(children) == 1 and children[0].tag == "#":
                texts.append(hash(children[0].text))
                size.append(1)
            else:
                texts.append(0)
                size.append(0)
                self.inner.append(k)
        self.labels, self.texts, self.size = np.array(labels, np.int64), np.array(texts, np.int64), np.array(size, np.int8)

    def part(self, low: int, high: int, step: int = 1) -> Listed:
        return Listed(self.nodes[low:high][::step])


class Matcher:
    """Weights of matches of two trees' nodes: how many nodes the largest order-preserving match of their subtrees has,
    equal texts counted twice.  Pairs are worked off from a list, so trees can have any depth."""

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def listed(node: Node) -> Listed:
        if node.listed is None:
            node.listed = Listed(node.children)
        return node.listed

    def weights(self, a: Listed, b: Listed) -> np.ndarray:
        """The weights of all pairs; pairs of elements that are no leaves must be known."""
        same = a.labels[:, None] == b.labels
        # a run: 1, or 2 with the same text; a leaf: 1, and its run's weight if both have one
        equal = (a.texts[:, None] == b.texts) + np.int64(1)
        if len(a.nodes) == 1 and a.nodes[0].tag == "#":
            out = same * equal
        else:
            out = same * np.where((a.size < 0)[:, None], equal, 1 + ((a.size == 1)[:, None] & (b.size == 1)) * equal)
        for i in a.inner:
            for j in np.flatnonzero(same[i]).tolist():
                key = id(a.nodes[i]), id(b.nodes[j])
                out[i, j] = self.known[key] if key in self.known else self._mixed(a.nodes[i], b.nodes[j])
        for j in b.inner:
            for i in np.flatnonzero(same[:, j]).tolist():
                if (id(a.nodes[i]), id(b.nodes[j])) not in self.known:
                    out[i, j] = self._mixed(a.nodes[i], b.nodes[j])
        return out

    def _mixed(self, a: Node, b: Node) -> int:
        """The weight of a pair of which one at least is a leaf."""
        return 1 + max((2 if x.text == y.text else 1 for x in a.children if x.tag == "#" for y in b.children if y.tag == "#"), default=0)

    def __call__(self, a: Node, b: Node) -> int:
        if a.label != b.label:
            return 0
        if a.tag == "#":
            return 2 if a.text == b.text else 1
        work = [(a, b)]
        while work:
            x, y = work[-1]
            if (id(x), id(y)) in self.known:
                work.pop()
                continue
            left, right = self.listed(x), self.listed(y)
            need = [
                (left.nodes[i], right.nodes[j])
                for i in left.inner
                for j in right.inner
                if left.nodes[i].label == right.nodes[j].label and (id(left.nodes[i]), id(right.nodes[j])) not in self.known
            ]
            if need:
                work.extend(need)
                continue
            if len(left.nodes) * len(right.nodes) <= CELLS:
                weights = self.weights(left, right)
                table = _table(weights)
                if weights.size <= KEPT:
                    self.tables[id(x), id(y)] = weights, table
                best = table[-1, -1]
            else:
                best = self.last(left, right)[-1]
            self.known[id(x), id(y)] = 1 + int(best)
            work.pop()
        return self.known[id(a), id(b)]

    def last(self, left: Listed, right: Listed) -> np.ndarray:
        """The last row of the alignment's table, in slices of rows."""
        row = np.zeros(len(right.nodes) + 1, np.int64)
        step = max(1, CELLS // max(1, len(right.nodes)))
        for low in range(0, len(left.nodes), step):
            row = _table(self.weights(left.part(low, low + step), right), row)[-1]
        return row

    def pairs(self, a: Node, b: Node) -> list[tuple[int, int]]:
        """An alignment of children of the largest weight; long lists are halved until their table is small enough."""
        left, right = self.listed(a), self.listed(b)
        out, work = [], [(0, len(left.nodes), 0, len(right.nodes))]
        while work:
            low, high, start, stop = work.pop()
            if low == high or start == stop:
                continue
            whole = (high - low, stop - start) == (len(left.nodes), len(right.nodes))
            if (high - low) * (stop - start) > CELLS and high - low > 1:
                mid = (low + high) // 2
                first = self.last(left.part(low, mid), right.part(start, stop))
                second = self.last(left.part(mid, high, 1).part(0, high - mid, -1), right.part(start, stop, -1))[::-1]
                cut = start + int((first + second).argmax())
                work += [(low, mid, start, cut), (mid, high, cut, stop)]
                continue
            if whole and (id(a), id(b)) in self.tables:
                weights, table = self.tables[id(a), id(b)]
            else:
                weights = self.weights(left.part(low, high), right.part(start, stop))
                table = _table(weights)
            i, j = weights.shape
            weights, table = weights.tolist(), table.tolist()
            while i and j:
                weight = weights[i - 1][j - 1]
                if weight and table[i][j] == table[i - 1][j - 1] + weight:
                    out.append((low + i - 1, start + j - 1))
                    i, j = i - 1, j - 1
                elif table[i][j] == table[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return out


def _table(weights: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """The alignment's table, row by row, after a first row."""
    n, m = weights.shape
    table = np.zeros((n + 1, m + 1), np.int64)
    if first is not None:
        table[0] = first
    for i in range(n):
        row = table[i + 1, 1:]
        np.add(table[i, :-1], weights[i], out=row)
        np.maximum(row, table[i, 1:], out=row)
        np.maximum.accumulate(row, out=row)
    return table


def align(a: Node, b: Node) -> dict[int, int]:
    """For the nodes of ``a`` that match one of ``b``: id of the node, index of its match."""
    match, found, work = Matcher(), {}, [(a, b)]
    match(a, b)
    while work:
        a, b = work.pop()
        if a.label != b.label:
            continue
        found[id(a)] = b.index
        if len(a.children) == 1 == len(b.children) and a.children[0].label == b.children[0].label:
            work.append((a.children[0], b.children[0]))
        elif a.children and b.children:
            work += [(a.children[i], b.children[j]) for i, j in match.pairs(a, b)]
    return found


# ---- wrappers -----------------------------------------------------------------------------------------------------


@lru_cache(256)
def exemplar(html: str) -> Node:
    root = parse(html)
    for index, (node, _) in enumerate(walk(root)):
        node.index = index
    return root


def masses(root: Node, found: dict[int, int]) -> dict[int, float]:
    """Text under each element of the exemplar, by index: a run counts for the deepest of its elements that is aligned,
    little in a container with one of the NAMES, much in an article, nothing in barred elements and links."""
    out: dict[int, float] = {}
    work = [(root, found.get(id(root), -1), 1.0)]
    while work:
        now, at, factor = work.pop()
        if now.tag == "#":
            if (size := len(now.text) - now.links) > 0:
                out[at] = out.get(at, 0.0) + factor * size
        elif not now.barred:
            factor = factor * LITTLE if now.named else max(factor, MUCH) if now.tag in ("article", "main") else factor
            at = found.get(id(now), at)
            work += [(x, at, factor) for x in now.children]
    return out


def region(root: Node, mass: dict[int, float]) -> int:
    """The index of the element that is the article of pages with these masses."""
    order = [x for x in walk(root) if x[0].tag != "#"]
    total = {id(x): mass.get(x.index, 0.0) for x, _ in order}
    for x, above in reversed(order):
        if above is not None:
            total[id(above)] += total[id(x)]
    now = root
    while now.tag not in ("article", "main") and not any(x.tag in BESIDE_PROSE and total[id(x)] for x in now.children):
        inner = [x for x in now.children if x.tag in OUTER]
        best = max(inner, key=lambda x: total[id(x)], default=None)
        if best is None or not total[id(best)] or total[id(best)] < MOST * total[id(now)]:
            break
        now = best
    return now.index


def runs_of(top: Node, inside: bool) -> list[Node]:
    """The runs of an element's text; ``inside``: it is an article or in one, else lists of links go too."""
    kept = list(leaves(top))
    if inside:
        return kept
    everything = list(leaves(top, named=False))
    if sum(len(x.text) for x in kept) < (1 - MOST) * sum(len(x.text) for x in everything):
        kept = everything  # most of the text has one of the names
    return [x for x in kept if not (x.links > 0.6 * len(x.text) and len(x.text) < 200)]


def placed(root: Node, example: str, place: int) -> list[tuple[Node, int]] | None:
    """Runs of a page in the element that is aligned with the exemplar's node ``place``, each with the index of the
    exemplar's run that it matches, or -1; None if the page has no such element or no text there."""
    found = align(root, exemplar(example))
    inside, work = False, [(root, False)]
    while work:
        now, inside = work.pop()
        inside = inside or now.tag in ("article", "main")
        if found.get(id(now)) == place:
            out = [(x, found.get(id(x), -1)) for x in runs_of(now, inside)]
            return out or None
        work += [(x, inside) for x in now.children if x.tag != "#"]
    return None


def own(root: Node) -> list[Node]:
    """The runs of a page that is its own exemplar."""
    for index, (node, _) in enumerate(walk(root)):
        node.index = index
    place = region(root, masses(root, {id(x): x.index for x, _ in walk(root)}))
    work = [(root, False)]
    while work:
        now, inside = work.pop()
        inside = inside or now.tag in ("article", "main")
        if now.index == place:
            return runs_of(now, inside)
        work += [(x, inside) for x in now.children]
    return []


def without_template(found: list[tuple[Node, int]], template: dict[int, tuple[int, int]]) -> list[Node]:
    """The runs that do not have the template's constant text. ``template``: node, to its mark and how many pages have it."""
    left, doubtful = [], 0
    for x, k in found:
        if k in template and mark(x.text) == template[k][0]:
            doubtful += len(x.text) * (template[k][1] < SURE)
        else:
            left.append(x)
    if doubtful <= sum(len(x.text) for x in left):
        return left
    return [x for x, k in found if not (k in template and template[k][1] >= SURE and mark(x.text) == template[k][0])]


def mark(text: str) -> int:
    """A run's text as a signed 64-bit hash."""
    return int.from_bytes(xxhash.xxh64_digest(text), "big", signed=True)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = PAGES, constant: float = CONSTANT) -> DataFrame:
    """``<id_col>, url, text``: the main text of each page, one row for each input row."""
    name = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), text_of(html_col).alias("html"), name.alias("host"))

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            found = pa.array([layout(parse(x)) for x in part.column("html").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, "layout"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page", "url")]
    shaped = rows.mapInArrow(shape, f"page {kinds[0]}, url {kinds[1]}, html string, host string, layout long")
    order = F.struct(F.xxhash64("html"), F.col("html"))
    different = shaped.filter("html <> ''").select("host", "layout", "html", F.xxhash64("html").alias("_hash"))
    counted = different.groupBy("host", "layout").agg(F.min(order)["html"].alias("example"), F.approx_count_distinct("_hash", 0.02).alias("pages"))
    with scratch(pages.sparkSession) as keep:
        counted = materialize(counted)
        top = counted.groupBy("host").agg(F.max_by(F.struct("example", "pages"), F.struct("pages", "layout")).alias("top"))
        # layouts of few pages go with the host's most frequent one
        alone = (F.col("pages") < least) & (F.col("top.pages") >= least)
        known = counted.join(top, "host").select("host", "layout", F.when(alone, F.col("top.example")).otherwise(F.col("example")).alias("example"), F.greatest("pages", "top.pages").alias("pages"))
        known = materialize(known.filter(F.col("pages") >= least).select("host", "layout", "example", F.xxhash64("example").alias("wrapper")))
        size = known.agg(F.sum(F.octet_length("example"))).first()[0] or 0
        small = size <= BROADCAST_BYTES

        def with_wrapper(right: DataFrame, columns: list[str], more: list[str]) -> tuple[DataFrame, Callable]:
            """Pages with what their wrapper has: looked up in a broadcast table below the checked size, else joined, where a
            frequent host is spread by salt. The second value takes a batch and gives what each of its rows' wrappers has."""
            if small:
                shared = right.sparkSession.sparkContext.broadcast({(r["host"], r["layout"]): tuple(r[c] for c in columns) for r in right.collect()})
                hosts = {h for h, _ in shared.value}
                none = (None,) * len(columns)

                def look(part: pa.RecordBatch) -> Iterator[tuple[Node, tuple]]:
                    for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                        root = parse(html)
                        yield root, shared.value.get((host, layout(root)), none) if host in hosts else none

                return rows.select(*more), look
            spread = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            salt = F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")
            joined = shaped.withColumn("salt", salt).join(spread, ["host", "layout", "salt"], "left").select(*more, *columns)
            return joined, lambda part: zip(map(parse, part.column("html").to_pylist()), zip(*(part.column(c).to_pylist() for c in columns)))

        several, of_page = with_wrapper(known, ["example", "wrapper"], ["host", "html"])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """``wrapper, node, mass, mark, page``: text under each element (no mark), and the runs that match one of the
            exemplar's, page by page."""
            for part in slices(batches, "html"):
                sums: dict[tuple[int, int], float] = {}
                rows: list[tuple] = []
                for root, (example, wrapper) in of_page(part):
                    if example and root.children:
                        found = align(root, exemplar(example))
                        for node, mass in masses(root, found).items():
                            sums[wrapper, node] = sums.get((wrapper, node), 0.0) + mass
                        texts = list(leaves(root))
                        page = mark("\n".join(x.text for x in texts))
                        rows += [(wrapper, found[id(x)], 0.0, mark(x.text), page) for x in texts if id(x) in found]
                rows += [(wrapper, node, mass, None, None) for (wrapper, node), mass in sums.items()]
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["wrapper", "node", "mass", "mark", "page"])

        counted = materialize(several.mapInArrow(count, "wrapper long, node int, mass double, mark long, page long"))
        mass = counted.filter("mark is null").groupBy("wrapper", "node").agg(F.sum("mass").alias("mass"))
        mass = mass.groupBy("wrapper").agg(F.collect_list(F.struct("node", "mass")).alias("mass"))  # at most the exemplar's elements

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places, lasts = [], []
                for example, masses_ in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                    places.append(region(exemplar(example), {r["node"]: round(r["mass"]) for r in masses_}))
                    inside = next(x for x, _ in walk(exemplar(example)) if x.index == places[-1])
                    lasts.append(max(x.index for x, _ in walk(inside)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(places, pa.int32()), pa.array(lasts, pa.int32())], [*batch.schema.names[:4], "place", "last"])

        chosen = known.join(mass, "wrapper").select("host", "layout", "example", "wrapper", "mass")
        chosen = materialize(chosen.mapInArrow(choose, "host string, layout long, example string, wrapper long, place int, last int"))
        # equal contents count once
        seen = counted.filter("mark is not null").select("wrapper", "node", "mark", "page").distinct()
        counts = seen.groupBy("wrapper", "node", "mark").agg(F.count("*").alias("n"))
        nodes = counts.groupBy("wrapper", "node").agg(F.sum("n").alias("all"), F.max_by("mark", F.struct("n", "mark")).alias("mark"), F.max("n").alias("n"))
        template = nodes.filter((F.col("n") >= least) & (F.col("n") >= constant * F.col("all")))
        places = chosen.select("wrapper", "place", "last").distinct()
        template = template.join(places, "wrapper").filter((F.col("node") > F.col("place")) & (F.col("node") <= F.col("last")))
        template = template.groupBy("wrapper").agg(F.collect_list(F.struct("node", "mark", "n")).alias("template"))  # at most the exemplar's runs
        wrappers = keep(chosen.join(template, "wrapper", "left").select("host", "layout", "example", "place", "template"))

    joined, wrapper_of = with_wrapper(wrappers, ["example", "place", "template"], ["page", "url", "host", "html"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            out = []
            for root, (example, place, constants) in wrapper_of(part):
                found = placed(root, example, place) if example else None
                if found:
                    texts = without_template(found, {r["node"]: (r["mark"], r["n"]) for r in constants or ()})
                else:
                    texts = own(root)
                out.append(" ".join(x.text for x in texts))
            yield pa.RecordBatch.from_arrays([part.column("page"), part.column("url"), pa.array(out, pa.string())], ["page", "url", "text"])

    return joined.mapInArrow(run, f"page {kinds[0]}, url {kinds[1]}, text string").withColumnRenamed("page", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
