"""Main text of web pages by wrapper induction.

All pages of each host are parsed to trees of block elements, in which a run of
siblings of one kind is one node, and merged into the host's wrapper by simple tree
matching, a slice of pages at a time and then wrappers as a tree: nodes whose text is
the same on nearly all of them are template, the others are slots. Slots in menus, headers, footers, sidebars, notices,
adverts, forms and comments are noise; the rest is content. Every page is then
aligned with its host's wrapper by the same matching, and what falls on content
slots is its text. Nodes that the wrapper does not know are judged by themselves.
"""

from __future__ import annotations

import hashlib
import heapq
import html as entities
import itertools
import json
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from isobar.session import settle

#: Pages of a host that are merged at once, about, and wrappers that are joined at once.
SLICE, FAN = 64, 8
#: Pages from which equal text is template, and the lead that it must have over other texts, as a share of all pages: a text
#: on more than 9 of 10 pages always has this lead, one on 8 of 10 never.
AGREEING, LEAD = 3, 0.8
#: Elements nested deeper become siblings at this depth; pairs of children from which their table is made row by row.
DEPTH, PAIRS = 120, 4096

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul caption".split()
)
RAW = frozenset("script style noscript template title textarea iframe svg select button object head".split())
NOISE = frozenset("nav aside footer form dialog menu".split())
CLOSES_P = BLOCK - frozenset("body html li dt dd td th tr tbody thead tfoot caption legend summary".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"}),
}
#: Words in a class, id or role that tell what an element is for.
PURPOSES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe subscription signup sidebar widget widgets nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead comment comments disqus respond replies share sharing social related recommended "
    "recommendations pagination pager toolbar login search copyright contentinfo complementary dialog form paywall".split()
)

#: Words of layout that stand beside them. A name with any other word says something of its own: "related-work" is no
#: list of related pages, "ad-hoc" no advert.
LAYOUT = frozenset(
    "box block bar area container wrapper wrap inner outer content contents section panel list item items group row col column "
    "top bottom left right main site page post global primary secondary header head title link links button buttons icon icons "
    "text form the us by js unit slot zone".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Numbers of the forms of trees (labels and children), and the scores of pairs of forms. A worker forgets them when there are
#: ``_FORMS``; a number is never given again.
_FORMS = 100_000
_forms: dict[tuple, int] = {}
_scores: dict[tuple[int, int], int] = {}
_numbers = itertools.count()


class Node:
    """A block element: its label (tag and classes), what it is for, and children that are nodes or text."""

    __slots__ = ("tag", "label", "noise", "children")

    def __init__(self, tag: str, label: str, noise: bool):
        self.tag, self.label, self.noise = tag, label, noise
        self.children: list[Node | str] = []


def _words(name: str) -> set[str]:
    """The words of a name in a class, id or role, also of one like ``siteFooter``; numbers are none."""
    return set(_WORD.findall(_HUMP.sub("-", name).lower()))


def _is_purpose(name: str) -> bool:
    own = _words(name)
    return bool(own & PURPOSES) and own <= PURPOSES | LAYOUT


def _start(tag: str, attributes: str, inside: bool) -> Node:
    """inside: within an article, whose own header is content."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    named = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    noise = tag in NOISE or hidden or any(map(_is_purpose, named.split()))
    noise = noise or (not inside and (tag == "header" or any("header" in _words(n) and _words(n) <= LAYOUT for n in named.split())))
    return Node(tag, f"{tag}.{' '.join(sorted(found.get('class', '').lower().split()))}", noise)


def parse(html: str) -> Node:
    """The tree of block elements of a page. Raw elements, comments and markup are gone, inline elements are text."""
    root = Node("#", "#", False)
    stack = [root]
    at, articles = 0, 0

    def text(piece: str):
        if piece:
            children = stack[-1].children
            if children and isinstance(children[-1], str):
                children[-1] += piece
            else:
                children.append(piece)

    def close(depth: int):
        nonlocal articles
        for node in stack[depth:]:
            articles -= node.tag in ("article", "main")
        del stack[depth:]

    for token in _TOKEN.finditer(html):
        begin = token.start()
        if begin < at:
            continue
        text(entities.unescape(html[at:begin]))
        at = token.end()
        tag = (token[3] or "").lower()
        if not tag:
            text(token[1] or "")
        elif token[2]:
            if tag in BLOCK:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close(depth)
                        break
        elif tag in RAW:
            # A head has no text but in raw elements, which may hold what looks like its end.
            if tag != "head" and not token[4].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
        elif tag == "br" or tag == "hr" or tag == "wbr":
            text("" if tag == "wbr" else " ")
        elif tag in BLOCK:
            if tag in CLOSES_P:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == "p":
                        close(depth)
                        break
                    if stack[depth].tag in ("td", "th", "table", "li", "div", "section", "article", "body"):
                        break
            if tag in CLOSES:
                ends, bounds = CLOSES[tag]
                lowest = None
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in bounds:
                        break
                    if stack[depth].tag in ends:
                        lowest = depth
                if lowest:
                    close(lowest)
            close(DEPTH)
            node = _start(tag, token[4], articles > 0)
            stack[-1].children.append(node)
            stack.append(node)
            articles += tag in ("article", "main")
    if at < len(html):
        text(entities.unescape(html[at:]))
    return root


class Kind:
    """A node of a wrapper or of a page's outline: siblings of one label in a row, and all their children.

    seen: pages that have it; noisy: those on which it is noise; votes: by how many pages the text ``own`` leads.
    """

    __slots__ = ("label", "noise", "own", "children", "nodes", "seen", "noisy", "votes", "form")

    def __init__(self, label: str, noise: bool):
        self.label, self.noise = label, noise
        self.own: str | int = ""
        self.children: list[Kind] = []
        self.nodes: list[Node] = []
        self.seen, self.noisy, self.votes = 1, int(noise), 1
        self.form: int | None = None

    def dump(self, least: int = 0):
        """``least``: children that fewer pages have are left out."""
        own = mark(self.own) if isinstance(self.own, str) else self.own
        return [self.label, own, self.seen, self.noisy, self.votes, [c.dump(least) for c in self.children if c.seen >= least]]

    @staticmethod
    def load(data) -> Kind:
        kind = Kind(data[0], 2 * data[3] > data[2])
        _, kind.own, kind.seen, kind.noisy, kind.votes, children = data
        kind.children = [Kind.load(c) for c in children]
        return kind


def mark(text: str) -> int:
    """What stands for a text in a wrapper; 0 for an empty one."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=7).digest()) if text else 0


def _pack(kind: Kind, least: int = 0) -> bytes:
    return zlib.compress(json.dumps(kind.dump(least), separators=(",", ":")).encode(), 1)


def _unpack(data: bytes) -> Kind:
    return Kind.load(json.loads(zlib.decompress(data)))


def outline(nodes: list[Node]) -> Kind:
    """The outline of sibling nodes of one label."""
    kind = Kind(nodes[0].label, nodes[0].noise)
    kind.nodes = nodes
    kind.own = _SPACE.sub(" ", " ".join(c for n in nodes for c in n.children if isinstance(c, str))).strip()
    runs: list[list[Node]] = []
    for node in nodes:
        for child in node.children:
            if isinstance(child, Node):
                if runs and runs[-1][0].label == child.label and runs[-1][0].noise == child.noise:
                    runs[-1].append(child)
                else:
                    runs.append([child])
    kind.children = [outline(run) for run in runs]
    return kind


def _form(kind: Kind) -> int:
    """A number that only trees of the same labels share."""
    if kind.form is None:
        key = kind.label, *map(_form, kind.children)
        if len(_forms) >= _FORMS:
            _forms.clear()
        if key not in _forms:
            _forms[key] = next(_numbers)
        kind.form = _forms[key]
    return kind.form


def _score(a: Kind, b: Kind) -> int:
    """Nodes that can be paired, in order, remembered by form; 0 if labels differ."""
    if a.label != b.label:
        return 0
    key = _form(a), _form(b)
    score = _scores.get(key)
    if score is None:
        if key[0] == key[1]:
            score = 1 + sum(_score(c, c) for c in a.children)
        else:
            score = _paired(a, b, False)[0]
        if len(_scores) >= _FORMS:
            _scores.clear()
        _scores[key] = score
    return score


def match(a: Kind, b: Kind) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: nodes that can be paired, in order, and which children are paired; 0 if labels differ."""
    if a.label != b.label:
        return 0, []
    if _form(a) == _form(b):
        # Only as a whole do equal trees have all their nodes paired.
        return _score(a, b), [(i, i) for i in range(len(a.children))]
    return _paired(a, b)


def _paired(a: Kind, b: Kind, read: bool = True) -> tuple[int, list[tuple[int, int]]]:
    """``read``: whether the pairs are wanted too; a large table is made for the score alone in half the time."""
    n, m = len(a.children), len(b.children)
    if n * m > PAIRS:
        score, pairs = _paired_by_rows(a.children, b.children, read)
        return score + 1, pairs
    scores = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        child, row, below = a.children[i], scores[i], scores[i + 1]
        for j in range(m - 1, -1, -1):
            pair = _score(child, b.children[j])
            row[j] = max(below[j], row[j + 1], below[j + 1] + pair if pair else 0)
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if scores[i][j] == scores[i + 1][j]:
            i += 1
        elif scores[i][j] == scores[i][j + 1]:
            j += 1
        else:
            pairs.append((i, j))
            i, j = i + 1, j + 1
    return scores[0][0] + 1, pairs


def _paired_by_rows(a: list[Kind], b: list[Kind], read: bool) -> tuple[int, list[tuple[int, int]]]:
    """The score and pairs of the same table as in ``_paired``, each child with each, a row at a time along the longer side.

    Children whose label the other side has not are no one's partner, and equal ones at the end are paired there. One row in so
    many is kept, and those between are made again where pairs are read, so that memory is in proportion to the root of the
    shorter side.
    """
    def shared(left, right):
        labels = {a[i].label for i in left} & {b[j].label for j in right}
        return [i for i in left if a[i].label in labels], [j for j in right if b[j].label in labels]

    left, right = shared(range(len(a)), range(len(b)))
    score, tail = 0, []
    while left and right and _form(a[left[-1]]) == _form(b[right[-1]]):
        score += _score(a[left[-1]], b[right[-1]])
        tail.append((left.pop(), right.pop()))
    left, right = shared(left, right)
    turned = len(left) > len(right)
    short, long = ([b[j] for j in right], [a[i] for i in left]) if turned else ([a[i] for i in left], [b[j] for j in right])
    n, m = len(short), len(long)
    # Of each label: its places along the row, which form each has, and a child of each form.
    places: dict[str, list[int]] = {}
    for y, child in enumerate(long):
        places.setdefault(child.label, []).append(y)
    along: dict[str, tuple[np.ndarray, np.ndarray, list[Kind]]] = {}
    for label, own in places.items():
        forms: dict[int, int] = {}
        which = np.array([forms.setdefault(_form(long[y]), len(forms)) for y in own])
        first = np.unique(which, return_index=True)[1]
        along[label] = np.array(own), which, [long[own[k]] for k in first]
    gains: dict[int, np.ndarray] = {}
    for child in short:
        if _form(child) not in gains:
            gains[_form(child)] = np.array([_score(child, other) for other in along[child.label][2]], np.int32)

    def above(x: int, below: np.ndarray) -> np.ndarray:
        at, which, _ = along[short[x].label]
        row = below.copy()
        row[at] = np.maximum(row[at], below[at + 1] + gains[_form(short[x])][which])
        return np.maximum.accumulate(row[::-1])[::-1]

    step = math.isqrt(n) + 1
    row = np.zeros(m + 1, np.int32)
    kept = {n: row}
    for x in range(n - 1, -1, -1):
        row = above(x, row)
        if read and x % step == 0:
            kept[x] = row
    score += int(row[0])
    pairs, y = [], 0
    for start in range(0, n if read else 0, step):
        end = min(start + step, n)
        rows = [kept[end]]
        for x in range(end - 1, start - 1, -1):
            rows.append(above(x, rows[-1]))
        rows.reverse()
        x = start
        while x < end and (best := rows[x - start][y]):
            # As cell by cell: on along ``a`` as far as the score stays, then along ``b``.
            if turned:
                y = _last(rows[x - start], best)
            while x < end and rows[x + 1 - start][y] == best:
                x += 1
            if x < end:
                y = _last(rows[x - start], best)
                pairs.append((left[y], right[x]) if turned else (left[x], right[y]))
                x, y = x + 1, y + 1
    return score, pairs + tail[::-1]


def _last(row: np.ndarray, value: np.integer) -> int:
    """The last place of a value in a row that never rises."""
    return len(row) - 1 - int(np.searchsorted(row[::-1], value))


def merge(wrapper: Kind, other: Kind) -> None:
    """Align another wrapper, or a page's outline, with the wrapper: texts of paired nodes vote, new nodes are put in their place."""
    _, pairs = match(wrapper, other)
    wrapper.seen += other.seen
    wrapper.noisy += other.noisy
    if wrapper.own == other.own:
        wrapper.votes += other.votes
    elif wrapper.votes >= other.votes:
        wrapper.votes -= other.votes
    else:
        wrapper.own, wrapper.votes = other.own, other.votes - wrapper.votes
    children, i, j = [], 0, 0
    for at, to in [*pairs, (len(wrapper.children), len(other.children))]:
        # Alternatives at one place come by label, so that the same ones meet whatever order they were found in.
        children += heapq.merge(wrapper.children[i:at], other.children[j:to], key=lambda child: child.label)
        if at < len(wrapper.children):
            merge(wrapper.children[at], other.children[to])
            children.append(wrapper.children[at])
        i, j = at + 1, to + 1
    wrapper.children = children
    wrapper.form = None


def induce(pages: list[str]) -> bytes:
    """The wrapper of a host from its pages; equal pages count once."""
    return _pack(_united([outline([parse(p)]) for p in dict.fromkeys(pages)]))


def _united(parts: list[Kind]) -> Kind:
    for part in parts[1:]:
        merge(parts[0], part)
    return parts[0]


def _mains(node: Node, tags: tuple[str, ...], found: list[Node]) -> list[Node]:
    for child in node.children:
        if isinstance(child, Node) and not child.noise:
            if child.tag in tags:
                found.append(child)
            else:
                _mains(child, tags, found)
    return found


def _keep(kind: Kind, wrapper: Kind | None, plan: dict, main: set[int], inside: bool, kept: set[int]) -> None:
    """Put in ``kept`` the nodes whose own text is content.

    plan: for pairs of page and wrapper nodes, by identity, their paired children.
    """
    if kind.noise:
        return
    known = wrapper is not None
    # Inside an article text that all pages share is still part of each; elsewhere it is template. A page that has another text
    # there keeps it.
    template = known and not inside and wrapper.seen >= AGREEING and wrapper.votes > LEAD * wrapper.seen and wrapper.own == mark(kind.own)
    for node in kind.nodes:
        within = inside or id(node) in main or not main
        if within and not template:
            kept.add(id(node))
    pairs = dict((j, i) for i, j in plan.get(id(kind), ())) if known else {}
    deeper = inside or any(id(n) in main for n in kind.nodes)
    for j, child in enumerate(kind.children):
        partner = wrapper.children[pairs[j]] if j in pairs else None
        if partner is None or not partner.noise:
            _keep(child, partner, plan, main, deeper, kept)


def _align(page: Kind, wrapper: Kind, plan: dict) -> None:
    _, pairs = match(wrapper, page)
    plan[id(page)] = pairs
    for i, j in pairs:
        _align(page.children[j], wrapper.children[i], plan)


def _collect(node: Node, kept: set[int], blocks: list[str]) -> None:
    for child in node.children:
        if isinstance(child, str):
            piece = _SPACE.sub(" ", child).strip()
            if piece and id(node) in kept:
                blocks.append(piece)
        elif not child.noise:
            _collect(child, kept, blocks)


def extract(html: str | None, wrapper: Kind | None) -> str:
    """The main text of a page: its blocks with one space for white space, joined by two line feeds."""
    if not html:
        return ""
    root = parse(html)
    page = outline([root])
    main = _mains(root, ("article",), []) or _mains(root, ("main",), [])
    plan: dict = {}
    if wrapper is not None:
        _align(page, wrapper, plan)
    kept: set[int] = set()
    _keep(page, wrapper, plan, {id(n) for n in main}, False, kept)
    blocks: list[str] = []
    _collect(root, kept, blocks)
    return "\n\n".join(blocks)


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port ('' if there is none)."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _outlines(batches):
    for batch in batches:
        made = [_pack(outline([parse(t)])) for t in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(made, pa.binary())], ["host", "page", "wrapper"])


def _join(least: int):
    """Joins what a group holds to one wrapper, which leaves out nodes that fewer than ``least`` pages have."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("order")
        wrapper = _pack(_united([_unpack(w) for w in group["wrapper"]]), least)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "slice": [group["slice"].iloc[0]], "wrapper": [wrapper]})

    return run


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, wrapper) of all hosts in ``rows`` (host, html), each from all its pages that are not empty; equal pages count once.

    The pages of a host are dealt to slices by hash, each slice is merged in a task, and wrappers of slices are joined as a tree.
    Nodes that fewer than ``AGREEING`` pages have are no template and tell no more than each page does itself; at the end they go.
    """
    pages = rows.where("html <> ''").select("host", F.sha2("html", 256).alias("page"), "html")
    outlines = settle(
        pages.mapInArrow(_outlines, "host string, page string, wrapper binary").groupBy("host", "page").agg(F.first("wrapper").alias("wrapper")),
        "outlines",
    )
    sizes = settle(outlines.groupBy("host").agg(F.ceil(F.count("*") / SLICE).alias("slices")), "hosts")
    slices = sizes.agg(F.max("slices")).first()[0] or 0
    now = outlines.join(sizes, "host").select(
        "host", F.pmod(F.xxhash64("page"), F.col("slices")).alias("slice"), F.col("page").alias("order"), "wrapper"
    )
    while True:
        join = _join(AGREEING if slices <= 1 else 0)
        now = settle(now.groupBy("host", "slice").applyInPandas(join, "host string, slice long, wrapper binary"), "wrappers")
        if slices <= 1:
            return now.select("host", "wrapper")
        slices = -(-slices // FAN)
        now = now.select("host", F.floor(F.col("slice") / FAN).alias("slice"), F.col("slice").alias("order"), "wrapper")


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    A null or empty html gives an empty text. Rows without a host share one wrapper.
    Wrappers, made from all pages, are joined to pages as planned by their size, with the
    split of hot hosts left to the join. Repeated rows are extracted as often as they come;
    other columns are ignored.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))

    def run(batches):
        loaded: dict[bytes, Kind] = {}
        for batch in batches:
            texts = []
            for html, data in zip(batch.column("html"), batch.column("wrapper")):
                data = data.as_py()
                if data is not None and data not in loaded:
                    if len(loaded) > 1000:
                        loaded.clear()
                    loaded[data] = _unpack(data)
                texts.append(extract(html.as_py(), loaded.get(data)))
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
            ], ["page_id", "url", "text", "n_chars"])

    joined = rows.join(wrappers(rows).withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left")
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
