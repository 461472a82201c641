"""Main text of web pages by a tree-structured graphical model (operator 10).

Every element and every run of text of a page is a node that is content or not. A node's own potential comes from its features
(tag, names in class, id and role, length and links of its text, place in a marked article); a potential on each edge says how
child and parent go together, for each kind of child. The tree has no loops, so one pass of sum-product messages upwards and one
downwards give exact marginals. Text whose marginal is over one half is the result.

All potentials are counts from labelled pages: pages that mark their article (article, main), of which a bounded sample is taken,
the SAMPLE_PAGES with the smallest hash. Labels come from the marks and from sectioning elements in them, not from names; what a
marked article holds below a name such as comments is not labelled. Names count by what they were seen on: single names, and
the families HINTS_AGAINST and HINTS_FOR, which start with PRIOR counts for names that the sample may not hold.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import smallest

SAMPLE_PAGES = 2_000
SLOTS = 1 << 16
#: How many labelled nodes the starting counts are worth.
PRIOR = 200.0

# Element names of HTML, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("head script style title template noscript iframe svg math object select button textarea option label input datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MARKED = frozenset("article main".split())
APART = frozenset("nav header footer aside form menu dialog".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDS = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd"}
NOT_P = BLOCK - {"p"}
LISTS = frozenset("ul ol dl table tbody thead tfoot select".split())
HINTS_AGAINST = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|nav\w*|menu|breadcrumbs?|foot\w*|head(?:er)?|masthead|cookies?|consent|notice|popup|modal|overlay|alert|comment\w*|repl(?:y|ies)|disqus|respond|share|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|search|widget|pagination|pager|tags|toolbar|skip\w*)(?:$|[-_ \d])"
)
HINTS_FOR = re.compile(r"(?:^|[-_ ])(?:article\w*|content|post|entry|story|main|body|text|hentry)(?:$|[-_ \d])")
#: Elements that hold a part of a page; names of other elements (a paragraph, a heading) say less.
PARTS = frozenset("div section article aside header footer nav form ul ol dl table details dialog figure fieldset menu span".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)", re.S)
_TAG_SIGN = re.compile("[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: A name that says how a page is laid out, not what the element is.
_LAYOUT = re.compile(r"^(?:no|not|has|have|with|without|is|js)[-_]")

TEXT = "#text"


class Page:
    """Nodes in page order: parent (-1: none), tag, attributes' names, text; parents come before their children."""

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.text = [-1], ["#page"], [""], [""]
        self._stack, self._opened = [0], Counter()
        at, end = 0, len(source)
        self._dead: set[int] = set()  # quotes that open an attribute from which no tag's end is reached
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                self._say(source[at:])
                break
            if m.start() > at:
                self._say(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            stop = self._tag_end(source, at)
            rest = source[at:stop]
            at = min(stop + 1, end)
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, rest)
            if tag in RAW and not rest.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                if tag == "textarea":
                    self._say(source[at : stop.start() if stop else end])
                self._close(tag)
                at = stop.end() if stop else end

    def _tag_end(self, source: str, at: int) -> int:
        """Where the > is that ends a tag: the first one outside quotes, or, if the quotes do not come out even, the first one at all. A quote
        is gone over once by the tags that fail, so odd quotes cost no more than one pass over the page."""
        opened, place = [], at
        while (m := _TAG_SIGN.search(source, place)) is not None:
            if m[0] == ">":
                return m.start()
            close = -1 if m.start() in self._dead else source.find(m[0], m.end())
            opened.append(m.start())
            if close < 0:
                break
            place = close + 1
        self._dead.update(opened)
        first = source.find(">", at)
        return len(source) if first < 0 else first

    def _node(self, tag: str, names: str, text: str) -> int:
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        return len(self.tag) - 1

    def _say(self, raw: str) -> None:
        self._node(TEXT, "", html.unescape(raw))

    def _open(self, tag: str, rest: str) -> None:
        if tag in P_ENDS:
            self._close("p", NOT_P)
        if tag in CLOSED_BY:
            for other in CLOSED_BY[tag]:
                self._close(other, LISTS)
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)).lower() if "=" in rest else ""
        node = self._node(tag, names, "")
        if tag not in VOID and not rest.endswith("/"):
            self._stack.append(node)
            self._opened[tag] += 1

    def _close(self, tag: str, fence: frozenset | set = frozenset()) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            if not self._opened[tag]:
                return
            name = self.tag[self._stack[i]]
            if name == tag:
                self._opened.subtract(self.tag[n] for n in self._stack[i:])
                del self._stack[i:]
                return
            if name in fence:
                return


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SLOTS


def _roles(names: str) -> list[str]:
    return [x for x in names.split() if not _LAYOUT.match(x)]


def _places(page: Page) -> list[str]:
    """Where each node is: 'in' a marked article, in one but 'apart', 'out' of it, or on a page that marks 'none'. Articles below
    a part that is named as something else count as apart if another is not."""
    n = len(page.tag)
    if MARKED.isdisjoint(page.tag):
        return ["none"] * n
    own = [page.tag[i] in APART or (page.tag[i] in PARTS and any(HINTS_AGAINST.search(x) for x in _roles(page.names[i]))) for i in range(n)]
    below = own[:]
    for i in range(1, n):
        below[i] = own[i] or below[page.parent[i]]
    free = any(page.tag[i] in MARKED and not below[i] for i in range(n))
    out = ["out"] * n
    for i in range(1, n):
        around = out[page.parent[i]]
        if around == "in":
            out[i] = "apart" if own[i] else "in"
        elif around == "out" and page.tag[i] in MARKED:
            out[i] = "apart" if own[i] or (free and below[i]) else "in"
        else:
            out[i] = around
    return out


def describe(page: Page) -> tuple[list[list[int]], list[int]]:
    """Each node's feature slots, and the kind of the edge to its parent, by the child: 0 text or inline, 1 block, 2 set apart by
    its tag or names, 3 marked as article, 4 a block below a part set apart. Text and inline elements have no features of length
    and links of their own: they go with their block."""
    n = len(page.tag)
    words, linked, in_link = [0] * n, [0] * n, [False] * n
    for i in range(n):
        p = page.parent[i]
        in_link[i] = p >= 0 and (in_link[p] or page.tag[p] == "a")
    for i in range(n - 1, 0, -1):
        if page.tag[i] == TEXT:
            words[i] = page.text[i].count(" ") + bool(page.text[i].strip())
            linked[i] = words[i] if in_link[i] else 0
        words[page.parent[i]] += words[i]
        linked[page.parent[i]] += linked[i]
    features, kinds, below = [], [], [False] * n
    for i, place in enumerate(_places(page)):
        tag, roles, p = page.tag[i], _roles(page.names[i]), page.parent[i]
        against, own = any(HINTS_AGAINST.search(x) for x in roles), [f"name {x}" for x in sorted(set(roles))]
        if tag in BLOCK or i == 0:
            own += [f"tag {tag} {(4 * linked[i] + 1) // max(words[i], 1)}", f"words {min(words[i].bit_length(), 6)}"]
        if place != "none":
            own.append(f"place {place}")
        if against:
            own.append(f"names against {tag in PARTS}")
        elif any(HINTS_FOR.search(x) for x in roles):
            own.append("names for")
        features.append([_slot(x) for x in own])
        apart, inside = tag in APART or (against and tag in PARTS), p >= 0 and below[p]
        below[i] = tag not in MARKED and (apart or inside)
        kinds.append(2 if apart else 3 if tag in MARKED else 0 if tag not in BLOCK else 4 if inside else 1)
    return features, kinds


def marked_labels(page: Page) -> list[int] | None:
    """1 for the nodes of the marked article, but for sectioning elements set apart in it, -1 for what is not labelled: parts that
    are apart by name. None if the page marks none."""
    if MARKED.isdisjoint(page.tag):
        return None
    out, apart = [0] * len(page.tag), [False] * len(page.tag)
    for i, place in enumerate(_places(page)):
        p = page.parent[i]
        apart[i] = page.tag[i] in APART or page.tag[i] in HIDDEN or (p >= 0 and apart[p])
        out[i] = 0 if place == "out" or apart[i] else 1 if place == "in" else -1
    return out


#: Starting counts of features and edges ([parent][child] of each kind), as parts of PRIOR.
_FEATURES = {
    "names against True": (1, 0), "names against False": (0.5, 0.3), "names for": (0, 1), "tag p 0": (0.1, 1), "tag article 0": (0, 1), "tag main 0": (0, 1),
    "place in": (0, 1), "place apart": (1, 0), "place out": (1, 0), **{f"tag {t} {k}": (1, 0) for t in sorted(APART) for k in range(5)},
}
_EDGES = np.array([[[1, 0.02], [0.02, 1]], [[0.6, 0.2], [0.05, 1]], [[1, 0.02], [1, 0.05]], [[0.05, 1], [0.05, 1]], [[1, 0.002], [0.02, 1]]])
KINDS = len(_EDGES)


class Model:
    """Log-ratios of features (slot), and edge potentials [kind][parent][child], from counts of labelled nodes."""

    def __init__(self, features: np.ndarray | None = None, edges: np.ndarray | None = None):
        features = np.zeros((SLOTS, 2)) if features is None else features.copy()
        edges = np.zeros((KINDS, 2, 2)) if edges is None else edges
        total = features[[_slot(f"words {k}") for k in range(7)]].sum(axis=0) + PRIOR
        seen = features.sum(axis=1)
        for name, start in _FEATURES.items():
            features[_slot(name)] += PRIOR * np.array(start)
            seen[_slot(name)] += PRIOR
        share = (features + 0.5) / (total + 1)
        most = np.full(SLOTS, 5.0)  # features of one block depend on each other: length says least, then the tag
        most[[_slot(f"words {k}") for k in range(7)]] = 1.0
        most[[_slot(f"tag {t} {k}") for t in sorted(BLOCK - APART - MARKED) for k in range(5)]] = 3.0
        self.ratio = np.where(seen >= 3, np.clip(np.log(share[:, 1]) - np.log(share[:, 0]), -most, most), 0.0).tolist()
        p = edges + PRIOR * _EDGES
        self.edge = (p / p.sum(axis=2, keepdims=True)).tolist()

    def marginals(self, page: Page) -> list[float]:
        """Log-odds that each node is content, by sum-product over the tree."""
        features, kinds = describe(page)
        n = len(features)
        up = [sum(self.ratio[s] for s in own) for own in features]
        message = [0.0] * n
        for i in range(n - 1, 0, -1):
            (s00, s01), (s10, s11) = self.edge[kinds[i]]
            e = math.exp(min(max(up[i], -30.0), 30.0))
            message[i] = math.log((s11 * e + s10) / (s01 * e + s00))
            up[page.parent[i]] += message[i]
        odds = up[:]
        for i in range(1, n):
            (s00, s01), (s10, s11) = self.edge[kinds[i]]
            e = math.exp(min(max(odds[page.parent[i]] - message[i], -30.0), 30.0))
            odds[i] = up[i] + math.log((s11 * e + s01) / (s10 * e + s00))
        return odds


def main_text(source: str | None, model: Model) -> str:
    """The content's text: white space in a block is one space, blocks are joined by one space."""
    if not source:
        return ""
    page = Page(source)
    odds = model.marginals(page)
    hidden = [False] * len(odds)
    block = [0] * len(odds)
    blocks: list[list] = [[]]
    last = 0
    for i, tag in enumerate(page.tag):
        p = page.parent[i]
        hidden[i] = tag in HIDDEN or (p >= 0 and hidden[p])
        block[i] = i if tag in BLOCK or p < 0 else block[p]
        if block[i] != last:
            blocks.append([])
            last = block[i]
        if tag == TEXT and not hidden[i] and odds[i] > 0:
            blocks[-1].append(page.text[i])
    return " ".join(" ".join("".join(b).split()) for b in blocks if any(x.strip() for x in b))


def _counts(batches):
    features, edges = np.zeros((SLOTS, 2)), np.zeros((KINDS, 2, 2))
    for batch in batches:
        for source in batch.column(0).to_pylist():
            page = Page(source or "")
            labels = marked_labels(page)
            if labels is None:
                continue
            own, kinds = describe(page)
            for i, y in enumerate(labels):
                if y < 0:
                    continue
                if i and labels[page.parent[i]] >= 0:
                    edges[kinds[i], labels[page.parent[i]], y] += 1
                for s in own[i]:
                    features[s, y] += 1
    yield pa.RecordBatch.from_arrays([pa.array([features.tobytes()], pa.binary()), pa.array([edges.tobytes()], pa.binary())], ["features", "edges"])


def fit(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> Model:
    """Potentials from at most sample_pages pages that mark their article. No such page: the starting counts alone."""
    marked = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)[\s>]")).select(F.col(html_col).alias("html"))
    sample = smallest(marked, sample_pages, "html")
    features, edges = np.zeros((SLOTS, 2)), np.zeros((KINDS, 2, 2))
    for r in sample.repartition(8).mapInArrow(_counts, "features binary, edges binary").collect():
        features += np.frombuffer(r["features"]).reshape(SLOTS, 2)
        edges += np.frombuffer(r["edges"]).reshape(KINDS, 2, 2)
    return Model(features, edges)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """pages with text_col, the main text, in place of html_col: empty if there is none; null html counts as empty. All rows and
    other columns stay, a column named text_col is replaced; repeated rows get the same text; no rows give no rows."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages, html_col))
    rest = [c for c in pages.columns if c not in (text_col, html_col)]
    keyed = pages.select(F.struct(F.lit(0).alias("c"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(rest))).alias("page"), F.col(html_col).alias("html"))

    def make(batches):
        for batch in batches:
            out = [main_text(x, shared.value) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["page", "text"])

    done = keyed.mapInArrow(make, f"page {keyed.schema['page'].dataType.simpleString()}, text string")
    return done.select(*(F.col("page")[f"c{i}"].alias(c) for i, c in enumerate(rest)), F.col("text").alias(text_col))
