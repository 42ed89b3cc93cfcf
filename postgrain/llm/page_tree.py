"""Main text of web pages by a tree-structured graphical model over the DOM.

Nodes are the elements of a page's body and, below them, its blocks of text. A node's label says whether it holds main
text. A log-linear potential rates each node by tag, class and id words, length, links and punctuation; a potential on each
parent-child edge rates the pair of labels. Sum-product messages, upward and then downward, give every node's marginal;
blocks with a marginal of at least one half are the main text.

Weights start from priors and are fitted by the gradient of the conditional likelihood (observed less expected counts, from
the same messages) to labelled pages. Where no labels are given, ``markup_labels`` makes them from semantic markup; pages without such
markup say nothing of their text and are left out of the fit. Where no page has any, one page written here is fitted.

White space in a block becomes one space, character references are decoded, blocks are joined by a line feed. A null or
empty page, and one without main text, has the empty text. Pages are never cut. Repeated rows get equal answers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 400  # labelled pages that a fit reads at most
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg canvas iframe object select datalist textarea".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())  # any other tag ends a head
# Tags that end a silent element which the page never closes.
FLOW = frozenset(
    "body address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table caption tbody thead tfoot tr td th ul".split()
)
INLINE = frozenset("a abbr b bdi bdo br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ONE_OF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words in class or id: first those of page furniture, then those of articles.
FURNITURE = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs byline comment comments cookie cookies consent disqus footer form gdpr "
    "header login menu modal nav navbar navigation newsletter notice overlay pager pagination popup privacy promo promoted "
    "promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription tags toolbar tracking trending warning widget".split()
)
ARTICLE = frozenset("article body content entry main post story text".split())
TAGS = "address article aside blockquote body button div dl fieldset figcaption figure footer form h1 h2 h3 h4 header li main menu nav ol p pre section table td ul dialog details".split()
BARRED = frozenset("nav footer aside header form button menu dialog".split())
PRIOR = {
    "tag:article": 2.0, "tag:main": 2.0, "tag:p": 1.0, "tag:body": 4.0, "tag:nav": -5.0, "tag:footer": -5.0, "tag:aside": -5.0, "tag:header": -5.0,
    "tag:form": -5.0, "tag:button": -5.0, "tag:menu": -5.0, "tag:dialog": -5.0, "tag:fieldset": -4.0, "role:furniture": -5.0, "class:furniture": -5.0, "class:article": 1.0,
    "links:most": -2.0, "leaf:long": 1.0, "leaf:under p": 1.0, "leaf:under h": 0.5, "bias": 0.5, "outside": -4.0, "within:furniture": -6.0,
}
EDGE_PRIOR = {"00": 2.0, "01": -6.0, "10": 0.0, "11": 0.5}
STEPS, RATE, SHRINK = 30, 0.5, 0.05
# What the fit learns from where no page of the table is labelled.
SEED = """<body><header><p>Site</p></header><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><div><article><div><h1>A title</h1>
<p>A paragraph of the text, long enough to be told from a short line of furniture by its length alone.</p><p>A short one.</p>
<ul><li>An item.<li>Another item.</ul><blockquote>A quotation.</blockquote></div></article></div><aside><p>More.</p></aside><footer>(c)</footer></body>"""


class Tree(HTMLParser):
    """Parents, tags, feature names and block texts of a page, in page order.

    A head ends at its end tag or where a body begins: at a tag or text that no head holds. A silent element that is never
    closed ends at the next flow element; which are never closed is known after a first reading, and then the page is read again.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.unclosed: set[tuple[int, int]] = set()  # where silent elements begin that are never closed
        self._read(html)
        self.unclosed = {at for tag, at in self.silent if tag != "head"}
        if self.unclosed:
            self.reset()
            self._read(html)

    def _read(self, html: str) -> None:
        self.parent, self.tag, self.words, self.role, self.text, self.linked = [], [], [], [], [], []
        self.open: list[int] = []  # block elements that are open
        self.inline: list[str] = []  # inline elements that are open in the innermost block
        self.silent: list[tuple[str, tuple[int, int]]] = []  # silent elements that are open, and where they begin
        self.piece: list[str] = []
        self.in_link = 0
        self._node("body", set(), "")
        self.open.append(0)
        self.feed(html)
        self.close()
        self._flush()

    def _node(self, tag: str, words: set[str], role: str, text: str | None = None, linked: float = 0.0) -> int:
        self.parent.append(self.open[-1] if self.open else -1)
        for column, value in ((self.tag, tag), (self.words, words), (self.role, role), (self.text, text), (self.linked, linked)):
            column.append(value)
        return len(self.tag) - 1

    def _flush(self) -> None:
        text = " ".join("".join(p for p, _ in self.piece).split())
        if text:
            links = sum(len(p) for p, link in self.piece if link)
            self._node("#text", set(), "", text, links / max(1, sum(len(p) for p, _ in self.piece)))
        self.piece = []

    def _close(self, depth: int) -> None:
        self._flush()
        del self.open[depth:]
        self.inline, self.in_link = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._end_silence(tag)
        if tag in SILENT:
            self.silent.append((tag, self.getpos()))
            return
        if self.silent:
            return
        if tag in ("html", "body", "!doctype"):
            return
        if tag in INLINE:
            if tag == "br":
                self.piece.append((" ", False))
            elif tag not in VOID:
                self.inline.append(tag)
                self.in_link += tag == "a"
            return
        self._flush()
        if tag in VOID:
            return
        limit = ONE_OF.get(tag, set())
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[depth]]
            if name == "p" or tag in ONE_OF and name in ONE_OF and (name == tag or {name, tag} <= {"dt", "dd"} or {name, tag} <= {"td", "th"} or tag == "tr" and name in ("td", "th")):
                self._close(depth)
                if name != "p" and tag != "tr":
                    break
            elif name in limit or name not in ("p", "td", "th"):
                break
        given = {k: v or "" for k, v in attrs}
        words = set(re.findall(r"[a-z]+", f"{given.get('class', '')} {given.get('id', '')}".lower()))
        self.open.append(self._node(tag, words, given.get("role", "").lower()))
        self.inline, self.in_link = [], 0

    def _end_silence(self, tag: str) -> None:
        """End the silent elements that cannot hold ``tag``."""
        while self.silent and tag in FLOW and self.silent[-1][1] in self.unclosed:
            self.silent.pop()
        if len(self.silent) == 1 and self.silent[0][0] == "head" and tag not in IN_HEAD:
            self.silent.pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            for depth in range(len(self.silent) - 1, -1, -1):
                if self.silent[depth][0] == tag:
                    del self.silent[depth:]
                    return
            if tag in FLOW and self.silent[-1][1] in self.unclosed:
                self._end_silence(tag)
        if self.silent:
            return
        if tag in INLINE:
            if tag in self.inline:
                self.inline.remove(tag)
                self.in_link -= tag == "a"
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[depth]] == tag:
                self._close(depth)
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_silence("#text")
        if not self.silent:
            self.piece.append((data, self.in_link > 0))

    def furniture(self) -> list[bool]:
        """Whether each element itself is furniture by tag or class. What wraps an article is none, whatever its class."""
        wraps = [t in ("article", "main") for t in self.tag]
        for k in range(len(self.tag) - 1, 0, -1):
            wraps[self.parent[k]] |= wraps[k]
        named = [bool(w & FURNITURE) and not w & ARTICLE for w in self.words]
        return [not w and (t in BARRED or n) for w, t, n in zip(wraps, self.tag, named)]

    def features(self) -> list[list[str]]:
        """Names of the features that each node has."""
        n = len(self.tag)
        size, links, inside, within = [0] * n, [0.0] * n, [False] * n, self.furniture()
        has_article = any(t in ("article", "main") for t in self.tag)
        for k in range(n):
            p = self.parent[k]
            inside[k] = self.tag[k] in ("article", "main") or p >= 0 and inside[p]
            within[k] = within[k] or p >= 0 and within[p]
        for k in range(n - 1, -1, -1):
            if self.text[k] is not None:
                size[k], links[k] = len(self.text[k]), self.linked[k] * len(self.text[k])
            if self.parent[k] >= 0:
                size[self.parent[k]] += size[k]
                links[self.parent[k]] += links[k]
        out = []
        for k in range(n):
            found = ["bias"]
            if k and size[k] and links[k] > 0.5 * size[k]:
                found.append("links:most")
            if within[k]:
                found.append("within:furniture")
            if self.text[k] is None:
                if self.tag[k] in _KNOWN:
                    found.append(f"tag:{self.tag[k]}")
                if self.words[k] & ARTICLE:
                    found.append("class:article")
                elif self.words[k] & FURNITURE:
                    found.append("class:furniture")
                if self.role[k] in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"):
                    found.append("role:furniture")
            else:
                found.append("leaf")
                under = self.tag[self.parent[k]]
                found.append("leaf:under p" if under == "p" else "leaf:under h" if re.fullmatch("h[1-6]", under) else "leaf:under other")
                if size[k] >= 80:
                    found.append("leaf:long")
                if self.text[k][-1] in ".!?…\"'»”":
                    found.append("leaf:ends")
                if has_article and not inside[k]:
                    found.append("outside")
            out.append(found)
        return out


_KNOWN = frozenset(TAGS)


def markup_labels(tree: Tree) -> list[int] | None:
    """Labels from semantic markup: blocks in an article or main element and in no furniture, and the elements around them.

    None where the markup does not say: such a page may have its text anywhere.
    """
    n = len(tree.tag)
    if not any(t in ("article", "main") for t in tree.tag):
        return None
    inside, barred, label = [False] * n, tree.furniture(), [0] * n
    for k in range(n):
        p = tree.parent[k]
        inside[k] = tree.tag[k] in ("article", "main") or p >= 0 and inside[p]
        barred[k] = barred[k] or p >= 0 and barred[p]
    for k in range(n - 1, -1, -1):
        if tree.text[k] is not None:
            label[k] = int(inside[k] and not barred[k])
        if label[k] and tree.parent[k] >= 0:
            label[tree.parent[k]] = 1
    return label


def marginals(parent: list[int], unary: list[float], edge: dict[str, float]) -> tuple[list[float], list[tuple[float, ...]]]:
    """P(label 1) of each node, and of each node the four probabilities of (parent's label, own label)."""
    n = len(parent)
    e00, e01, e10, e11 = edge["00"], edge["01"], edge["10"], edge["11"]
    up0, up1 = [0.0] * n, list(unary)  # what a node's subtree says of its labels
    to0, to1 = [0.0] * n, [0.0] * n  # the message to its parent
    for k in range(n - 1, 0, -1):
        a, b = up0[k], up1[k]
        to0[k], to1[k] = _sum(a + e00, b + e01), _sum(a + e10, b + e11)
        p = parent[k]
        up0[p] += to0[k]
        up1[p] += to1[k]
    down0, down1 = [0.0] * n, [0.0] * n
    one, pairs = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
    one[0] = _share(up1[0] - up0[0])
    for k in range(1, n):
        p = parent[k]
        a, b = up0[p] + down0[p] - to0[k], up1[p] + down1[p] - to1[k]  # the parent without this child
        down0[k], down1[k] = _sum(a + e00, b + e10), _sum(a + e01, b + e11)
        one[k] = _share(up1[k] + down1[k] - up0[k] - down0[k])
        four = (a + e00 + up0[k], a + e01 + up1[k], b + e10 + up0[k], b + e11 + up1[k])
        top = max(four)
        four = [exp(x - top) for x in four]
        total = sum(four)
        pairs[k] = tuple(x / total for x in four)
    return one, pairs


def _sum(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


def _share(odds: float) -> float:
    return 1 / (1 + exp(-odds)) if odds > -700 else 0.0


def fit(pages: list[dict]) -> dict[str, dict[str, float]]:
    """Weights from labelled trees: dictionaries of parent, features and labels."""
    weight, edge = dict(PRIOR), dict(EDGE_PRIOR)
    for page in pages:
        for found in page["features"]:
            for f in found:
                weight.setdefault(f, 0.0)
    prior, edge_prior = dict(weight), dict(edge)
    nodes = max(1, sum(len(p["parent"]) for p in pages))
    names = ("00", "01", "10", "11")
    for _ in range(STEPS if pages else 0):
        slope, edge_slope = dict.fromkeys(weight, 0.0), dict.fromkeys(names, 0.0)
        for page in pages:
            unary = [sum(map(weight.__getitem__, found)) for found in page["features"]]
            one, pairs = marginals(page["parent"], unary, edge)
            for k, (found, label) in enumerate(zip(page["features"], page["labels"])):
                for f in found:
                    slope[f] += label - one[k]
                if k:
                    edge_slope[f"{page['labels'][page['parent'][k]]}{label}"] += 1
                    for name, p in zip(names, pairs[k]):
                        edge_slope[name] -= p
        for values, slopes, start in ((weight, slope, prior), (edge, edge_slope, edge_prior)):
            for f in values:
                values[f] += RATE * (len(values) * slopes[f] / nodes - SHRINK * (values[f] - start[f]))
    return {"weight": weight, "edge": edge}


def main_text(html: str | None, model: dict[str, dict[str, float]]) -> str:
    if not html:
        return ""
    tree, weight = Tree(html), model["weight"]
    unary = [sum(weight.get(f, 0.0) for f in found) for found in tree.features()]
    one, _ = marginals(tree.parent, unary, model["edge"])
    return "\n".join(text for text, p in zip(tree.text, one) if text is not None and p >= 0.5)


def train(pages: DataFrame, labels: Callable[[Tree], list[int] | None] = markup_labels, sample: int = SAMPLE_PAGES) -> dict:
    """Fit on at most ``sample`` pages, the first by a hash of url and page_id; their trees are made in tasks.

    Pages that ``labels`` gives None are left out; those without article or main are not sampled for ``markup_labels`` at all.
    """
    order = F.xxhash64("url", "page_id")
    pages = pages.filter(F.col("html").rlike(r"(?i)<(article|main)[\s/>]") if labels is markup_labels else F.col("html").isNotNull())
    chosen = pages.select("page_id", order.alias("place")).orderBy("place", "page_id").limit(sample)
    chosen = F.broadcast(chosen.select("page_id").distinct())  # at most ``sample`` rows

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for html in batch.column("html").to_pylist():
                tree = Tree(html)
                label = labels(tree)
                if label is not None:
                    out.append(json.dumps({"parent": tree.parent, "features": tree.features(), "labels": label}))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["tree"])

    trees = pages.join(chosen, "page_id", "left_semi").select("html").mapInArrow(parse, "tree string")
    found = [json.loads(r.tree) for r in trees.sort("tree").limit(sample).toLocalIterator()]
    if not found:
        seed = Tree(SEED)
        found = [{"parent": seed.parent, "features": seed.features(), "labels": markup_labels(seed)}]
    return fit(found)


def extract(pages: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with text and n_chars."""
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column("__html")]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, schema.names)

    return pages.select(*keep, F.col("html").alias("__html")).mapInArrow(run, schema)
