"""Main-text extraction by a tree-structured graphical model over the page's elements."""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipline.llm.common import map_batches, text_or_empty

# Element kinds of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style", "head", "title", "noscript", "template", "textarea", "select", "button", "svg", "iframe",
          "object", "canvas", "audio", "video", "datalist", "math"}
FOREIGN = {"svg", "math"}
CONTROLS = {"button", "select", "datalist"}
SECTIONS = {"article", "main", "section", "nav", "aside", "header", "footer"}
RAW = {"script", "style", "title", "textarea", "iframe", "template"}
HEAD = {"base", "basefont", "bgsound", "link", "meta"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure",
            "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre",
            "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "td", "th", "li", "nav", "aside"}

_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
LABEL = "data-label"


class Node:
    """An element that holds blocks, or (with ``parts``) a block of text."""

    __slots__ = ("tag", "parent", "tokens", "parts", "links", "label")

    def __init__(self, tag: str, parent: int, tokens: tuple[str, ...] = (), label: bool = False):
        self.tag, self.parent, self.tokens, self.label = tag, parent, tokens, label
        self.parts: list[str] | None = None
        self.links = 0


class PageParser(HTMLParser):
    """Elements and text blocks of a page in page order. Inline elements belong to the block around them.

    A hidden element ends with its end tag, with a slash if it is foreign (svg,
    math), or, if nobody closes it, with the end tag of an element around it; a
    button or list of options also where a section begins.
    Open elements are counted by name, so an end tag that closes nothing costs
    nothing, and every other one costs what it closes.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("body", -1)]
        self.stack: list[tuple[str, int]] = [("body", 0)]
        self.open: dict[str, list[int]] = {"body": [0]}
        self.block = -1
        self.hidden: list[str] = []
        self.concealed: Counter[str] = Counter()
        self.inner: Counter[str] = Counter()
        self.anchors = 0

    def _hide(self, tag: str) -> None:
        self.hidden.append(tag)
        self.concealed[tag] += 1

    def _show(self) -> None:
        self.hidden.clear()
        self.concealed.clear()
        self.inner.clear()

    def _push(self, tag: str, node: int) -> None:
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, node))

    def _close(self, names: set[str], until: set[str]) -> None:
        """Closes the innermost open element of ``names``, unless one of ``until`` is open inside it."""
        at = max((self.open[n][-1] for n in names if self.open.get(n)), default=0)
        if at < 1 or any(self.open[n][-1] > at for n in until if self.open.get(n)):
            return
        for tag, _ in self.stack[at:]:
            self.open[tag].pop()
        del self.stack[at:]
        self.block = -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden:
            if tag == self.hidden[-1] and tag not in VOID:
                self._hide(tag)
            elif self.hidden[-1] in ("head", "noscript") and tag in HIDDEN:
                self._hide(tag)
            elif self.hidden == ["head"] and tag not in HEAD:
                self._show()
            elif tag in SECTIONS and sum(self.concealed[c] for c in CONTROLS) == len(self.hidden):
                self._show()
            elif tag not in VOID:
                self.inner[tag] += 1
        if self.hidden:
            return
        if tag in ("br", "wbr") or tag in INLINE:
            if tag == "br" and self.block >= 0:
                self.nodes[self.block].parts.append(" ")
            if tag in INLINE:
                self.anchors += tag == "a"
            return
        if tag in ("html", "body"):
            return
        self.block = -1
        if tag in CLOSES_P:
            self._close({"p"}, LIMITS)
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], LIMITS - SIBLINGS[tag])
        if tag in HIDDEN:
            self._hide(tag)
            return
        if tag in VOID:
            return
        values = dict(attrs)
        names = " ".join(values.get(k) or "" for k in ("class", "id", "role", "aria-label", "itemprop"))
        tokens = set(_TOKEN.findall(_CAMEL.sub(r"\1 \2", names).lower()))
        if "hidden" in values or "none" in (values.get("style") or "") and "display" in values["style"]:
            tokens.add("!hidden")
        self.nodes.append(Node(tag, self.stack[-1][1], tuple(sorted(tokens)), values.get(LABEL) == "1"))
        self._push(tag, len(self.nodes) - 1)
        self.anchors = 0

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in FOREIGN or any(self.concealed[f] for f in FOREIGN):
            if not self.hidden:
                self.block = -1
            return
        self.handle_starttag(tag, attrs)  # a slash closes nothing else in HTML

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if self.concealed[tag]:
                while (last := self.hidden.pop()) != tag:
                    self.concealed[last] -= 1
                self.concealed[tag] -= 1
                if not self.hidden:
                    self._show()
            elif self.inner[tag]:
                self.inner[tag] -= 1
            elif self.hidden[-1] not in RAW and self.open.get(tag) and tag not in ("html", "body"):
                self._show()
                self._close({tag}, set())
            return
        if tag in INLINE:
            if tag == "a" and self.anchors:
                self.anchors -= 1
            return
        if tag not in ("html", "body", "br"):
            self._close({tag}, set())
            self.block = -1

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.block < 0:
            if not data or data.isspace():
                return
            self.nodes.append(Node("#text", self.stack[-1][1]))
            self.nodes[-1].parts = []
            self.block = len(self.nodes) - 1
        node = self.nodes[self.block]
        node.parts.append(data)
        if self.anchors:
            node.links += len(data)


def parse(html: str) -> list[Node]:
    parser = PageParser()
    parser.feed(html)
    parser.close()
    return parser.nodes


def block_text(node: Node) -> str:
    return " ".join("".join(node.parts).split())


def _scale(n: int) -> int:
    return min(n, 400).bit_length()


def features(nodes: list[Node]) -> tuple[list[list[str]], list[str]]:
    """Names of the features of each node, and the text of each block ('' for elements)."""
    texts = [block_text(n) if n.parts is not None else "" for n in nodes]
    chars, links = [len(t) for t in texts], [n.links for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        links[nodes[i].parent] += links[i]
    out = []
    for i, node in enumerate(nodes):
        linked = int(4 * min(links[i], chars[i]) / chars[i]) if chars[i] else 0
        if node.parts is None:
            own = ["tag:" + node.tag, f"element links:{linked}", *["token:" + t for t in node.tokens]]
        else:
            text, above = texts[i], nodes[node.parent]
            own = ["block", "in:" + above.tag, f"block size:{_scale(len(text.split()))}", f"block links:{linked}"]
            if "©" in text:
                own.append("copyright sign")
            if text[-1:] in ".!?…":
                own.append("ends a sentence")
        out.append(own)
    return out, texts


def _kind(node: Node) -> int:
    """The kind of edge from the parent: a block, an element with names, another element."""
    return 0 if node.parts is not None else 1 if node.tokens else 2


@dataclass
class Forest:
    """Pages laid end to end: parents, depths, edge kinds and the indexed features of every node."""

    parent: np.ndarray
    levels: list[np.ndarray]
    kind: np.ndarray
    rows: np.ndarray
    owner: np.ndarray


def plant(pages: list[tuple[list[Node], list[list[str]]]], index: dict[str, int]) -> Forest:
    parents, depths, kinds, rows, owners, base = [], [], [], [], [], 0
    for nodes, names in pages:
        depth = [0] * len(nodes)
        for i, node in enumerate(nodes):
            parents.append(base + node.parent if node.parent >= 0 else -1)
            depth[i] = depth[node.parent] + 1 if node.parent >= 0 else 0
            kinds.append(_kind(node))
            own = [index[x] for x in names[i] if x in index]
            rows += own
            owners += [base + i] * len(own)
        depths += depth
        base += len(nodes)
    depth = np.array(depths, dtype=np.int64)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
    return Forest(np.array(parents, np.int64), levels, np.array(kinds, np.int64), np.array(rows, np.int64),
                  np.array(owners, np.int64))


def _sum_log(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def propagate(forest: Forest, unary: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product messages up and down all trees: log beliefs (node, state) and (node, parent state, state).

    ``edges`` holds potentials (kind, parent state, state). Both results are
    normalised, so they are the exact marginals of each tree.
    """
    n = len(forest.parent)
    up = np.stack([np.zeros(n), unary], axis=1)
    sent, down = np.zeros((n, 2)), np.zeros((n, 2))
    for level in forest.levels[:0:-1]:
        sent[level] = _sum_log(up[level][:, None, :] + edges[forest.kind[level]], 2)
        np.add.at(up, forest.parent[level], sent[level])
    pairs = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        above = forest.parent[level]
        rest = up[above] + down[above] - sent[level]
        joint = rest[:, :, None] + edges[forest.kind[level]]
        down[level] = _sum_log(joint, 1)
        pairs[level] = joint + up[level][:, None, :]
    beliefs = up + down
    beliefs -= _sum_log(beliefs, 1)[:, None]
    flat = pairs.reshape(n, 4)
    return beliefs, (flat - _sum_log(flat, 1)[:, None]).reshape(n, 2, 2)


@dataclass
class TreeModel:
    """Weights of the features for 'holds main text' and potentials between parent and child."""

    index: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray

    def marginals(self, pages: list[tuple[list[Node], list[list[str]]]]) -> np.ndarray:
        forest = plant(pages, self.index)
        unary = np.bincount(forest.owner, self.weights[forest.rows], len(forest.parent))
        return np.exp(propagate(forest, unary, self.edges)[0][:, 1])


def truth(nodes: list[Node]) -> np.ndarray:
    """1 for the blocks below a labelled element, and for every element that holds such a block."""
    inside, out = [n.label for n in nodes], np.zeros(len(nodes), dtype=np.int64)
    for i, node in enumerate(nodes):
        if node.parent >= 0:
            inside[i] = inside[i] or inside[node.parent]
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].parts is not None and inside[i]:
            out[i] = 1
        out[nodes[i].parent] |= out[i]
    return out


def train(pages: list[str], steps: int = 400, rate: float = 0.1, decay: float = 0.02) -> TreeModel:
    """Fits weights and potentials to labelled pages by gradient steps on their conditional likelihood.

    The gradient is what the labels show less what the marginals expect, for
    every feature and every pair of parent and child states.
    """
    parsed = [(nodes, features(nodes)[0]) for nodes in map(parse, pages)]
    index = {name: i for i, name in enumerate(sorted({x for _, names in parsed for own in names for x in own}))}
    forest, labels = plant(parsed, index), np.concatenate([truth(nodes) for nodes, _ in parsed])
    weights, edges = np.zeros(len(index)), np.zeros((3, 2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    shown_w = np.bincount(forest.rows, labels[forest.owner], len(index))
    shown_e = np.zeros((3, 2, 2))
    np.add.at(shown_e, (forest.kind[child], labels[forest.parent[child]], labels[child]), 1)
    moments = [[np.zeros_like(weights), np.zeros_like(weights)], [np.zeros_like(edges), np.zeros_like(edges)]]
    for step in range(1, steps + 1):
        unary = np.bincount(forest.owner, weights[forest.rows], len(labels))
        beliefs, pairs = propagate(forest, unary, edges)
        want_w = np.bincount(forest.rows, np.exp(beliefs[forest.owner, 1]), len(index))
        want_e = np.zeros((3, 2, 2))
        np.add.at(want_e, forest.kind[child], np.exp(pairs[child]))
        for value, slope, (first, second) in ((weights, shown_w - want_w, moments[0]), (edges, shown_e - want_e, moments[1])):
            slope = slope / len(pages) - decay * value / len(pages)
            first += 0.1 * (slope - first)
            second += 0.01 * (slope ** 2 - second)
            value += rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return TreeModel(index, weights, edges)


# How page parts are commonly marked, the labels of the training pages.
CONTENT = ["<article>", "<main>", '<div class="content">', '<div id="content">', '<div class="post">',
           '<div class="entry-content">', '<div class="article-body">', '<section class="story">', '<div role="main">',
           '<div id="main">', '<div class="post-content">', '<article class="post">', '<section class="article">',
           '<div class="main-content">', '<article id="story">', '<div itemprop="articleBody">', '<div class="text">']
MENUS = ["<nav>", '<div class="nav">', '<ul id="navigation">', '<div class="menu">', '<div class="navbar">',
         '<ul class="menu">', '<div class="breadcrumb">', '<div id="nav">', '<nav class="main-nav">',
         '<div role="navigation">', '<div class="toc">', '<ul class="pagination">']
HEADERS = ["<header>", '<div id="header">', '<div class="site-header">', '<div class="masthead">', '<div class="header">',
           '<div class="topbar">', '<div role="banner">', '<div class="logo">']
FOOTERS = ["<footer>", '<div id="footer">', '<div class="site-footer">', '<div class="footer">', '<div class="copyright">',
           '<div role="contentinfo">', '<div class="legal">', '<footer class="footer">']
SIDES = ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<div class="related">',
         '<section class="related-posts">', '<aside class="sidebar">', '<div role="complementary">',
         '<div class="recommended">', '<div class="trending">', '<div class="author-bio">', '<div class="tags">']
ADVERTS = ['<div class="ad">', '<div class="ads">', '<aside class="advert">', '<div class="sponsored">',
           '<div class="promo">', '<div class="advertisement">', '<div id="ad-top">', '<p class="ad">',
           '<section class="ad">', '<div class="banner">', '<div class="adsbygoogle">', '<div class="ad-slot">']
NOTICES = ['<div class="cookie">', '<div class="notice">', '<div id="cookie-banner">', '<div class="gdpr">',
           '<div class="alert">', '<p class="notice">', '<div class="cookie-notice">', '<div class="consent">',
           '<div class="newsletter">', '<div class="subscribe">', '<div class="popup">', '<div role="alert">',
           '<div class="modal">', '<section class="notice">', '<aside class="notice">', '<div class="disclaimer">']
FORMS = ["<form>", '<form class="search">', '<div class="login">', '<form id="signup">', '<div class="search-box">',
         '<fieldset>', '<div class="form">', '<div role="search">']
COMMENTS = ['<div class="comments">', '<section id="comments">', '<ol class="commentlist">', '<div class="comment">',
            '<section class="comments">', '<div id="disqus">', '<ul class="comments">', '<div class="replies">',
            '<div class="reader-comments">', '<aside class="comments">', '<div id="comments">', '<div class="discussion">']
SHARES = ['<div class="share">', '<ul class="social">', '<div class="social-links">', '<div class="share-buttons">']


def _words(rng: random.Random, least: int, most: int) -> str:
    """Invented words, some with a full stop."""
    said = " ".join("".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 8)))
                    for _ in range(rng.randint(least, most)))
    return said.capitalize() + rng.choice(["", ".", ".", "."])


def _closing(opening: str) -> str:
    return f"</{opening[1:].split(' ')[0].rstrip('>')}>"


def _inner(rng: random.Random, opening: str) -> str:
    """Text of a page part: plain, linked, listed or in paragraphs, of any length."""
    kind = rng.random()
    if opening.startswith(("<ul", "<ol")):
        return "".join(f"<li>{_words(rng, 1, 12)}</li>" for _ in range(rng.randint(1, 5)))
    if kind < 0.3 or opening.startswith("<p"):
        return _words(rng, 1, 30)
    if kind < 0.5:
        return "<ul>" + "".join(f'<li><a href="#">{_words(rng, 1, 3)}</a></li>' for _ in range(rng.randint(1, 7))) + "</ul>"
    if kind < 0.6:
        return f"<h3>{_words(rng, 1, 5)}</h3>" + f"<p>{_words(rng, 1, 40)}</p>" * rng.randint(1, 2)
    if kind < 0.7:
        return f'<div><a href="#">{_words(rng, 1, 5)}</a></div>'
    return "".join(f"<p>{_words(rng, 1, 60)}</p>" for _ in range(rng.randint(1, 4)))


def _part(rng: random.Random, kinds: list[str]) -> str:
    opening = rng.choice(kinds)
    return opening + _inner(rng, opening) + _closing(opening)


def _content(rng: random.Random) -> str:
    """Headings, paragraphs and now and then a list, quotation, table, listing or figure."""
    out = [f"<h1>{_words(rng, 1, 9)}</h1>"] * (rng.random() < 0.7)
    for _ in range(rng.randint(1, 7)):
        kind, said = rng.random(), _words(rng, 1, rng.choice([5, 30, 60, 120, 350]))
        if kind < 0.7:
            out.append(f"<p>{said}</p>")
        elif kind < 0.78:
            out.append(f"<h2>{_words(rng, 1, 6)}</h2>")
        elif kind < 0.86:
            out.append("<ul>" + "".join(f"<li>{_words(rng, 1, 15)}</li>" for _ in range(3)) + "</ul>")
        elif kind < 0.9:
            out.append(f"<blockquote><p>{said}</p></blockquote>")
        elif kind < 0.93:
            out.append(f"<table><tr><td>{_words(rng, 1, 4)}</td><td>{_words(rng, 1, 4)}</td></tr></table>")
        elif kind < 0.96:
            out.append(f"<div>{said}</div>")
        elif kind < 0.98:
            out.append(f'<p>{said} <a href="#">{_words(rng, 1, 4)}</a></p>')
        else:
            out.append(f"<figure><figcaption>{said}</figcaption></figure><pre>{escape(said)}</pre>")
    return "".join(out)


def labelled_page(rng: random.Random) -> str:
    """A page of commonly marked parts around, and at times within, a labelled main part."""
    opening = rng.choice(CONTENT)
    main = opening[:-1] + f' {LABEL}="1">' + _content(rng) + _closing(opening)
    outer = rng.random()
    if outer < 0.1:  # paragraphs straight in the body
        main = "".join(f'<p {LABEL}="1">{_words(rng, 3, 80)}</p>' for _ in range(rng.randint(1, 5)))
    elif outer < 0.3:  # parts inside the article
        opening = rng.choice(["<article>", "<main>", '<div class="post">'])
        inside = "".join(_part(rng, rng.choice([SIDES, ADVERTS, NOTICES, SHARES, COMMENTS, FORMS])) for _ in range(2))
        main = opening + f'<div {LABEL}="1">{_content(rng)}</div>' + inside + _closing(opening)
    elif outer < 0.45:
        main = rng.choice(["<div>", '<div class="container">', '<div id="page">', '<div class="wrapper">']) + main + "</div>"
    elif outer < 0.48:  # a page without main text
        main = ""
    before = [_part(rng, k) for k in (MENUS, HEADERS, ADVERTS, NOTICES, FORMS) if rng.random() < 0.5]
    after = [_part(rng, k) for k in (SIDES, ADVERTS, NOTICES, COMMENTS, SHARES, FORMS) if rng.random() < 0.35]
    if rng.random() < 0.8:
        foot = rng.choice(FOOTERS)
        after.append(foot + rng.choice(["© ", ""]) + _inner(rng, foot) + _closing(foot))
    rng.shuffle(before)
    return "<html><body>" + "".join([*before, main, *after]) + "</body></html>"


def default_model(pages: int = 300, seed: int = 11) -> TreeModel:
    """Trained on ``pages`` labelled pages."""
    rng = random.Random(seed)
    return train([labelled_page(rng) for _ in range(pages)])


def main_text(model: TreeModel, pages: list[str], threshold: float = 0.5) -> list[str]:
    """The main text of each page: the blocks whose marginal reaches the threshold, in page order."""
    parsed, texts = [], []
    for html in pages:
        nodes = parse(html)
        names, own = features(nodes)
        parsed.append((nodes, names))
        texts.append(own)
    if not parsed:
        return []
    marginals, at, out = model.marginals(parsed), 0, []
    for own in texts:
        kept = marginals[at:at + len(own)] >= threshold
        out.append("\n".join(t for t, k in zip(own, kept) if t and k))
        at += len(own)
    return out


def extract_pages(pages: DataFrame, model: TreeModel | None = None, page_id: str = "page_id", url: str = "url",
                  html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Elements and text blocks are the nodes of a tree; each has a state (holds
    main text or not), features weigh its states, parent-child potentials
    couple them, and messages up and down the tree give the marginal of every
    block. Null and empty pages, and those without main text, give an empty
    text. Repeated rows are extracted each for itself; extra columns are
    ignored; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # as large as the training labels make it

    def make():
        own = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = []
            for low in range(0, batch.num_rows, 64):
                texts += main_text(own, batch.column(2).slice(low, 64).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                              ["page_id", "url", "text"])
        return work

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        text_or_empty(html).alias("html"))
    return map_batches(rows, make, "page_id long, url string, text string").withColumn(
        "n_chars", F.length("text").cast("long"))
