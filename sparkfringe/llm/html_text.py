"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded along the tree.

Block elements, inline ones with a class, id or role, and lines of text that stand in a container beside blocks or
double line breaks, are the nodes of a page. Features of a node are its kind, the words
in its attributes and in those of its ancestors, depth, text, link and punctuation density of its subtree,
its place in the page and figures of its siblings. The trees give the probability that a node holds
main text; decoding picks the most probable set of kept nodes in which no dropped node has a kept
descendant. Where that set holds no text, the least bias towards keeping that gives any decides, up to ``LENIENT``. The trees are
trained on generated pages (:func:`training_pages`), whose right answer is known: named and nameless elements, columns of tables,
bare bodies, text parted by line breaks, and elements left open. Neither the pages that are extracted nor others are learnt from.

The text of a page: kept text runs, references decoded, white space within a block turned into one blank,
blocks trimmed, empty ones left out, joined in page order by line feeds. Scripts, styles, comments and other
things that aren't shown are no nodes. A line break element counts as white space. Null, empty and
tagless html give the text that there is, maybe none. Each row is a page of its own, also where page_id or url repeat.
"""

from __future__ import annotations

import hashlib
import html as entities
import inspect
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style noscript template head title svg math canvas object iframe textarea xmp noembed noframes datalist audio video map".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp small span strike
    strong sub sup time tt u var wbr img br""".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}),
}
P_STAYS = INLINE | {"button", "label", "select", "input", "option", "body", "html"}
SCOPE = frozenset("article section aside main div td th table body html form blockquote li nav header footer".split())

KINDS = {k: n for n, kinds in enumerate(("article main", "section div span", "h1 h2 h3 h4 h5 h6 hgroup", "p blockquote pre", "ul ol dl menu", "li dt dd", "table tr td th tbody thead", "nav", "header", "footer", "aside dialog", "form fieldset button select option label input legend", "figure figcaption picture details summary", "address", "html body")) for k in kinds.split()}
#: One more kind: lines of text in a container, and the containers that have them.
LINE, HOLDERS = 16, frozenset((0, 1, 5, 6, 14, 15))
N_KINDS = 17
#: The most that logits are raised by where a page would have no text.
LENIENT = 1.0
CUES = (
    "article content post entry main story articlebody body text prose",
    "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toc skip",
    "header masthead topbar logo branding head hero",
    "footer copyright legal bottom colophon foot imprint",
    "sidebar side aside rail widget widgets related recommended popular trending more latest complementary",
    "cookie cookies consent notice gdpr alert popup modal newsletter subscribe subscription paywall warning toast message disclaimer overlay",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner affiliate dfp adslot",
    "form search login signin signup register contact input",
    "comment comments reply replies respond disqus discussion thread commentlist feedback",
    "share social sharing follow twitter facebook buttons toolbar tools tags",
    "hidden none invisible sr screenreader",
)
CUE_OF = {w: 1 << k for k, words in enumerate(CUES) for w in words.split()}
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label|style|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_RIGHTS = re.compile(r"(?i)©|&copy;|&#169;|\(c\)|\bcopyright\b")
_TOKEN = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_TAG = re.compile(r"""<!--.*?-->|<!--.*\Z|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)


def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I)


_RAW_END = {name: _raw_end(name) for name in RAW}


@cache
def _cues(attributes: str) -> int:
    """Which cues attributes hold; 0 also for none."""
    out = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden":
            out |= CUE_OF["hidden"]
        elif name.lower() == "style":
            out |= CUE_OF["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else 0
        else:
            for t in _TOKEN.findall(value):
                out |= CUE_OF.get(t.lower(), 0)
    return out


class Page:
    """Nodes in page order (lists) and text runs (node, block, text)."""

    def __init__(self, html: str):
        self.kind, self.cues, self.parent, self.depth = [14], [0], [-1], [0]
        self.end, self.above, self.place, self.children, self.marked = [0], [0], [0], [0], [0]
        self.runs: list[tuple[int, int, str, bool]] = []
        self._read(html)

    def _node(self, name: str, attributes: str, parent: int) -> int:
        cues = _cues(attributes) if len(attributes) < 500 else _cues.__wrapped__(attributes)
        self.kind.append(KINDS.get(name, 15))
        self.cues.append(cues)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        kind = self.kind[parent]
        self.above.append(self.above[parent] | self.cues[parent] | (1 << (16 + kind)))
        self.place.append(self.children[parent])
        self.children[parent] += 1
        self.children.append(0)
        self.end.append(0)
        self.marked.append(int(bool(attributes.strip())))
        return len(self.kind) - 1

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # names and nodes; inline elements keep their parent's node
        node = at = block = links = unseen = 0
        opened: dict[str, int] = {}
        last = html.rfind(">")
        line, of, broken = 0, (-1, -1), False  # the node of the present line, its container and block, and whether it has just been broken

        def text(upto: int) -> None:
            nonlocal line, of, broken
            if upto > at and not unseen:
                own, run = node, html[at:upto]
                if self.kind[node] in HOLDERS and not run.isspace():
                    if of != (node, block):
                        line, of = self._node("", "", node), (node, block)
                        self.kind[line], self.end[line] = LINE, len(self.kind)
                    own, broken = line, False
                self.runs.append((own, block, run, links > 0))

        def pop() -> None:
            nonlocal node, links, unseen, block
            name, own = stack.pop()
            opened[name] -= 1
            links -= name == "a"
            unseen -= name in UNSEEN
            if own != stack[-1][1]:
                self.end[own] = len(self.kind)
            if name not in INLINE:
                block += 1
            node = stack[-1][1]

        while at <= last:
            m = _TAG.search(html, at)
            if not m:
                break
            text(m.start())
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if opened.get(name):
                    while stack[-1][0] != name:
                        pop()
                    pop()
                elif name not in INLINE:
                    block += 1
                continue
            attributes = m[3] or m[6] or ""
            if name not in P_STAYS and opened.get("p"):
                k = len(stack) - 1
                while stack[k][0] not in SCOPE and stack[k][0] != "p" and k:
                    k -= 1
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
            if name in CLOSES:
                closed, scope = CLOSES[name]
                k = len(stack) - 1
                while k and stack[k][0] not in scope:
                    if stack[k][0] in closed:
                        while len(stack) > k:
                            pop()
                    k -= 1
            if name in VOID:
                if name not in INLINE:
                    block += 1
                elif name == "br" and not unseen:
                    self.runs.append((node, block, " ", links > 0))
                    of, broken = ((-1, -1), False) if broken else (of, True)
                continue
            if name not in INLINE:
                block += 1
            if name in RAW:
                end = _RAW_END[name].search(html, at)
                at = end.end() if end else len(html)
                continue
            if attributes.rstrip().endswith("/") and name in UNSEEN:
                continue
            own = node
            if not unseen and name not in UNSEEN and (name not in INLINE or (name != "a" and _ATTRIBUTE.search(attributes) and _cues(attributes))):
                own = self._node(name, attributes, node)
            stack.append((name, own))
            opened[name] = opened.get(name, 0) + 1
            links += name == "a"
            unseen += name in UNSEEN
            node = own
        text(len(html))
        while len(stack) > 1:
            pop()
        self.end[0] = len(self.kind)


def features(pages: list[Page]) -> np.ndarray:
    """One row per node of all pages."""
    starts = np.cumsum([0] + [len(p.kind) for p in pages])
    n = int(starts[-1])
    own = np.zeros((n, 6))  # characters, in links, words, marks, runs, capitals
    rows, figures = [], []
    for p, start in zip(pages, starts, strict=False):
        for node, _, text, linked in p.runs:
            if not text.isspace():
                size = len(text)
                rows.append(start + node)
                figures.append((size, size * linked, text.count(" ") + 1, text.count(".") + text.count(",") + text.count("?") + text.count("!"), 1, len(_RIGHTS.findall(text))))
    if rows:
        np.add.at(own, np.array(rows), np.array(figures, float))
    joined = lambda name: np.concatenate([np.array(getattr(p, name)) for p in pages])
    page = np.repeat(np.arange(len(pages)), np.diff(starts))
    base = starts[:-1][page]
    kind, cues, above, depth, place, children, marked = (joined(x) for x in ("kind", "cues", "above", "depth", "place", "children", "marked"))
    parent = np.maximum(joined("parent"), 0) + base
    end = joined("end") + base
    sums = np.concatenate([np.zeros((1, 6)), np.cumsum(own, 0)])
    at = np.arange(n)
    sub = sums[end] - sums[at]
    total = sub[base]
    p_nodes = np.concatenate([[0], np.cumsum(kind == 3)])
    heads = np.concatenate([[0], np.cumsum(kind == 2)])
    inside = end - at
    by_parent = np.bincount(parent, sub[:, 0], n)[parent] - sub[:, 0]
    links_by_parent = np.bincount(parent, sub[:, 1], n)[parent] - sub[:, 1]
    same = np.unique(parent * 32 + kind, return_inverse=True, return_counts=True)
    alike = same[2][same[1]]
    siblings = children[parent]
    bits = lambda x, k: (x[:, None] >> np.arange(k)) & 1
    columns = [
        bits(1 << kind, N_KINDS), bits(cues, len(CUES)), bits(above, len(CUES)), bits(above >> 16, N_KINDS),
        np.log1p(sub[:, 0]), sub[:, 1] / (sub[:, 0] + 1), sub[:, 0] / (sub[:, 4] + 1), sub[:, 3] / (sub[:, 2] + 1), sub[:, 0] / inside,
        np.log1p(own[:, 0]), own[:, 1] / (own[:, 0] + 1), sub[:, 0] / (total[:, 0] + 1), (sums[at, 0] - sums[base, 0]) / (total[:, 0] + 1),
        depth, children, siblings, place / (siblings + 1e-9), alike, np.log1p(by_parent), links_by_parent / (by_parent + 1),
        np.log1p(sub[parent, 0]), sub[:, 0] / (sub[parent, 0] + 1), p_nodes[end] - p_nodes[at], heads[end] - heads[at], inside, np.minimum(sub[:, 5], 2), marked,
    ]
    return np.column_stack(columns).astype(np.float32)


@dataclass
class Trees:
    """Boosted regression trees of equal depth: feature and limit per inner node, value per leaf."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value)))):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += value[at - len(feature)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 120, depth: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, rows: float = 0.6, features: float = 0.5, seed: int = 1) -> Trees:
    """Newton boosting of the logistic loss over binned features; every tree sees a seeded part of rows and features."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]).astype(np.int32)
    n, width = x.shape
    share = float((weight * y).sum() / weight.sum())
    base = np.log(share / (1 - share))
    z = np.full(n, base)
    trees: list[tuple] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        seen = rng.random(n) < rows
        slope, curve = np.where(seen, weight * (y - p), 0), np.where(seen, weight * p * (1 - p), 0)
        own = np.flatnonzero(seen)
        some = np.sort(rng.choice(width, max(1, int(features * width)), replace=False))
        at = np.zeros(n, np.int64)
        feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            nodes = 2**level
            first = ((at[own] - (nodes - 1)) * bins).astype(np.int32)
            g, h = (np.stack([np.bincount(first + binned[f, own], v[own], nodes * bins) for f in some], 1) for v in (slope, curve))
            g, h = (v.reshape(nodes, bins, len(some)).transpose(0, 2, 1).cumsum(2) for v in (g, h))
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[some[j]]):
                    feature[nodes - 1 + k], limit[nodes - 1 + k] = some[j], edges[some[j]][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > limit[at])
        leaf = at - len(feature)
        value = rate * np.bincount(leaf, slope, 2**depth) / (np.bincount(leaf, curve, 2**depth) + ridge)
        z += value[leaf]
        trees.append((feature, limit, value))
    return Trees(float(base), *(np.array(c) for c in zip(*trees, strict=True)))


def decode(page: Page, logit: np.ndarray) -> list[bool]:
    """The most probable kept nodes such that whatever is kept has kept ancestors; the root stays. Of pages without any text
    kept so, the set that the least bias gives."""
    said = {node for node, _, text, _ in page.runs if not text.isspace()}
    kept = _decoded(page, logit)
    for bias in np.arange(0.5, LENIENT + 0.1, 0.5) if said else ():
        if any(kept[node] for node in said):
            break
        kept = _decoded(page, logit + bias)
    return kept


def _decoded(page: Page, logit: np.ndarray) -> list[bool]:
    keep = np.minimum(logit, 0) - np.log1p(np.exp(-np.abs(logit)))
    drop = (keep - logit).tolist()
    keep = keep.tolist()
    for k in range(len(keep) - 1, 0, -1):
        up = page.parent[k]
        keep[up] += max(keep[k], drop[k])
        drop[up] += drop[k]
    kept = [True] * len(keep)
    for k in range(1, len(keep)):
        kept[k] = kept[page.parent[k]] and keep[k] >= drop[k]
    return kept


def text_of(page: Page, kept: list[bool]) -> str:
    out: list[str] = []
    last, parts = -1, []
    for node, block, text, _ in page.runs:
        if kept[node]:
            if block != last and parts:
                out.append("".join(parts))
                parts = []
            last = block
            parts.append(entities.unescape(text) if "&" in text else text)
    out.append("".join(parts))
    return "\n".join(x for x in (" ".join(t.split()) for t in out) if x)


def extract(htmls: list[str | None], trees: Trees) -> list[str]:
    out = []
    for at in range(0, len(htmls), 100):
        pages = [Page(h or "") for h in htmls[at : at + 100]]
        logit = trees.logit(features(pages))
        first = 0
        for p in pages:
            out.append(text_of(p, decode(p, logit[first : first + len(p.kind)])))
            first += len(p.kind)
    return out


class _Writer:
    """Generated pages: layouts, wording and markup vary; main text is told apart by a private mark."""

    MARK = "\ue000"

    def __init__(self, rng: random.Random):
        self.rng = rng
        letters = rng.choice(["abcdefghilmnoprstu", "aeiourstlnmdé", "aeionrtkzßüä", "aeiosrnñclmt"])
        self.vocabulary = ["".join(rng.choices(letters, k=rng.randint(1, 10))) for _ in range(150)]
        self.signs = rng.choice([[""], [""], [""], list("!#$%*+-/=?@^_|~"), ["&amp;", "&quot;", "&mdash;", "&#39;", "&eacute;", "&hellip;"]])
        self.nameless = rng.random() < 0.3

    def words(self, n: int) -> str:
        sign = lambda: self.rng.choice(self.signs) * self.rng.randint(1, 4) if n > 3 and self.rng.random() < 0.4 else ""
        out = [self.rng.choice(self.vocabulary) + sign() + (self.rng.choice([",", ".", ".", ""]) if self.rng.random() < 0.12 else "") for _ in range(n)]
        return " ".join(out).capitalize() + self.rng.choice([".", ".", "", "?"])

    def maybe(self, chance: float, *made) -> str:
        return self.rng.choice(made)() if self.rng.random() < chance else ""

    def named(self, tag: str, *names: str) -> str:
        if self.nameless or not names or self.rng.random() < 0.2 and tag not in ("div", "section", "span"):
            return tag
        prefix = self.rng.choice(["", "", "", "site-", "page-", "js-", "block-", "c-", "main_"])
        suffix = self.rng.choice(["", "", "", "-1", "-box", "-wrap", "__inner", "-container"])
        return f'{tag} {self.rng.choice(["class", "class", "id"])}="{prefix}{self.rng.choice(names)}{suffix}"'

    def element(self, head: str, body: str) -> str:
        return f"<{head}>{body}</{head.split()[0]}>"

    def links(self, low: int = 2, high: int = 9) -> str:
        many = [f'<a href="/{self.rng.choice(self.vocabulary)}">{self.words(self.rng.randint(1, 3)).rstrip(".?")}</a>' for _ in range(self.rng.randint(low, high))]
        form = self.rng.randrange(3)
        if form == 0:
            return self.element(self.rng.choice(["ul", "ol", "ul"]), "".join(f"<li>{x}</li>" for x in many))
        return self.rng.choice([" | ", " ", "", " &middot; "]).join(many) if form == 1 else "".join(f"<div>{x}</div>" for x in many)

    def nav(self) -> str:
        label = self.maybe(0.4, lambda: self.rng.choice(["{} ", "{}: ", "<b>{}</b>", "<h3>{}</h3>", "<p>{}</p>"]).format(self.words(self.rng.randint(1, 2))))
        head = self.rng.choice(["nav", self.named("div", "nav", "menu", "navigation", "breadcrumb", "navbar", "pagination"), self.named("nav", "menu", "main"), "p" if self.nameless else "nav"])
        return self.element(head, label + (self.links() if head != "p" else " | ".join(f'<a href="#{k}">{self.words(1)}</a>' for k in range(self.rng.randint(1, 6)))))

    def header(self) -> str:
        inner = self.rng.choice([self.element("h1", self.words(2)), self.element("a", self.words(1)), self.element(self.named("div", "logo", "branding"), self.words(2)), ""])
        return self.element(self.rng.choice(["header", self.named("div", "header", "masthead", "topbar"), self.named("header", "header", "top")]), inner + self.maybe(0.6, self.nav, self.form) + self.maybe(0.3, lambda: self.element("p", self.words(self.rng.randint(2, 8)))))

    def footer(self) -> str:
        mark, year = self.rng.choice(["&copy;", "©", "Copyright", "(c)", "&#169;"]), self.rng.choice(["", "1999 ", "2020 ", "2011-2024 "])
        line = f"{mark} {year}{self.words(self.rng.randint(1, 14))}"
        body = self.rng.choice([line, f"<p>{line}</p>", f"<small>{line}</small>", self.links() + f"<p>{line}</p>", f"{self.links(1, 4)} {line}", line if self.nameless else self.words(self.rng.randint(4, 30))])
        return self.maybe(0.2, lambda: "<hr>") + self.element(self.rng.choice(["footer", "footer", self.named("div", "footer", "copyright", "legal", "bottom"), self.named("footer", "footer"), "address"]), body)

    def aside(self) -> str:
        body = "".join(self.rng.choice([self.links, lambda: self.element("p", self.words(self.rng.randint(4, 40))), lambda: self.element("h3", self.words(2))])() for _ in range(self.rng.randint(1, 4)))
        return self.element(self.rng.choice(["aside", self.named("div", "sidebar", "related", "widget", "recommended", "popular"), self.named("aside", "sidebar", "related"), self.named("section", "related", "more", "sidebar")]), body)

    def advert(self) -> str:
        return self.element(self.named("div", "ad", "ad", "ads", "advert", "sponsored", "promo", "banner", "advertisement") if self.rng.random() < 0.9 else self.named("aside", "ad", "sponsor"), self.rng.choice([lambda: self.words(self.rng.randint(2, 40)), lambda: self.element("p", self.words(self.rng.randint(3, 25))), lambda: self.element("a", self.words(self.rng.randint(2, 8)))])())

    def notice(self) -> str:
        return self.element(self.rng.choice([self.named("div", "cookie", "consent", "notice", "alert", "newsletter", "gdpr", "popup", "modal", "paywall", "subscribe"), self.named("section", "notice", "newsletter", "cookie"), 'div role="alert" class="notice"', self.named("p", "notice", "cookie", "disclaimer")]), self.rng.choice([lambda: self.words(self.rng.randint(5, 40)), lambda: self.words(9) + self.element("button", self.words(1))])())

    def form(self) -> str:
        field = f"<label>{self.words(2)}</label><input type=text><select><option>{self.words(1)}<option>{self.words(1)}</select>"
        return self.element(self.rng.choice(["form", self.named("form", "search", "login", "contact", "newsletter")]), field * self.rng.randint(1, 2) + self.maybe(0.4, lambda: self.element("p", self.words(self.rng.randint(3, 15)))) + f"<button>{self.words(1)}</button>")

    def comments(self) -> str:
        one = lambda: self.element(self.named(self.rng.choice(["div", "li", "article", "div"]), "comment", "comment", "reply", "comment-body"), self.maybe(0.5, lambda: self.element("b", self.words(1))) + self.rng.choice(["<p>{}</p>", "{}", "<div>{}</div>"]).format(self.words(self.rng.randint(3, 50))))
        head = self.rng.choice([self.named("div", "comments", "replies", "respond", "discussion"), self.named("section", "comments", "comment"), 'div id="disqus_thread"', self.named("ol", "commentlist", "comments")])
        return self.element(head, self.maybe(0.6, lambda: self.element(self.rng.choice(["h2", "h3"]), self.words(1))) + "".join(one() for _ in range(self.rng.randint(1, 6))) + self.maybe(0.3, self.form))

    def share(self) -> str:
        return self.element(self.named("div", "share", "social", "tools", "tags"), self.links(2, 5))

    def boilerplate(self) -> str:
        return self.rng.choice([self.nav, self.aside, self.advert, self.advert, self.notice, self.form, self.comments, self.share])()

    def said(self, n: int) -> str:
        return self.MARK + self.words(n)

    def inline(self, body: str) -> str:
        """Emphasis around or in text, now and then left open; line breaks."""
        tag = self.rng.choice(["b", "i", "em", "strong", "span", "u", "font", "small"])
        form = self.rng.randrange(5)
        if form == 0:
            return f"<{tag}>{body}</{tag}>"
        if form == 1:
            return f"<{tag}>{body}"
        if form == 2:
            return f"{body} <{tag}>{self.said(3)}</{tag}> {self.said(2)}"
        return body + self.rng.choice(["<br>", "<br/>", f"<br>{self.said(4)}"]) if form == 3 else f"<{tag}>{body}<br>"

    def paragraph(self) -> str:
        body = self.said(self.rng.choice([1, 1, 2, 4, 8, 15, 40, 90, 160, 300]))
        if self.rng.random() < 0.2:
            body += f' <a href="/x">{self.MARK}{self.words(2)}</a> <em>{self.said(3)}</em>'
        if self.rng.random() < 0.3:
            body = self.inline(body)
        form = self.rng.random()
        if form < 0.68:
            return f"<p>{body}</p>"
        if form < 0.83:
            return f"<p>{body}"
        if form < 0.88:
            return self.element("blockquote", f"<p>{body}</p>")
        if form < 0.92:
            return self.element(self.rng.choice(["ul", "ol"]), "".join(f"<li>{self.said(self.rng.randint(2, 25))}" for _ in range(self.rng.randint(1, 6))))
        if form < 0.95:
            return self.element("table", "".join(f"<tr><td>{self.said(3)}</td><td>{self.said(2)}</td></tr>" for _ in range(self.rng.randint(1, 4))))
        return self.element("pre", body) if form < 0.965 else self.element("div", body)

    def broken_text(self) -> str:
        """Text that only line breaks part."""
        parts = [self.said(self.rng.choice([3, 8, 20, 60, 120])) for _ in range(self.rng.randint(1, 6))]
        return self.maybe(0.5, lambda: self.element(self.rng.choice(["h1", "h2", "b", "font size=5"]), self.said(3)) + self.rng.choice(["", "<br><br>"])) + self.rng.choice(["<br><br>", "<br><br>\n", "<br>\n<br>"]).join(parts)

    def plain_page(self) -> str:
        """Pages without names: text in the body, in a table's cell or in plain elements."""
        rng = self.rng
        text = self.broken_text() if rng.random() < 0.45 else self.maybe(0.7, lambda: self.element(rng.choice(["h1", "h2"]), self.said(rng.choice([1, 1, 2, 3, 5, 8])))) + "".join(self.paragraph() for _ in range(rng.choice([1, 1, 2, 3, 6, 12])))
        links = lambda: self.nav() if rng.random() < 0.6 else " ".join(f'<a href="{k}.html">{self.words(rng.randint(1, 3))}</a>' for k in range(rng.randint(1, 4)))
        form = rng.randrange(5)
        if form == 0:
            cells = [f"<td{rng.choice(['', ' valign=top', ' width=150'])}>{links()}</td>", f"<td>{text}</td>"]
            body = self.element(rng.choice(["table", "table border=0"]), "<tr>" + "".join(cells if rng.random() < 0.8 else cells[::-1]) + "</tr>")
        elif form == 1:
            body = self.element("div", links()) + self.element("div", text)
        elif form == 2:
            body = self.maybe(0.5, links) + rng.choice(["<hr>", "<br><br>", ""]) + text + rng.choice(["<hr>", "<br><br>", "<p>"]) + self.maybe(0.7, links)
        elif form == 3:
            body = self.element(rng.choice(["center", "div", "font", "main", "section"]), self.maybe(0.3, links) + text)
        else:
            body = self.maybe(0.5, lambda: self.element("div", links())) + text
        return body + self.maybe(0.5, self.footer) + self.maybe(0.2, self.form)

    def article(self) -> str:
        rng = self.rng
        title = self.maybe(0.8, lambda: self.element(rng.choice(["h1", "h1", "h2", self.named("h1", "title", "headline", "entry-title")]), self.said(rng.choice([1, 1, 2, 3, 5, 8, 12]))))
        parts = [self.element("header", title) if title and rng.random() < 0.08 else title]
        for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 9, 20])):
            parts.append(self.paragraph())
            if rng.random() < 0.1:
                parts.append(self.element(rng.choice(["h2", "h3"]), self.said(rng.randint(1, 6))))
            if rng.random() < 0.1:
                parts.append(rng.choice([self.advert, self.aside, self.share, self.notice, self.form, self.nav])())
        if rng.random() < 0.15:
            parts.append(rng.choice([self.comments, self.comments, self.footer])())
        body = "".join(parts)
        if rng.random() < 0.2:
            body = self.element(self.named("div", "text", "body", "entry", "prose", "inner"), body)
        if rng.random() < 0.12:
            return body
        head = rng.choice(["article", "article", "article", "main", self.named("article", "post", "entry"), self.named("div", "content", "article", "post", "entry", "story"), 'div role="main"', self.named("main", "content", "main")])
        return self.element(head, body)

    def page(self) -> str:
        rng = self.rng
        before = [f() for f in (self.header, self.nav, self.advert, self.notice, self.aside, self.form) if rng.random() < 0.4]
        after = [f() for f in (self.aside, self.comments, self.share, self.advert, self.notice, self.form, self.nav) if rng.random() < 0.25]
        after += [self.footer()] if rng.random() < 0.85 else []
        if rng.random() < 0.3:
            rng.shuffle(before)
        if self.nameless:
            middle = self.plain_page()
        else:
            middle = "".join(before) + rng.choice(["", "<!-- x -->"]) + (self.article() if rng.random() < 0.95 else "") + "".join(after)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            middle = self.element(rng.choice(["div", self.named("div", "wrapper", "page", "container", "outer", "layout"), "section"]), middle)
        head = f"<title>{self.words(5)}</title>" + self.maybe(0.4, lambda: "<style>body { color: #333 } p > b { margin: 1em }</style>") + self.maybe(0.4, lambda: "<script>if (a < b) { load('<div>') }</script>")
        return rng.choice(["<!DOCTYPE html>", "", "<!-- page -->"]) + f"<html><head>{head}</head><body>{middle}" + rng.choice(["</body></html>", ""])


def training_pages(n: int, seed: int = 7) -> list[tuple[Page, np.ndarray]]:
    """Pages and, for each node, whether it holds main text."""
    out = []
    for k in range(n):
        page = Page(_Writer(random.Random(seed * 100_003 + k)).page())
        good = np.zeros(len(page.kind), bool)
        for node, _, text, _ in page.runs:
            if _Writer.MARK in text:
                while node >= 0 and not good[node]:
                    good[node] = True
                    node = page.parent[node]
        page.runs = [(a, b, t.replace(_Writer.MARK, ""), link) for a, b, t, link in page.runs]
        out.append((page, good))
    return out


def _learnt(n: int, seed: int) -> Trees:
    made = training_pages(n, seed)
    x, y = features([p for p, _ in made]), np.concatenate([g for _, g in made]).astype(float)
    some = np.log1p(np.expm1(x[:, N_KINDS * 2 + 2 * len(CUES)]))  # by the text that a node decides over
    return boosted(x, y, 0.6 + some / some.max())


@cache
def trained(n: int = 2000, seed: int = 7, folder: str | None = None) -> Trees:
    """Trees learnt from ``n`` generated pages, taken from ``folder`` where a run before has left them."""
    if folder is None:
        return _learnt(n, seed)
    at = f"{folder}/page-trees-{hashlib.md5(inspect.getsource(inspect.getmodule(_learnt)).encode()).hexdigest()}-{n}-{seed}"
    spark = SparkSession.getActiveSession()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        rows = spark.read.schema("tree int, base double, feature array<long>, cut array<double>, value array<double>").parquet(at).orderBy("tree").collect()
        return Trees(rows[0].base, *(np.array([r[name] for r in rows]) for name in ("feature", "cut", "value")))
    found = _learnt(n, seed)
    rows = [(k, found.base, f.tolist(), c.tolist(), v.tolist()) for k, (f, c, v) in enumerate(zip(found.feature, found.limit, found.value, strict=True))]
    spark.createDataFrame(rows, "tree int, base double, feature array<long>, cut array<double>, value array<double>").coalesce(1).write.mode("overwrite").parquet(at)
    return found


def main_text(pages: DataFrame, trees: Trees) -> DataFrame:
    """Rows (page_id, url, text, n_chars)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract(batch.column(2).to_pylist(), trees)
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(lean(look), "page_id long, url string, text string, n_chars long")
