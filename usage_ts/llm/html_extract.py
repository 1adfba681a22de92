"""Main text of web pages by boosted trees over DOM nodes and a decoding over the whole tree.

Every element and every run of text is a node with measures of its place, its tag and attribute words,
its subtree and its siblings. Boosted trees give each node the log-odds that its subtree holds article
text. Decoding takes the best set of nodes in which no kept node has a dropped ancestor, so what lies in a
dropped menu cannot return, and a kept paragraph keeps its containers.

The trees are trained at the start of a run on pages from a seeded generator, which knows the article text
of its pages: layouts with and without semantic tags, with menus, headers, footers, sidebars, notices,
adverts, forms and comments in varied places and under varied names.

Defined cases: null, empty and tag-free html give empty text or the text itself as one block; broken and
unclosed tags close where the next block begins; a tag cut off at the end is dropped; repeated rows and
null ids keep one row each.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usage_ts.llm.common import columns

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[a-z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: A control or a drawing up to its end, if that comes before the next block or the next of these.
_SMALL = {
    tag: re.compile(
        rf"[^<]*(?:<(?!/{tag}\b|/?(?:svg|button|select|p|div|section|article|main|aside|nav|header|footer|form|h[1-6]|ul|ol|dl|li|"
        rf"table|blockquote|pre|figure|body)\b)[^<]*)*</{tag}\b[^>]*>",
        re.I,
    )
    for tag in ("svg", "button", "select")
}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
#: Elements of html by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark noscript object q s samp small span "
    "strike strong sub sup template time tt u var".split()
)
#: Tags in order from furniture to article; the place is a measure.
TAGS = (
    "nav footer header aside form menu ul ol li dl dt dd a label table tr td th span b div center section body html "
    "#text blockquote pre figure figcaption p h6 h5 h4 h3 h2 h1 main article"
).split()
_PLACE = {t: i for i, t in enumerate(TAGS)}
_SECTIONS = frozenset("nav footer header aside form main article body section".split())
BAD = frozenset(
    "nav navigation navbar menu header masthead footer sidebar aside ad ads advert advertisement adverts sponsor "
    "sponsored promo banner cookie cookies consent notice alert comment comments reply replies disqus form login "
    "search share sharing social related recommended subscribe newsletter breadcrumb breadcrumbs pager pagination "
    "widget popup modal copyright toolbar contentinfo complementary tags meta".split()
)
GOOD = frozenset("article content main post entry story body text page prose".split())
MEASURES = (
    "tag parent section bad good bad_above good_above depth size links density page_share at siblings share leaf_words ended paragraphs"
).split()
_MARK = "\ue000"


def parse(html: str) -> tuple[list[str], list[int], list[list[str]], list[tuple[int, list[str]]]]:
    """Tags, parents and attribute words of nodes in page order, and each block's text node and pieces."""
    tags, parents, names, blocks = ["html"], [-1], [[]], []
    stack, current = [0], None
    #: Where in the stack each tag is open, and where block elements are: a look at the last place replaces a search.
    opened: dict[str, list[int]] = {}
    blocks_at: list[int] = [0]

    def cut(depth: int) -> None:
        """Close everything from this depth on."""
        while len(stack) > depth:
            opened[tags[stack.pop()]].pop()
        while blocks_at[-1] >= depth:
            blocks_at.pop()

    def last_open(names: tuple[str, ...]) -> int:
        return max((opened[x][-1] for x in names if opened.get(x)), default=0)

    def add(tag: str, words: list[str]) -> int:
        tags.append(tag), parents.append(stack[-1]), names.append(words)
        return len(tags) - 1

    def text(piece: str) -> None:
        nonlocal current
        if current is None:
            if not piece.strip():
                return
            current = []
            blocks.append((add("#text", []), current))
        current.append(piece)

    last = 0
    for m in _TOKEN.finditer(html):
        if m.start() < last:  # within a control
            continue
        if m.start() > last:
            text(html[last : m.start()])
        last = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                current = None
            continue
        if tag in _SMALL:
            # One without an end is passed over alone: what follows it is text of the page.
            if not m[2] and not m[4].endswith("/") and (whole := _SMALL[tag].match(html, last)):
                last = whole.end()
            continue
        if m[2]:
            if tag not in INLINE:
                current = None
            at = last_open((tag,))
            if at and (tag not in INLINE or at > blocks_at[-1]):
                cut(at)
            continue
        if tag in ("html", "head", "body") and tag != "body":
            continue
        if tag not in INLINE:
            current = None
            # A new block ends an open paragraph; items end items of their own list.
            ends = ("li",) if tag == "li" else ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else ("tr", "td", "th") if tag == "tr" else ()
            if tags[stack[blocks_at[-1]]] == "p":
                cut(blocks_at[-1])
            at = last_open(ends)
            if at > last_open(("ul", "ol", "dl", "table")):
                cut(at)
            blocks_at.append(len(stack))
        words = [w for g in _NAMES.findall(m[4]) for v in g if v for w in _SPLIT.split(v) if w] if m[4] else []
        opened.setdefault(tag, []).append(len(stack))
        stack.append(add(tag, [w.lower() for w in words]))
    if last < len(html):
        text(html[last:])
    return tags, parents, names, blocks


def _clean(pieces: list[str]) -> str:
    return " ".join(references.unescape("".join(pieces)).split())


def measure(html: str) -> tuple[np.ndarray, list[int], list[tuple[int, str]]]:
    """A row of measures per node, the parents, and the text of each block's node."""
    tags, parents, names, raw = parse(html)
    blocks = [(node, t) for node, pieces in raw if (t := _clean(pieces))]
    n = len(tags)
    size, count, leaves, words, ended, paragraphs, links = ([0] * n for _ in range(7))
    for node, t in blocks:
        size[node], leaves[node], words[node] = len(t), 1, t.count(" ") + 1
        ended[node] = t[-1] in ".?!:;\"'”»"
    depth, above_bad, above_good, section, inside = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    bad, good, at, kids = ([0] * n for _ in range(4))
    place = [_PLACE.get(t, _PLACE["div"]) for t in tags]
    for i in range(n):
        p = parents[i]
        if names[i]:
            bad[i], good[i] = sum(w in BAD for w in names[i]), sum(w in GOOD for w in names[i])
        section[i] = place[i] if tags[i] in _SECTIONS else section[p] if p >= 0 else 0
        if p >= 0:
            depth[i], at[i] = depth[p] + 1, kids[p]
            above_bad[i], above_good[i] = above_bad[p] + bad[p], above_good[p] + good[p]
            inside[i] = inside[p] or tags[p] == "a"
            kids[p] += 1
        if inside[i]:
            links[i] = size[i]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        size[p] += size[i]
        count[p] += count[i] + 1
        leaves[p] += leaves[i]
        words[p] += words[i]
        ended[p] += ended[i]
        links[p] += links[i]
        paragraphs[p] += paragraphs[i] + (tags[i] == "p")
    total = max(size[0], 1)
    rows = [
        (place[i], place[p] if (p := parents[i]) >= 0 else -1, section[i], bad[i], good[i], above_bad[i], above_good[i], depth[i],
         math.log1p(size[i]), links[i] / max(size[i], 1), size[i] / (count[i] + 1), size[i] / total, at[i], kids[p] if p >= 0 else 1,
         size[i] / max(size[p], 1) if p >= 0 else 1.0, words[i] / max(leaves[i], 1), ended[i] / max(leaves[i], 1), paragraphs[i])
        for i in range(n)
    ]
    return np.array(rows, float), parents, blocks


class Boosted:
    """Boosted trees of one depth over binned measures, stored as arrays."""

    DEPTH, TREES, RATE, BINS = 4, 40, 0.3, 32

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.cuts = [np.unique(np.quantile(v, np.linspace(0, 1, self.BINS + 1)[1:-1])) for v in x.T]
        bins = self._bins(x)
        self.base = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        margin, self.trees = np.full(len(y), self.base), []
        for _ in range(self.TREES):
            p = 1 / (1 + np.exp(-margin))
            feature, cut, leaf = self._tree(bins, y - p, p * (1 - p))
            self.trees.append((feature, cut, leaf))
            margin += leaf[self._walk(bins, feature, cut)]

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)])

    def _walk(self, bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        at, each = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(self.DEPTH):
            at = 2 * at + 1 + (bins[feature[at], each] > cut[at])
        return at - (2**self.DEPTH - 1)

    def _tree(self, bins: np.ndarray, g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**self.DEPTH - 1
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, self.BINS), np.zeros(inner + 1)
        members = {0: np.arange(bins.shape[1])}
        for node in range(inner):
            own = members.pop(node, np.zeros(0, np.int64))
            best = 1e-6
            for f in range(len(bins)):
                sums = np.cumsum(np.bincount(bins[f, own], g[own], self.BINS + 1))
                weights = np.cumsum(np.bincount(bins[f, own], w[own], self.BINS + 1))
                gain = sums**2 / (weights + 1) + (sums[-1] - sums) ** 2 / (weights[-1] - weights + 1) - sums[-1] ** 2 / (weights[-1] + 1)
                if gain.max() > best:
                    best, feature[node], cut[node] = gain.max(), f, int(gain.argmax())
            right = bins[feature[node], own] > cut[node]
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
        for k in range(inner + 1):
            own = members[inner + k]
            leaf[k] = self.RATE * g[own].sum() / (w[own].sum() + 1)
        return feature, cut, leaf

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        return self.base + sum(leaf[self._walk(bins, f, c)] for f, c, leaf in self.trees)


def decode(log_odds: list[float], parents: list[int]) -> list[bool]:
    """The set of nodes of largest total log-odds in which every kept node's parent is kept; the root is."""
    gain = list(log_odds)
    for i in range(len(gain) - 1, 0, -1):
        if gain[i] > 0:
            gain[parents[i]] += gain[i]
    kept = [True] * len(gain)
    for i in range(1, len(gain)):
        kept[i] = gain[i] > 0 and kept[parents[i]]
    return kept


def sample_page(r: random.Random) -> str:
    """A page of a random layout; article text is marked."""
    word = lambda: "".join(r.choices("etaoinshrdlu", k=r.randint(1, 9)))
    signs = r.choice(["", "", "", "!!", "***", " |"])
    case = r.choice([str, str, str.upper])
    phrase = lambda lo, hi: case(" ".join(word() + signs for _ in range(r.randint(lo, hi))))
    named = lambda *options: r.choice(['{k}="{v}"'.format(k=r.choice(["class", "class", "id"]), v=f"{r.choice(['', '', 'c-', 'site-'])}{r.choice(options)}{r.choice(['', '', '-' + word()])}")])
    links = lambda lo, hi: "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(r.randint(lo, hi)))
    boxed = lambda tags, names, inside: f"<{(t := r.choice(tags))} {named(*names) if t in ('div', 'ul', 'section', 'p') or r.random() < 0.4 else ''}>{inside}</{t}>"
    menu = lambda: boxed(["nav", "nav", "div"], ["nav", "menu", "navbar", "breadcrumb"], f"<ul>{links(2, 9)}</ul>")
    header = lambda: boxed(["header", "div"], ["header", "masthead", "banner"], f"<h2>{phrase(1, 4)}</h2>" * r.randint(0, 1) + phrase(1, 9))
    footer = lambda: boxed(["footer", "footer", "div"], ["footer", "copyright"], f"&copy; {phrase(2, 25)}." + f"<p>{phrase(2, 20)}</p>" * r.randint(0, 1))
    advert = lambda: boxed(["div", "div", "aside", "p"], ["ad", "ads", "advert", "sponsored", "promo", "banner"], phrase(2, 40) + ".")
    notice = lambda: boxed(["div", "section"], ["cookie", "notice", "consent", "alert", "popup"], f"<p>{phrase(4, 30)}.</p>")
    sidebar = lambda: boxed(["aside", "div"], ["sidebar", "related", "widget", "recommended"], f"<h3>{phrase(1, 3)}</h3>" + r.choice([f"<ul>{links(2, 6)}</ul>", f"<p>{phrase(5, 40)}.</p>"]))
    form = lambda: f"<form>{boxed(['p', 'div'], ['subscribe', 'newsletter', 'search', 'login'], phrase(2, 15))}<label>{phrase(1, 3)}</label><input></form>"
    comments = lambda: boxed(["section", "div", "ul"], ["comments", "comment", "replies", "disqus"], "".join(f"<{t}>{phrase(3, 60)}.</{t}>" for t in r.choices(["p", "div", "li"], k=r.randint(1, 6))))
    share = lambda: boxed(["div", "ul"], ["share", "social", "tags", "pager"], links(1, 5))

    def part() -> str:
        m = lambda lo, hi: _MARK + phrase(lo, hi)
        return r.choice([
            lambda: f"<p>{m(3, 120)}.</p>", lambda: f"<p>{m(3, 120)}.</p>", lambda: f"<p>{m(1, 200)}</p>", lambda: f"<p><b>{m(3, 60)}.<br>",
            lambda: f"<h2>{m(1, 6)}</h2>", lambda: f"<ul>{''.join(f'<li>{m(1, 14)}</li>' for _ in range(r.randint(1, 6)))}</ul>",
            lambda: f"<blockquote>{m(3, 40)}</blockquote>", lambda: f"<p>{m(2, 30)} <a href='/x'>{phrase(1, 3)}</a> {phrase(2, 30)}.</p>",
            lambda: f"<table><tr><td>{m(1, 4)}</td><td>{m(1, 4)}</td></tr></table>", lambda: f"<div>{m(4, 80)}.</div>", lambda: f"{m(4, 80)}.",
        ])()

    inner = [part() for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12]))]
    for make, chance in ((advert, 0.25), (sidebar, 0.15), (share, 0.2), (form, 0.15), (comments, 0.15), (notice, 0.1)):
        if r.random() < chance:
            inner.insert(r.randint(0, len(inner)), make())
    title = f"<h1>{_MARK}{phrase(1, 9)}</h1>" if r.random() < 0.8 else ""
    story = boxed(["article", "article", "main", "div"], ["article", "content", "post", "entry", "story", "main"], title + "".join(inner))
    kind = r.random()
    if kind < 0.06:  # text without any layout
        return r.choice([_MARK + phrase(2, 60), "".join(p for p in inner if _MARK in p)])
    if kind < 0.13:
        story = title + "".join(p for p in inner if _MARK in p)
    before = [f() for f, c in ((header, 0.5), (menu, 0.8), (notice, 0.25), (advert, 0.5)) if r.random() < c]
    after = [f() for f, c in ((sidebar, 0.4), (comments, 0.35), (form, 0.25), (advert, 0.3), (share, 0.2), (footer, 0.8)) if r.random() < c]
    r.shuffle(before)
    page = "".join([*before, story, *after])
    for _ in range(r.choice([0, 0, 0, 1, 2])):
        page = f"<div {named('wrap', 'page', 'container', 'layout', word())}>{page}</div>"
    return f"<html><head><title>{phrase(1, 5)}</title></head><body>{page}</body></html>"


def learn(pages: int = 1000, seed: int = 7) -> Boosted:
    """Trees from generated pages; a node is positive if its subtree holds article text."""
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        x, parents, blocks = measure(sample_page(r))
        y = np.zeros(len(x))
        for node, t in blocks:
            if _MARK in t:
                while node >= 0 and not y[node]:
                    y[node], node = 1, parents[node]
        xs.append(x), ys.append(y)
    return Boosted(np.concatenate(xs), np.concatenate(ys))


def main_texts(htmls: list[str | None], model: Boosted) -> list[str]:
    """Main text of each page: kept blocks in page order, joined by two line feeds."""
    pages = [measure(h or "") for h in htmls]
    odds = model.log_odds(np.concatenate([p[0] for p in pages])) if pages else np.zeros(0)
    out, at = [], 0
    for x, parents, blocks in pages:
        kept = decode(odds[at : at + len(x)].tolist(), parents)
        at += len(x)
        out.append("\n\n".join(t for node, t in blocks if kept[node]))
    return out


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``; no shuffle."""
    model = model or learn()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(columns(b, "page_id", "url", "html"))
            for k in range(0, len(rows), 500):
                some = rows[k : k + 500]
                texts = main_texts([h for _, _, h in some], model)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
