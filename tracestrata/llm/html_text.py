"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Method. A page is cut into leaf blocks: stretches of text between block-level
tags, each with the tags, classes and roles of its ancestors. Features are
ancestor tags, words of class and id, link density, text length, punctuation
and place. A linear-chain conditional random field labels the sequence of
blocks as main text or not; it is trained by gradient ascent on the exact
likelihood over labelled pages and decoded by Viterbi.

Labelled pages are those that mark their main text themselves (an article or
main element): its blocks are main text, except menus, forms, adverts, comments
and the like inside; the others are not. The model also sees each page with
these ancestors hidden, so that it can label pages without such marks. Training
uses a bounded sample of pages (`sample`, those with the smallest hash), long ones in
stretches of `STRETCH` blocks.

Scripts, styles, templates and comments are markup and never become blocks.

Defined results. Null or empty html: empty text, 0 characters. Text without any
tag is one block and is judged like others. Without a labelled page the fixed
starting weights are used. Repeated rows get equal results.
"""

from __future__ import annotations

import html as entities
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracestrata.llm.text import slices

SAMPLE = 400
STRETCH = 400

# HTML element names by what they do to a block.
SKIPPED = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "select", "textarea")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details",
    "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
    "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
)
# An open element of the first kind ends where one of the others begins.
IMPLIED = {
    "p": frozenset(BLOCKS) - {"button", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "title"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
# What can stand in a head; anything else closes it.
HEAD_ONLY = ("base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title")
MAIN = ("article", "main")
BOILERPLATE = ("nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "legend")
# Parts of class, id and role that name boilerplate or main text.
BAD_NAMES = (
    "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored", "nav", "navbar", "menu",
    "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "header", "masthead", "cookie",
    "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "login", "form",
    "share", "social", "related", "recommended", "comment", "comments", "reply", "replies", "disqus", "widget",
    "pagination", "pager", "tags", "complementary", "contentinfo", "search", "toolbar", "skip",
)
GOOD_NAMES = ("article", "content", "main", "post", "entry", "story", "body", "text", "page")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|([^<]+|<)",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")
_TITLE_END = re.compile(r"<(/title|/head|body)[\s/>]", re.I)
_HEAD = frozenset(HEAD_ONLY)
_VOID, _BLOCK, _SKIPPED = frozenset(VOID), frozenset(BLOCKS), frozenset(SKIPPED)
_BAD, _GOOD, _BOILER = frozenset(BAD_NAMES), frozenset(GOOD_NAMES), frozenset(BOILERPLATE)


class Block:
    """A leaf block: text, ancestor tags, telling parts of their attributes, share of linked text."""

    __slots__ = ("text", "tags", "names", "linked")

    def __init__(self, text, tags, names, linked):
        self.text, self.tags, self.names, self.linked = text, tags, names, linked


class _Open:
    """The elements that are open, with what is true of all of them; each step takes the same time at any depth."""

    def __init__(self):
        # (tag, tags down to here, telling names down to here)
        self.stack: list[tuple[str, frozenset, frozenset]] = []
        self.count: dict[str, int] = {}
        self.block_at: list[int] = []

    def has(self, tag: str) -> bool:
        return self.count.get(tag, 0) > 0

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def tags(self) -> frozenset:
        return self.stack[-1][1] if self.stack else frozenset()

    def names(self) -> frozenset:
        return self.stack[-1][2] if self.stack else frozenset()

    def push(self, tag: str, names: frozenset) -> None:
        tags, known = self.tags(), self.names()
        # Of all tags and names just those that a feature can ask for, so both sets are bounded.
        tags = tags | {tag} if tag in _KNOWN and tag not in tags else tags
        self.stack.append((tag, tags, known if names <= known else known | names))
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in _BLOCK:
            self.block_at.append(len(self.stack) - 1)

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.count[tag] -= 1
        if self.block_at and self.block_at[-1] == len(self.stack):
            self.block_at.pop()
        return tag

    def close(self, tag: str) -> None:
        """Up to and with the innermost `tag`, if there is one."""
        if self.has(tag):
            while self.pop() != tag:
                pass


_TELLING = frozenset(BAD_NAMES) | frozenset(GOOD_NAMES)
_KNOWN = frozenset(BLOCKS) | frozenset(("a", "b", "head", "label"))
_DECLARATION = re.compile(r"<[!?]")


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, white space collapsed, references decoded; in linear time."""
    out: list[Block] = []
    inside = _Open()
    parts: list[str] = []
    linked = 0
    skipping = ""
    last_end = page.rfind(">")  # behind it there is no markup any more
    title_end: re.Match | None = None
    no_title_end = False

    def flush():
        nonlocal parts, linked
        if parts:
            text = _BLANK.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, inside.tags(), inside.names(), min(1.0, linked / len(text))))
        parts, linked = [], 0

    def leave_head():
        flush()
        while inside.has("head"):
            inside.pop()

    at, end = 0, len(page)
    while at < end:
        if skipping:  # its content is no markup
            found = _raw_end(skipping).search(page, at)
            if not found:
                break
            at = page.find(">", found.start()) + 1 or end
            skipping = ""
            continue
        if at > last_end and not _DECLARATION.match(page, at):
            found = _DECLARATION.search(page, at)
            begin, at = at, found.start() if found else end
            closing = tag = attributes = closing2 = tag2 = attributes2 = None
            text = page[begin:at]
        else:
            token = _TOKEN.match(page, at)
            at = token.end()
            closing, tag, attributes, closing2, tag2, attributes2, text = token.groups()
        if text is not None:
            if inside.top() == "head" and text.strip():
                leave_head()
            parts.append(text)
            if inside.has("a"):
                linked += len(text.strip())
            continue
        if not (tag := (tag or tag2 or "").lower()):
            continue
        closing, attributes = closing or closing2, attributes or attributes2 or ""
        if tag == "br":
            parts.append(" ")
        elif closing:
            if tag in _BLOCK:
                flush()
            inside.close(tag)
        else:
            if tag not in _HEAD and inside.has("head"):
                leave_head()
            if inside.top() == "title":  # never closed
                flush()
                inside.pop()
            if tag in _BLOCK:
                flush()
                while inside.stack and tag in IMPLIED.get(inside.top(), ()):
                    inside.pop()
                # A paragraph that inline tags are still open in.
                if inside.block_at and inside.stack[inside.block_at[-1]][0] == "p" and tag in IMPLIED["p"]:
                    inside.close("p")
            if tag in _SKIPPED and tag != "head":
                if not attributes.rstrip().endswith("/"):
                    skipping = tag
            elif tag == "title" and not no_title_end:
                if title_end is None or title_end.start() < at:
                    title_end = _TITLE_END.search(page, at)
                    no_title_end = title_end is None
                if title_end and title_end[1].lower() == "/title":
                    skipping = tag
                else:
                    inside.push(tag, frozenset())
            elif tag not in _VOID and not attributes.rstrip().endswith("/"):
                words = {
                    w for groups in _NAMES.findall(attributes) for value in groups for w in _PART.findall(value.lower())
                } if attributes else ()
                inside.push(tag, _TELLING.intersection(words))
    flush()
    return [b for b in out if "head" not in b.tags and "title" not in b.tags]


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}[\s/>]", re.I)


_TAGS = (
    "nav", "header", "footer", "aside", "form", "ul", "li", "a", "p", "h1", "h2", "h3", "table", "td",
    "section", "div", "blockquote", "pre", "figure", "figcaption", "button", "label", "b",
)
FEATURES = len(_TAGS) + 16


def features(found: list[Block], marks: bool = True) -> np.ndarray:
    """One row per block; without `marks` the elements that label a page are hidden."""
    x = np.zeros((len(found), FEATURES))
    n = len(_TAGS)
    for i, b in enumerate(found):
        for k, tag in enumerate(_TAGS):
            x[i, k] = tag in b.tags
        size = len(b.text)
        x[i, n] = marks and any(t in b.tags for t in MAIN)
        x[i, n + 1] = bool(b.names & _BAD)
        x[i, n + 2] = bool(b.names & _GOOD)
        x[i, n + 3] = b.linked
        x[i, n + 4 : n + 8] = size < 20, 20 <= size < 60, 60 <= size < 200, size >= 200
        x[i, n + 8] = b.text[-1] in ".!?…\"'”»"
        x[i, n + 9] = "©" in b.text or "·" in b.text or "|" in b.text
        x[i, n + 10] = any(t in b.tags for t in _BOILER)
        x[i, n + 11] = i == 0
        x[i, n + 12] = i == len(found) - 1
        x[i, n + 13] = b.text.count(",") + b.text.count(". ") > 0
        x[i, n + 14] = marks and x[i, n + 10] and x[i, n]
        x[i, n + 15] = 1
    return x


def labels(found: list[Block]) -> np.ndarray | None:
    """1 for main text, by the page's own marks; none if it has no such mark."""
    if not any(t in b.tags for b in found for t in MAIN):
        return None
    return np.array(
        [
            any(t in b.tags for t in MAIN) and not (b.tags & _BOILER - {"header"}) and not b.names & _BAD
            for b in found
        ],
        int,
    )


class Chain:
    """Two labels; emission weights for label 1, and a transition matrix."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @staticmethod
    def start() -> Chain:
        w = np.zeros(FEATURES)
        n = len(_TAGS)
        w[n], w[n + 1], w[n + 10], w[n + 14], w[n + 3], w[n + 7] = 3.0, -4.0, -3.0, -3.0, -2.0, 1.0
        w[_TAGS.index("p")], w[-1] = 1.5, -1.0
        return Chain(w, np.zeros((2, 2)))

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        emit = x @ self.weights
        best, back = np.array([0.0, emit[0]]), []
        for e in emit[1:]:
            ways = best[:, None] + self.moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + np.array([0.0, e])
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return np.array(path[::-1])

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, ridge: float = 1e-3) -> Chain:
        """Gradient ascent with per-weight step sizes on the exact log-likelihood.

        Pages are padded to one length and go through the forward and backward
        sums together.
        """
        n, length = len(pages), max(len(y) for _, y in pages)
        x = np.zeros((n, length, FEATURES))
        y = np.zeros((n, length), int)
        inside = np.zeros((n, length))
        for i, (rows, given) in enumerate(pages):
            x[i, : len(given)], y[i, : len(given)], inside[i, : len(given)] = rows, given, 1
        pairs = inside[:, 1:] * inside[:, :-1]
        seen = np.array(
            [[((y[:, :-1] == a) & (y[:, 1:] == b) & (pairs > 0)).sum() for b in (0, 1)] for a in (0, 1)], float
        )
        w, m = self.weights.copy(), self.moves.copy()
        gw, gm = np.full(w.shape, 1e-8), np.full(m.shape, 1e-8)
        for _ in range(rounds):
            emit = np.stack([np.zeros((n, length)), x @ w], axis=2)
            alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
            alpha[:, 0] = emit[:, 0]
            for t in range(1, length):
                new = np.logaddexp(alpha[:, t - 1, :1] + m[0], alpha[:, t - 1, 1:] + m[1]) + emit[:, t]
                alpha[:, t] = np.where(inside[:, t, None] > 0, new, alpha[:, t - 1])
            for t in range(length - 2, -1, -1):
                after = emit[:, t + 1] + beta[:, t + 1]
                new = np.logaddexp(m[:, 0] + after[:, :1], m[:, 1] + after[:, 1:])
                beta[:, t] = np.where(inside[:, t + 1, None] > 0, new, beta[:, t + 1])
            total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            one = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None]) * inside
            grad_w = np.einsum("nt,ntf->f", (y * inside - one), x) / n - ridge * w
            both = np.exp(
                alpha[:, :-1, :, None] + m + (emit + beta)[:, 1:, None, :] - total[:, None, None, None]
            ) * pairs[:, :, None, None]
            grad_m = (seen - both.sum(axis=(0, 1))) / n - ridge * m
            gw, gm = gw + grad_w**2, gm + grad_m**2
            w, m = w + 0.5 * grad_w / np.sqrt(gw), m + 0.5 * grad_m / np.sqrt(gm)
        return Chain(w, m)


def train(pages: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain fitted on at most `sample` pages that mark their main text."""
    marked = pages.where(F.lower("html").rlike("<(article|main)[\\s>]"))
    chosen = marked.select("html").orderBy(F.xxhash64("html"), "html").limit(sample)

    def task(batches):
        for batch in batches:
            for page in batch.column("html").to_pylist():
                found = blocks(page)
                if (given := labels(found)) is None:
                    continue
                for marks in (True, False):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([features(found, marks).ravel()], pa.list_(pa.float64())),
                         pa.array([given], pa.list_(pa.int32()))],
                        names=["x", "y"],
                    )

    rows = chosen.mapInArrow(task, "x array<double>, y array<int>").collect()  # `sample` pages, twice
    seen = sorted((tuple(r["y"]), tuple(r["x"])) for r in rows)
    start = Chain.start()
    if not seen:
        return start
    whole = [(np.array(x).reshape(-1, FEATURES), np.array(y)) for y, x in seen]
    return start.fit([(x[k : k + STRETCH], y[k : k + STRETCH]) for x, y in whole for k in range(0, len(y), STRETCH)])


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main of every row of `pages` (page_id, url, html)."""
    chain = train(pages, sample)

    def task(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts, counts, mains = [], [], []
                for page in part.column("html").to_pylist():
                    found = blocks(page or "")
                    path = chain.viterbi(features(found)) if found else []
                    main = [b.text for b, label in zip(found, path) if label]
                    texts.append("\n\n".join(main))
                    counts.append(len(found))
                    mains.append(len(main))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                     pa.array(mains, pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(
        task, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long"
    )
