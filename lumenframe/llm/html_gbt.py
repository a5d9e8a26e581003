"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down.

A page becomes a tree of block elements and of runs of text between block boundaries.
Every node is described by its subtree's size, density and share of link text, the
tokens of its class, id and role attributes and those of its ancestors, its tag, its
depth and its place among its siblings.  Tokens are hashed; what a bucket tells is learnt
from pages other than those the trees are fitted on.  Boosted trees give the probability
that a subtree holds main text.  A node may be kept only if its parent is, so the decoding
chooses, from the leaves up, between keeping a node with the best choice for each
child and dropping it with all that is below it; no contradiction can come out.

The model is trained here, on pages that a generator makes with known main text
(html_pages).  Training is deterministic and takes a few seconds; the model has a
fixed size.

Pages are read in time linear in their length, whatever is broken in them: a quote that
is closed nowhere ends with its word, and elements nested deeper than DEEPEST are taken
as their parent, as browsers do.  Elements that are hidden by an attribute or their own
style (other than the body) aren't text of the page.

A null page is empty, and a page without text gives an empty text; an empty table gives
none.  Rows with null or repeated ids are treated each by itself; other columns than
page_id, url and html, of any name, aren't read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from lumenframe.llm.common import beside

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
HIDDEN = frozenset("head script style noscript template iframe object svg annotation canvas select textarea datalist audio video map".split())
RAW = frozenset("script style textarea title iframe noscript noembed xmp".split())
BLOCK = frozenset(
    "html body article aside main section nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "form fieldset legend blockquote pre address figure figcaption details summary dialog center hgroup menu search".split()
)
#: What an opening tag closes, if it is open within the nearest of the limits.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
_LIMITS = frozenset("ul ol dl table body html menu".split())
_ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}

TAGS = {t: i for i, t in enumerate("p li h1 h2 h3 h4 div article main section nav header footer aside form ul ol td table blockquote pre dd figure body".split(), 1)}

DEEPEST = 512
#: Buckets of attribute tokens.
BUCKETS = 4096
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The attributes of a well-formed tag; no part of it is tried twice.
_WHOLE = re.compile(r"((?>\s+[^\s\"'<>/=]+(?>\s*=\s*(?>\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*+)\s*+(/?)>")
_NEXT = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)?\s*(=?)\s*")
_BARE = re.compile(r"[^\s>]*")
_PART = re.compile(r"[A-Z]?[a-z]+")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
N_FEATURES = 28


class Page:
    """Nodes in page order: element or run of text (tag None)."""

    __slots__ = ("child_no", "depth", "flags", "inherited", "links", "parent", "tag", "text", "tokens")

    def __init__(self):
        self.tag, self.parent, self.depth, self.flags, self.inherited = [], [], [], [], []
        self.text, self.links, self.child_no, self.tokens = [], [], [], []

    def add(self, tag: str | None, parent: int, flags: int, tokens: tuple[int, ...] = (), text: str = "", links: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.flags.append(flags)
        self.inherited.append((self.inherited[parent] | self.flags[parent]) if parent >= 0 else 0)
        self.tokens.append(tokens)
        self.text.append(text)
        self.links.append(links)
        return len(self.tag) - 1


def attributes(html: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], bool, int]:
    """The attributes of a tag whose name ends at `at`, whether it closes itself, and the place after it. last: the last place of each quote."""
    found: dict[str, str] = {}
    while True:
        m = _NEXT.match(html, at)
        at, name = m.end(), m[1]
        if name is None:
            return found, m[0].endswith("/"), at + 1
        value = ""
        if m[2]:
            quote = html[at : at + 1]
            if quote in last and at < last[quote]:
                end = html.index(quote, at + 1)
                value, at = html[at + 1 : end], end + 1
            else:
                v = _BARE.match(html, at)
                value, at = v[0], v.end()
        found.setdefault(name.lower(), value)


def _about(found: dict[str, str]) -> tuple[tuple[int, ...], bool]:
    """Buckets of the tokens, and whether the element is hidden."""
    tokens = {t.lower() for a in ("class", "id", "role") for t in _PART.findall(found.get(a, ""))}
    hidden = ("hidden" in found and found["hidden"].lower() != "until-found") or bool(_UNSEEN.search(found.get("style", "")))
    return tuple(sorted(zlib.crc32(t.removesuffix("s").encode()) % BUCKETS for t in tokens)), hidden


@lru_cache(maxsize=20_000)
def _of_whole(text: str) -> tuple[tuple[int, ...], bool]:
    return _about(attributes(text + ">", 0, {q: text.rfind(q) for q in "\"'"})[0])


def _flags(tag: str) -> int:
    """8: a tag of boilerplate; 16: of main text; 32: form; 64: header."""
    out = 8 if tag in ("nav", "footer", "aside", "form", "dialog", "menu", "search") else 16 if tag in ("article", "main") else 0
    return out | 32 * (tag in ("form", "fieldset")) | 64 * (tag in ("header", "hgroup"))


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?![^\s/>])[^>]*>?", re.I)


def parse(html: str) -> Page:
    page = Page()
    root = page.add("html", -1, 0)
    stack = [("html", root, False)]  # (tag, node of the nearest block, hidden)
    opened: dict[str, int] = {}
    endless: set[str] = set()  # elements that are closed nowhere from here on
    last = {q: html.rfind(q) for q in "\"'"}
    buffer, linked, in_link = [], 0, 0
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                page.add(None, stack[-1][1], 0, (), text, min(linked, len(text)))
        linked = 0

    def write(piece: str) -> None:
        nonlocal linked
        if not stack[-1][2]:
            buffer.append(piece)
            if in_link:
                linked += len(piece.strip())

    def close(tag: str, limits: frozenset) -> None:
        if not opened.get(tag):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                if any(t in BLOCK for t, _, _ in stack[k:]):
                    flush()
                for t, _, _ in stack[k:]:
                    opened[t] -= 1
                del stack[k:]
                return
            if stack[k][0] in limits:
                return

    while at < n:
        start = html.find("<", at)
        if start != at:
            write(html[at : start if start >= 0 else n])
            if start < 0:
                break
        kind = html[start + 1 : start + 2]
        ends = kind == "/"
        named = _NAME.match(html, start + 1 + ends)
        if not named:
            if kind in ("!", "?", "/"):
                mark = "-->" if html.startswith("<!--", start) else ">"
                found = html.find(mark, start + 2)
                at = found + len(mark) if found >= 0 else n
            else:
                write("<")
                at = start + 1
            continue
        tag = named[0].lower()
        whole = _WHOLE.match(html, named.end())
        if whole:
            (tokens, hidden), alone, at = _of_whole(whole[1]) if not ends and whole[1] else ((), False), bool(whole[2]), whole.end()
        else:
            found, alone, at = attributes(html, named.end(), last)
            tokens, hidden = _about(found)
        if ends:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag == "p" and not opened.get("p"):
                flush()
            close(tag, frozenset())
            continue
        if tag in HIDDEN or tag in RAW:
            found = _end_of(tag).search(html, at) if not alone and tag not in endless else None
            if found:
                at = found.end()
            elif tag in RAW and not alone:
                at = n
            elif not alone:
                endless.add(tag)
            continue
        if tag in VOID:
            write(" ")
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            in_link = 1
        if tag in BLOCK:
            in_link = in_link if tag not in ("p", "li", "div") else 0
            if tag in _ENDS_P:
                close("p", frozenset(("td", "th", "table", "button")))
            for other in _CLOSES.get(tag, ()):
                close(other, _LIMITS)
            flush()
            if tag in ("html", "body") or len(stack) > DEEPEST:
                continue
            stack.append((tag, page.add(tag, stack[-1][1], _flags(tag), tokens), stack[-1][2] or hidden))
            opened[tag] = opened.get(tag, 0) + 1
        elif not alone and len(stack) <= DEEPEST:
            stack.append((tag, stack[-1][1], stack[-1][2] or hidden))
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return page


def features(page: Page, odds: np.ndarray) -> np.ndarray:
    """odds: what each bucket of tokens tells."""
    n = len(page.tag)
    told = np.zeros((n, 4))  # least and greatest of the own tokens, and of those of all ancestors
    for i in range(1, n):
        p = page.parent[i]
        told[i, 2], told[i, 3] = min(told[p, 0], told[p, 2]), max(told[p, 1], told[p, 3])
        if page.tokens[i]:
            own = odds[list(page.tokens[i])]
            told[i, 0], told[i, 1] = min(0.0, own.min()), max(0.0, own.max())
    parent, depth = np.array(page.parent), np.array(page.depth, float)
    chars = np.array([len(t) for t in page.text], float)
    words = np.array([t.count(" ") + 1 if t else 0 for t in page.text], float)
    marks = np.array([t.count(".") + t.count(",") + t.count("?") + t.count(";") for t in page.text], float)
    links, runs = np.array(page.links, float), (chars > 0).astype(float)
    size, longest = np.ones(n), chars.copy()
    total_links, total_chars, total_words, total_marks, total_runs = links.copy(), chars.copy(), words.copy(), marks.copy(), runs.copy()
    count = np.zeros(n)
    number = np.zeros(n)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        size[p] += size[i]
        total_chars[p] += total_chars[i]
        total_links[p] += total_links[i]
        total_words[p] += total_words[i]
        total_marks[p] += total_marks[i]
        total_runs[p] += total_runs[i]
        if longest[i] > longest[p]:
            longest[p] = longest[i]
        count[p] += 1
    given = np.zeros(n)
    for i in range(1, n):
        number[i] = given[parent[i]]
        given[parent[i]] += 1
    up = np.maximum(parent, 0)
    flags, inherited = np.array(page.flags), np.array(page.inherited)
    whole = max(1.0, total_chars[0])
    before = np.cumsum(chars) - chars
    out = np.empty((n, N_FEATURES))
    tags = [t or page.tag[p] for t, p in zip(page.tag, page.parent, strict=True)]
    code = np.array([TAGS.get(t, 0) for t in tags], float)
    words_safe, chars_safe = np.maximum(total_words, 1), np.maximum(total_chars, 1)
    columns = (
        np.log1p(total_chars), np.log1p(total_words), total_links / chars_safe, total_chars / (size + total_runs), total_marks / words_safe,
        chars_safe / words_safe, np.log1p(size), np.log1p(longest), total_chars / whole, before / whole, (before + total_chars) / whole,
        depth, number, count[up], number / np.maximum(count[up], 1), code, code[up], *told.T, np.array([len(t) for t in page.tokens], float), (count[up] - number),
        ((flags | inherited) & 8) / 8.0, ((flags | inherited) & 16) / 16.0, ((flags | inherited) & 32) / 32.0,
        total_chars / np.maximum(total_chars[up], 1), ((flags | inherited) & 64) / 64.0,
    )
    for k, c in enumerate(columns):
        out[:, k] = c
    return out


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth: per tree the feature and cut of each inner node, the value of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(trees):
            at = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.leaf[t, at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 4.0) -> Forest:
    """Logistic loss, second order, cuts at quantiles."""
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    inner = (1 << depth) - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    base = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(n, base)
    flat = binned + np.arange(f) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            cell = ((at - first)[:, None] * (f * bins) + flat).ravel()
            gs = np.bincount(cell, np.repeat(g, f), width * f * bins).reshape(width, f, bins).cumsum(axis=2)
            hs = np.bincount(cell, np.repeat(h, f), width * f * bins).reshape(width, f, bins).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < 1) | (ht - hs < 1)] = -1
            for k in range(width):
                j, b = np.unravel_index(np.argmax(gain[k]), (f, bins))
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, first + k], cut[t, first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        k = at - inner
        leaf[t] = -rate * np.bincount(k, g, inner + 1) / (np.bincount(k, h, inner + 1) + l2)
        z += leaf[t, k]
    return Forest(feature, cut, leaf, base)


@dataclass(frozen=True)
class Model:
    odds: np.ndarray
    forest: Forest


def _labelled(rng: np.random.Generator) -> tuple[Page, np.ndarray]:
    """A made page, and which of its nodes hold main text."""
    from lumenframe.llm.html_pages import make_page

    html, main = make_page(rng)
    page = parse(html)
    good = np.array([t in main for t in page.text], bool)
    for i in range(len(good) - 1, 0, -1):
        good[page.parent[i]] |= good[i]
    return page, good


@lru_cache(maxsize=1)
def model(seed: int = 11, pages: int = 800, for_tokens: int = 400) -> Model:
    rng = np.random.default_rng(seed)
    seen = np.ones((2, BUCKETS))
    for _ in range(for_tokens):
        page, good = _labelled(rng)
        for tokens, g in zip(page.tokens, good, strict=True):
            for t in tokens:
                seen[int(g), t] += 1
    odds = np.log(seen[1] / seen[0])
    made = [_labelled(rng) for _ in range(pages)]
    return Model(odds, boost(np.concatenate([features(p, odds)[1:] for p, _ in made]), np.concatenate([g[1:] for _, g in made]).astype(float)))


def decode(page: Page, margin: np.ndarray) -> list[str]:
    """Texts of the kept runs. margin: log odds of each node but the root."""
    n = len(page.tag)
    keep_gain = np.zeros(n)  # of keeping, over dropping with all below
    keep_gain[1:] = margin
    total = keep_gain.tolist()
    parent = page.parent
    for i in range(n - 1, 0, -1):
        if total[i] > 0:
            total[parent[i]] += total[i]
    kept = [False] * n
    kept[0] = True
    out = []
    for i in range(1, n):
        if kept[parent[i]] and total[i] > 0:
            kept[i] = True
            if page.tag[i] is None:
                out.append(page.text[i])
    return out


def extract_texts(pages: list[str], trained: Model) -> list[str]:
    parsed = [parse(h) for h in pages]
    xs = [features(p, trained.odds)[1:] for p in parsed]
    if not xs:
        return []
    margins = trained.forest.margin(np.concatenate(xs)) if sum(map(len, xs)) else np.zeros(0)
    out, at = [], 0
    for p, x in zip(parsed, xs, strict=True):
        out.append("\n".join(decode(p, margins[at : at + len(x)])))
        at += len(x)
    return out


def extract(pages: DataFrame, trained: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    trained = trained or model()

    def work(htmls: list[str]) -> dict:
        texts = [t for s in range(0, len(htmls), 128) for t in extract_texts(htmls[s : s + 128], trained)]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return beside(pages, ["page_id", "url"], "html", work, {"text": "string", "n_chars": "long"})
