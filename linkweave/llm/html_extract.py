"""Main-text extraction by tag-path ratios.

A page is cut into blocks of text, each at a root-to-leaf path of block-level
tags. Per path, mean text length and mean punctuation per block are computed,
smoothed over neighbouring blocks, and fused with the path's share of linked
text; paths whose fused ratio reaches a share of the page's best are content.
Paths through elements that never hold an article's text are left out first.
The <article> or <main> that holds most of the content is then taken: an article
whole, a main as far as its paths are content.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparkutil import output, session

#: Least fused ratio of a content path, as a share of the page's best.
SHARE = 0.12
#: Weights of a block and its neighbours on either side when ratios are smoothed.
KERNEL = np.array([0.06, 0.24, 0.4, 0.24, 0.06])
#: Largest share of linked text in content.
LINKED = 0.5

# Fixed values of HTML: elements by how their content is treated.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "audio", "video", "canvas", "select", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "main", "div", "body", "blockquote"}
NEVER = {"nav", "aside", "footer", "button", "dialog", "menu", "head", "search"}
#: Elements that are left out, as those with a marked name are, unless they hold most of the page.
SELDOM = {"form", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
#: Words of class and id names that mark what is not an article's text.
NEVER_NAMES = {
    "ad", "ads", "adbox", "adslot", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "captcha", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "discussion", "disqus",
    "footer", "gdpr", "hidden", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promotion", "rail", "recommended", "related", "replies",
    "reply", "respond", "search", "share", "sharing", "sidebar", "signin", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar", "warning", "widget", "widgets",
}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")


@dataclass
class Block:
    """Text under one leaf of the page's tree, and where it is: the number of its path, and the path's last tag."""

    path: int
    leaf: str
    never: bool
    seldom: tuple[int, ...]
    within: tuple[int, ...]
    article: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _marks(name: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """The tag's name with its class and id, and whether its content never or seldom is article text; the latter
    is plain where a whole name consists of marked words."""
    names, never, seldom, plain = [], name in NEVER, name in SELDOM, False
    if attributes and not attributes.isspace():
        for key, *values in _MARKS.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id"):
                names += value.lower().split()
                for one in value.split():
                    found = {w.lower() for w in _NAME.findall(one)}
                    seldom |= bool(found & NEVER_NAMES)
                    plain |= bool(found) and found <= NEVER_NAMES
            elif key == "role":
                never |= value.lower() in NEVER_ROLES
            elif key == "hidden":
                never = True
            elif key == "aria-hidden":
                never |= value.lower() == "true"
            else:
                never |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    if name in ("body", "html"):
        never = seldom = plain = False
    if name in ("article", "main"):
        never = False
    return ".".join([name, *sorted(names)]), never, seldom, plain


def blocks(page: str) -> list[Block]:
    """Non-blank blocks of a page in order; broken markup never fails."""
    found: list[Block] = []
    stack: list[tuple[str, int, str, bool, list[int]]] = []
    paths: dict[tuple[int, str], int] = {}  # equal paths have one number, whatever their depth
    marks: list[int] = []
    regions: list[int] = []
    standing: Counter[str] = Counter()  # open elements by name, so that an end tag without one costs nothing
    never, inside, links, opened, marked = 0, 0, 0, 0, 0
    open_ = True

    def say(raw: str) -> None:
        nonlocal open_
        if not raw or (open_ and raw.isspace()):
            return
        if open_:
            found.append(Block(*(stack[-1][1:3] if stack else (0, "")), never > 0, tuple(marks), tuple(regions), standing["article"] > 0))
            open_ = False
        text = html.unescape(raw)
        found[-1].parts.append(text)
        if links:
            found[-1].linked += len(text.strip())

    def close_to(depth: int) -> None:
        nonlocal never, inside, links, open_, marks
        while len(stack) > depth:
            name, _, _, bad, marks = stack.pop()
            standing[name] -= 1
            never -= bad
            if name in ("article", "main"):
                inside -= 1
                regions.pop()
            links -= name == "a"
            open_ |= name not in INLINE

    def close_implied(names: set[str]) -> None:
        """Close the innermost open element of ``names``, unless a scope is between."""
        if not any(standing[name] for name in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                close_to(i)
                return
            if stack[i][0] in SCOPES:
                return

    at, n = 0, len(page)
    while at < n:
        low = page.find("<", at)
        if low < 0:
            say(page[at:])
            break
        say(page[at:low])
        m = _TAG.match(page, low) or _LOOSE.match(page, low)
        if not m:
            say("<")
            at = low + 1
            continue
        at = m.end()
        if m.lastindex is None or not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1 if standing[name] else -1, -1, -1):
                if stack[i][0] == name:
                    close_to(i)
                    break
                if name in INLINE and stack[i][0] not in INLINE or name == "p" and stack[i][0] in SCOPES:
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            if not m[3].rstrip().endswith("/") or name not in ("svg", "math"):
                at = end.end() if end else n
            open_ |= name not in ("svg", "math", "audio", "video", "canvas", "select")
            continue
        if name in VOID:
            if name == "br":
                say(" ")
            elif name == "hr":
                open_ = True
            continue
        if name in CLOSES_P:
            close_implied({"p"})
        if name in HEADINGS:
            close_implied(HEADINGS)
        if name in CLOSED_BY:
            close_implied(CLOSED_BY[name])
        if name not in INLINE:
            open_ = True
        if name in ("html", "body") and standing[name]:
            continue
        label, bad, seldom, plain = _marks(name, m[3])
        if name == "header" and not inside:
            bad = True
        path, leaf = stack[-1][1:3] if stack else (0, "")
        if name not in INLINE:
            path, leaf = paths.setdefault((path, label), len(paths) + 1), label
        stack.append((name, path, leaf, bad, marks))
        standing[name] += 1
        never += bad
        if name in ("article", "main"):
            # an article of comments or teasers says so itself; a wrapper's name doesn't
            if not seldom and not inside:
                marks = []
            seldom = False
        if seldom:
            marked += 1
            marks = [*marks, -marked if plain else marked]
        if name in ("article", "main"):
            inside += 1
            opened += 1
            regions.append(opened)
        links += name == "a"
    found = [b for b in found if b.text()]
    total, held = 0, defaultdict(int)
    for b in found:
        b.never |= any(mark < 0 for mark in b.seldom)
        if not b.never:
            total += len(b.text())
            for mark in b.seldom:
                held[mark] += len(b.text())
    for b in found:
        b.never |= any(2 * held[mark] <= total for mark in b.seldom)
    return found


def path_ratios(found: list[Block]) -> dict[int, float]:
    """Fused ratio of each path: text and punctuation per block, smoothed, less linked text."""
    length, marks, linked, n = (defaultdict(float) for _ in range(4))
    for b in found:
        text = b.text()
        length[b.path] += len(text)
        marks[b.path] += len(_PUNCTUATION.findall(text))
        linked[b.path] += min(b.linked, len(text))
        n[b.path] += 1
    raw = np.array([[length[b.path] / n[b.path], marks[b.path] / n[b.path] + 1] for b in found])
    pad = len(KERNEL) // 2
    near = np.stack([np.convolve(np.pad(raw[:, k], pad, mode="edge"), KERNEL, "valid") for k in (0, 1)], 1)
    sums: dict[int, float] = defaultdict(float)
    for b, (text, punctuation) in zip(found, near, strict=True):
        sums[b.path] += float(np.sqrt(text * punctuation))
    return {p: s / n[p] * (1 - linked[p] / length[p]) for p, s in sums.items()}


def _link(b: Block) -> bool:
    """Whether a block is mostly link; headings and an article's paragraphs may be."""
    leaf = b.leaf.split(".")[0]
    return b.linked > LINKED * max(1, len(b.text())) and leaf not in HEADINGS and not (b.article and leaf == "p")


def _region(found: list[Block], keep: list[bool]) -> tuple[list[Block], list[bool]]:
    """Blocks of the innermost article or main that holds most of the text kept by ratios.

    Where most of it lies outside all of them, articles are teasers and left
    out; where neither holds most, ratios alone decide, within them as without.
    """
    mass: dict[tuple[int, ...], int] = defaultdict(int)
    for b, k in zip(found, keep, strict=True):
        for depth in range(len(b.within) + 1) if k else ():
            mass[b.within[:depth]] += len(b.text())
    top: tuple[int, ...] = ()
    while inner := [r for r in mass if len(r) == len(top) + 1 and r[:-1] == top and 2 * mass[r] > mass[top]]:
        top = inner[0]
    outside = sum(len(b.text()) for b, k in zip(found, keep, strict=True) if k and not b.within)
    if top:
        at = [i for i, b in enumerate(found) if b.within[: len(top)] == top]
    elif 2 * outside > mass[()]:
        at = [i for i, b in enumerate(found) if not b.within]
    else:
        at = list(range(len(found)))
        for b in found:
            b.article = False
    return [found[i] for i in at], [keep[i] for i in at]


def main_text(page: str | None) -> str:
    """The article's blocks, each with single spaces, one to a line; empty if there are none."""
    found = [b for b in blocks(page or "") if not b.never]
    if not found:
        return ""
    ratios = path_ratios(found)
    least = SHARE * max(ratios.values())
    keep = [ratios[b.path] >= least and not _link(b) for b in found]
    found, keep = _region(found, keep)
    # headings and short parts between or before content of the same container belong to it
    for k in range(len(found) - 1, -1, -1):
        b, after = found[k], found[k + 1] if k + 1 < len(found) else None
        if not keep[k] and not _link(b):
            if after is not None and keep[k + 1] and b.leaf.split(".")[0] in HEADINGS:
                keep[k] = True
            elif b.article:
                keep[k] = True
    return "\n".join(b.text() for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every whole page: the id, ``url``, ``text`` and ``n_chars`` (code points).

    A null or empty page, or one without content, has an empty text. Repeated
    rows each get a row, null ids and urls are kept, other columns are ignored.
    """
    session(pages)
    kind = pages.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            schema = pa.schema([batch.schema.field(0), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
            yield output(schema, __id=batch.column(0), url=batch.column(1), text=texts, n_chars=[len(t) for t in texts])

    source = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("url"), F.col(html_col).alias("__html"))
    return source.mapInArrow(read, f"__id {kind}, url string, text string, n_chars long").withColumnRenamed("__id", id_col)
