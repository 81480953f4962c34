"""Reading parts of HTML pages by selectors: pages and a table of rules in, values per field out.

A selector has tags, ``#id``, ``.class``, ``[attr]``, ``[attr=v]``, ``[attr*=v]``,
``[attr^=v]``, ``[attr$=v]``, ``:first-child``, ``:nth-child(n)`` and
``:nth-of-type(n)``, joined by blanks (within) or ``>`` (directly within), and
alternatives joined by commas.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without an end tag, and those that end where a like one begins.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_LIKE = frozenset("li dt dd option tr td th p".split())
_STEP = re.compile(r"\s*([>,])\s*|(\s+)|([A-Za-z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^$]?)=['\"]?([^'\"\]]*)['\"]?)?\]|:(first-child|nth-child|nth-of-type)(?:\((\d+)\))?")


_REFERENCE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9A-Fa-f]+;)(?:([A-Za-z][A-Za-z0-9]*;)?)")
_SPARE = range(0xFDD0, 0xFDF0)  # noncharacters


class Tree(HTMLParser):
    """Elements in page order: tag, attributes, parent, places among siblings, and the range of text they hold.

    HTML reads some references without their semicolon (``&amp`` as ``&``); with
    ``closed`` only those that have it are read, and others stay as they are.
    """

    def __init__(self, html: str, closed: bool = False):
        super().__init__(convert_charrefs=True)
        self._mark = next((chr(c) for c in _SPARE if chr(c) not in html), "") if closed else ""
        if self._mark:
            html = _REFERENCE.sub(lambda m: m[0] if m[1] in html5 else self._mark + m[0][1:], html)
        self.tags, self.attrs, self.parents, self.nth, self.nth_of = ["#root"], [{}], [-1], [1], [1]
        self.text, self.first, self.last = [], [0], [0]
        self._path, self._open, self._kin = [0], Counter(), {0: Counter()}
        self.feed(html)
        self.close()
        while self._path:
            self.last[self._path.pop()] = len(self.text)

    def _pop(self, tag: str) -> None:
        while True:
            node = self._path.pop()
            self.last[node] = len(self.text)
            self._open[self.tags[node]] -= 1
            if self.tags[node] == tag:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_LIKE and self.tags[self._path[-1]] == tag:
            self._pop(tag)
        node, parent = len(self.tags), self._path[-1]
        kin = self._kin.setdefault(parent, Counter())
        kin[""] += 1
        kin[tag] += 1
        for column, value in ((self.tags, tag), (self.attrs, {k: self._plain(v or "") for k, v in attrs}), (self.parents, parent), (self.nth, kin[""]), (self.nth_of, kin[tag]), (self.first, len(self.text)), (self.last, len(self.text))):
            column.append(value)
        if tag not in VOID:
            self._path.append(node)
            self._open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self._open[tag] > 0:
            self._pop(tag)

    def handle_data(self, data: str) -> None:
        self.text.append(self._plain(data))

    def _plain(self, text: str) -> str:
        return text.replace(self._mark, "&") if self._mark else text

    def text_of(self, node: int) -> str:
        return "".join(self.text[self.first[node] : self.last[node]]).strip()

    def end(self, node: int) -> int:
        """The first element behind ``node`` and all within it."""
        k = node + 1
        while k < len(self.parents) and self.parents[k] >= node:
            k += 1
        return k


@lru_cache(256)
def compiled(selector: str) -> tuple[tuple[tuple[bool, tuple], ...], ...]:
    """Alternatives of steps; a step says whether it is directly within the one before, and its tests."""
    chains, steps, tests, direct, at = [], [], [], False, 0
    selector = selector.strip()
    while at < len(selector):
        m = _STEP.match(selector, at)
        if m is None:
            raise ValueError(f"unreadable selector: {selector!r}")
        at = m.end()
        joint, blank, tag, ident, cls, attr, how, value, place, n = m.groups()
        if joint or blank:
            if not tests:
                raise ValueError(f"unreadable selector: {selector!r}")
            steps.append((direct, tuple(tests)))
            tests, direct = [], joint == ">"
            if joint == ",":
                chains.append(tuple(steps))
                steps = []
        elif tag:
            tests.append(("tag", tag.lower(), "", ""))
        elif ident:
            tests.append(("attr", "id", "=", ident))
        elif cls:
            tests.append(("class", cls, "", ""))
        elif attr:
            tests.append(("attr", attr.lower(), how + "=" if value is not None else "", value or ""))
        else:
            tests.append((place, int(n or 1), "", ""))
    if not tests:
        raise ValueError(f"unreadable selector: {selector!r}")
    return (*chains, (*steps, (direct, tuple(tests))))


_TESTS = {"": lambda has, v: True, "=": str.__eq__, "*=": lambda has, v: v in has, "^=": str.startswith, "$=": str.endswith}


def _fits(tree: Tree, node: int, tests: tuple) -> bool:
    for kind, name, how, value in tests:
        attrs = tree.attrs[node]
        if kind == "tag":
            ok = name in ("*", tree.tags[node])
        elif kind == "class":
            ok = name in attrs.get("class", "").split()
        elif kind == "attr":
            ok = name in attrs and _TESTS[how](attrs[name], value)
        else:
            ok = (tree.nth_of if kind == "nth-of-type" else tree.nth)[node] == name
        if not ok:
            return False
    return True


def select(tree: Tree, selector: str, within: int = 0) -> list[int]:
    """Elements below ``within`` that fit, in page order; one pass over them per step."""
    first, last = within + 1, tree.end(within)
    found: set[int] = set()
    for steps in compiled(selector):
        above: list[bool] | None = None  # per element: it, or one it is in, fits the steps so far
        exact: list[bool] = []
        for direct, tests in steps:
            fit, deep = [], []
            for k in range(first, last):
                up = tree.parents[k] - first
                ok = (above is None or up >= 0 and (exact[up] if direct else above[up])) and _fits(tree, k, tests)
                fit.append(ok)
                deep.append(ok or up >= 0 and deep[up])
            above, exact = deep, fit
        found.update(first + k for k, ok in enumerate(exact) if ok)
    return sorted(found)


def _read(tree: Tree, selector: str, what: str) -> list[tuple[str, str]]:
    """Values of the elements that fit: their text, ``@attribute``, or with ``pairs:selector`` their parts' texts under a label."""
    found = []
    for node in select(tree, selector):
        if what.startswith("@"):
            if what[1:] in tree.attrs[node]:
                found.append(("", tree.attrs[node][what[1:]].strip()))
        elif what.startswith("pairs:"):
            labels = select(tree, what[6:], node)
            if labels:
                label = tree.text_of(labels[0]).lower()
                parts = (tree.text_of(k) for k in range(node + 1, tree.end(node)) if tree.parents[k] == node)
                parts = list(dict.fromkeys(p for p in parts if p and p.lower() != label))
                if parts:
                    found.append((label, " ".join(parts)))
        else:
            found.append(("", tree.text_of(node)))
    return found


def read_fields(pages: DataFrame, rules: list[tuple[str, str, str, str]], id_col: str = "page_id", site_col: str = "platform", html_col: str = "html", keep: tuple[str, ...] = (), closed: bool = False) -> DataFrame:
    """Each page's id, the columns of ``keep``, and ``fields``, for the rules of its site: per field the values of the first rule that finds an element.

    ``rules`` has ``site, field, selector, what`` in the order in which they are
    tried; ``fields`` maps a field to an array of ``label, value`` in page order. A
    null page has none. Pages are parsed once, whatever the number of rules.
    ``closed`` leaves references without a semicolon as they are.
    """
    by_site: dict[str, list[tuple[str, str, str]]] = {}
    for site, field, selector, what in rules:
        compiled(selector)
        by_site.setdefault(site, []).append((field, selector, what))
    held = (id_col, *keep)
    value = pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for site, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fields: dict[str, list] = {}
                if html and site in by_site:
                    tree = Tree(html, closed)
                    for field, selector, what in by_site[site]:
                        if field not in fields:
                            got = _read(tree, selector, what)
                            if got:
                                fields[field] = [{"label": a, "value": b} for a, b in got]
                made.append(list(fields.items()))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(made, pa.map_(pa.string(), value))], names=[*held, "fields"])

    given = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in held)
    return pages.select(F.col(site_col).alias("__site"), F.col(html_col).alias("__html"), *held).mapInArrow(read, f"{given}, fields map<string, array<struct<label: string, value: string>>>")
