"""Web pages in one walk: their elements as a table in document order, and their visible text: hidden subtrees, scripts and comments left out, a line break after each block, the main part where it is marked."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tidy

# Tags that never show, tags with a line break after them, tags without an end, and inline styles that hide.
UNSEEN = ("script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "head")
BLOCKS = (
    "address", "article", "aside", "blockquote", "br", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?!\s*\.\d*[1-9])|font-size\s*:\s*0(?:px|em|rem)?)\s*(?:;|$)", re.I)
OFFSCREEN = re.compile(r"(?:left|top|right|bottom|text-indent)\s*:\s*-\s*(?:\d{4,}|[1-9]\d{2,})\s*(?:px|em|rem|%)", re.I)
#: A page with scripts and less text than this is a shell that its scripts fill.
SHELL_CHARS = 400
SCHEMA = "whole string, main string, hidden int, markup int, comments int, scripts int"
#: Elements in document order: `last` is the last element inside (or the element itself), `prev` the one before it under the same parent (-1: none).
ELEMENTS = "array<struct<id: int, parent: int, prev: int, last: int, tag: string, attrs: map<string, string>>>"
#: Pieces of text in document order, each with the innermost element around it (-1: none).
TEXTS = "array<struct<under: int, text: string>>"
WALK = f"struct<{SCHEMA.replace(' string', ': string').replace(' int', ': int')}, elements: {ELEMENTS}, texts: {TEXTS}>"


def is_hidden(attrs: dict[str, str | None]) -> bool:
    style = attrs.get("style") or ""
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(HIDING.search(style) or OFFSCREEN.search(style))


def may_be_main(tag: str, attrs: dict[str, str | None]) -> bool:
    return tag in ("main", "article") or attrs.get("role") == "main" or attrs.get("id") in ("content", "main") or "content" in (attrs.get("class") or "").split()


class _Page(HTMLParser):
    """One walk over a page.  Each open element knows where its texts began, so a part of the page is a slice of them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []  # tag, shuts, candidate, first visible piece, characters before, element
        self.open_tags: dict[str, int] = {}  # how many elements of a tag are open
        self.seen: list[str] = []
        self.chars = self.shut = self.hidden = self.markup = self.comments = self.scripts = 0
        self.elements: list[dict] = []
        self.texts: list[dict] = []
        self.ended = False
        self.newest = [-1]  # of each open element, and of the page, the newest child
        self.best: tuple[int, int, int] | None = None  # characters, slice of `seen`

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li", "td", "tr", "option") and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)
        known = {k: v or "" for k, v in reversed(attrs)}  # of repeated attributes the first counts
        element = len(self.elements)
        self.elements.append({"id": element, "parent": self.open[-1][5] if self.open else -1, "prev": self.newest[-1], "last": element, "tag": tag, "attrs": list(known.items())})
        self.newest[-1] = element
        shuts = False
        self.scripts += tag == "script"
        if not self.shut:
            if tag in UNSEEN:
                self.markup += 1
                shuts = True
            elif is_hidden(known):
                self.hidden += 1
                shuts = True
        if tag in VOID:
            if tag in BLOCKS and not self.shut and not shuts:
                self.seen.append("\n")
            return
        self.shut += shuts
        self.open.append((tag, shuts, may_be_main(tag, known), len(self.seen), self.chars, element))
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        self.newest.append(-1)

    def handle_endtag(self, tag: str) -> None:
        # What follows the end of the body still belongs to it.
        if not self.open_tags.get(tag) or tag in ("body", "html") and not self.ended:
            return
        while True:
            name, shuts, candidate, first, before, element = self.open.pop()
            self.open_tags[name] -= 1
            self.newest.pop()
            self.elements[element]["last"] = len(self.elements) - 1
            self.shut -= shuts
            if candidate and self.chars - before > (self.best[0] if self.best else 0):
                self.best = self.chars - before, first, len(self.seen)
            if name in BLOCKS and not self.shut and not shuts:
                self.seen.append("\n")
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        # What stands in the head is not of the body.
        self.chars += 0 if self.open_tags.get("head") or self.open_tags.get("title") else len(data)
        self.texts.append({"under": self.open[-1][5] if self.open else -1, "text": data})
        if not self.shut:
            self.seen.append(data)

    def handle_comment(self, data: str) -> None:
        self.comments += not self.shut

    def result(self, html: str) -> tuple:
        self.feed(html)
        self.close()
        self.ended = True
        while self.open:
            self.handle_endtag(self.open[-1][0])
        whole = "".join(self.seen)
        # Only a part that holds most of the page stands for it.
        main = "".join(self.seen[self.best[1] : self.best[2]]) if self.best and self.best[0] > 0.4 * self.chars else whole
        return whole, main, self.hidden, self.markup, self.comments, self.scripts


NAMES = ("whole", "main", "hidden", "markup", "comments", "scripts")


def walk(html: Column) -> Column:
    """struct of what `read` gives, and elements and texts of a page; a null page has none."""
    kind = lambda **of: pa.list_(pa.struct(list(of.items())))
    number, string = pa.int32(), pa.string()
    elements = kind(id=number, parent=number, prev=number, last=number, tag=string, attrs=pa.map_(string, string))
    whole = pa.struct([*((n, string if n in ("whole", "main") else number) for n in NAMES), ("elements", elements), ("texts", kind(under=number, text=string))])

    def walked(html: str) -> dict:
        page = _Page()
        return dict(zip(NAMES, page.result(html))) | {"elements": page.elements, "texts": page.texts}

    def of(pages: pa.Array) -> pa.Array:
        return pa.array([walked(x.as_py() or "") for x in pages], whole)

    return F.arrow_udf(of, WALK)(html)


def read(html: Column) -> Column:
    """struct whole, main, hidden, markup, comments, scripts of a page; a null page is empty.  Styles outside the element itself are not known here."""

    def of(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in pages:
            yield pd.DataFrame([_Page().result(x or "") for x in s], columns=NAMES)

    return F.pandas_udf(of, SCHEMA)(html)


def visible_text(page: Column) -> Column:
    """The whole visible text of what `read` gives, its white space tidied."""
    return tidy(page["whole"])


def main_text(page: Column) -> Column:
    return tidy(page["main"])


def is_shell(page: Column) -> Column:
    return (page["scripts"] > 0) & (F.length(main_text(page)) < SHELL_CHARS)
