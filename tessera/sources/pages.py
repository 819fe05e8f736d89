"""HTML pages and mail bodies to text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.batches import each_text

# Elements whose text is no text, and those that stand apart.
SILENT = ("script", "style", "head", "title", "noscript", "template")
APART = (
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul",
)
# The entities that the plain form knows.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


# What the plain form drops: elements that hold no text, then whatever opens like a tag, a comment or a declaration.
UNREAD = ("script", "style")
TAG = r"(?s)</?[A-Za-z!?][^>]*>"


def unread(element: str) -> str:
    """The pattern of an element with all that it holds."""
    return rf"(?is)<{element}(?:\s[^>]*)?>.*?</{element}\s*>"


def plain(html: Column) -> Column:
    """Text by built-in expressions: silent elements, tags and common entities gone, blanks collapsed."""
    text = html
    for pattern in (*map(unread, UNREAD), TAG):
        text = F.regexp_replace(text, pattern, " ")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>|<[!?][^>]*>", re.S)
_BLANKS = re.compile(r"[ \t\r\f\v\u00a0]+")


class _Lines:
    """The lines of a page as they grow; an empty one stands between blocks."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.open: list[str] = []

    def text(self, said: str) -> None:
        first, *more = said.split("\n")
        self.open.append(first)
        for line in more:
            self.end()
            self.open.append(line)

    def end(self) -> None:
        line = _BLANKS.sub(" ", "".join(self.open)).strip(" ")
        self.open = []
        if line or (self.done and self.done[-1]):
            self.done.append(line)

    def block(self) -> None:
        self.end()
        self.open = []
        if self.done and self.done[-1]:
            self.done.append("")

    def whole(self) -> str:
        self.end()
        return "\n".join(self.done).strip()


def page_text(html: str | None) -> str | None:
    """The text of a page, block elements apart by a blank line, cells by a bar.

    A page of which nothing is left gives its words with all markup cut out.
    """
    if html is None:
        return None
    lines, depth, at, every = _Lines(), 0, 0, []
    while at < len(html):
        tag = _MARKUP.search(html, at)
        said = unescape(html[at : tag.start() if tag else len(html)])
        every.append(said)
        if not depth:
            lines.text(said)
        if tag is None:
            break
        at = tag.end()
        name, closes = (tag["name"] or "").lower(), bool(tag["end"])
        if name in UNREAD and not closes:  # markup within is none
            after = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = after.end() if after else len(html)
            continue
        if name in SILENT:
            depth = max(0, depth + (-1 if closes else 1))
        elif name == "br":
            lines.end()
        elif name in APART:
            lines.block()
        elif closes and name in ("td", "th"):
            lines.text(" | ")
    return lines.whole() or " ".join(every).strip()


@F.pandas_udf(StringType())
def faithful(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """:func:`page_text` of every page."""
    return each_text(page_text)(columns)
