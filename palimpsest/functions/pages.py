"""What chat pages hold, by an element tree of the standard HTML parser: texts of whole elements, chosen by attribute, class or tag."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that never have content, and those whose content is no text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = ("script", "style", "template")


class Element:
    """A tag with its attributes; its texts are ``first`` to ``last`` of the page's, those of all elements in it included."""

    __slots__ = ("attributes", "first", "last", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], first: int):
        self.tag, self.attributes, self.first, self.last = tag, attributes, first, first

    def has_class(self, name: str) -> bool:
        return name in self.attributes.get("class", "").split()


class Page(HTMLParser):
    """Elements in the order of their begin tags, and the texts between tags. An end tag closes the last open element of its name
    with all that is open in it; without one it counts for nothing. What is never closed goes on to the end."""

    def __init__(self, html: str):
        super().__init__()
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self._open: list[Element] = []
        self._count: dict[str, int] = {}
        self._data: list[str] = []
        self.feed(html)
        self.close()
        self._close_above(0)

    def _text(self) -> None:
        """White space alone is one line end or one blank."""
        data, self._data = "".join(self._data), []
        if data:
            self.texts.append(data if data.strip() else "\n" if "\n" in data else " ")

    def _close_above(self, depth: int) -> None:
        self._text()
        for e in self._open[depth:]:
            e.last = len(self.texts)
            self._count[e.tag] -= 1
        del self._open[depth:]

    def handle_data(self, data: str) -> None:
        if not self._open or self._open[-1].tag not in _SILENT:
            self._data.append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._text()
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)}, len(self.texts))
        self.elements.append(e)
        if tag not in _VOID:
            self._open.append(e)
            self._count[tag] = self._count.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if self._count.get(tag):
            depth = len(self._open) - 1
            while self._open[depth].tag != tag:
                depth -= 1
            self._close_above(depth)

    def text(self, e: Element) -> str:
        """All text of an element, a line for each piece between tags."""
        return "\n".join(self.texts[e.first : e.last]).strip()

    def lines(self, e: Element) -> list[str]:
        """The pieces that aren't blank, without white space around them."""
        return [x for x in map(str.strip, self.texts[e.first : e.last]) if x]


def _messages(page: Page, provider: str) -> tuple[list[str], list[str]]:
    """(questions, answers) of a page, by what its provider's messages are marked with."""

    def side(e: Element) -> int | None:
        if provider == "chatgpt" and e.tag == "div":
            return {"user": 0, "assistant": 1}.get(e.attributes.get("data-message-author-role", ""))
        if provider == "gemini" and e.tag == "message-content":
            return {"user": 0, "model": 1}.get(e.attributes.get("role", ""))
        if provider == "gemini" and e.tag == "div":
            return 0 if e.has_class("user-query") else 1 if e.has_class("model-response") else None
        return None

    found: tuple[list[str], list[str]] = ([], [])
    for e in page.elements:
        if (i := side(e)) is not None:
            found[i].append(page.text(e))
    return found


def _paragraphs(page: Page, least: int, most: int) -> list[str]:
    found: dict[str, None] = {}
    for e in page.elements:
        if len(found) == most:
            break
        if e.tag in ("p", "div", "span") and sum(map(len, lines := page.lines(e))) >= least:
            found["\n".join(lines)] = None
    return list(found)


def page_messages(html: Column, provider: Column) -> Column:
    """(users, agents): the texts of all questions and of all answers of a page, in order; a null page has none."""

    @F.pandas_udf("users array<string>, agents array<string>")
    def messages(pages: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = [_messages(Page(h), p) if h and p in ("chatgpt", "gemini") else ([], []) for h, p in zip(pages, names, strict=True)]
        return pd.DataFrame(rows, columns=["users", "agents"])

    return messages(html, provider)


def page_paragraphs(html: Column, least: int = 51, most: int = 50) -> Column:
    """The texts of p, div and span elements of ``least`` characters, each with all that is in it, distinct, the first ``most``."""

    @F.pandas_udf("array<string>")
    def paragraphs(pages: pd.Series) -> pd.Series:
        return pd.Series([_paragraphs(Page(h), least, most) if h else [] for h in pages], dtype=object)

    return paragraphs(html)
