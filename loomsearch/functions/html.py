"""Extraction of titles, texts, links and captions from HTML with the standard library's parser.

Null or empty HTML gives empty results. Unclosed paragraphs end where the next block begins; scripts, styles and
comments are no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

_BLOCKS = frozenset("address article aside blockquote body div dl figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
_RUNS = re.compile(r"""[(\s+)\t"']+""")
_QUOTED = re.compile(r"""["']+""")
NO_LINK = "#NOLINK#"


def cleaned(text: str) -> str:
    """Runs of white space, quotes, parentheses and plus signs as one space."""
    return _RUNS.sub(" ", text).strip()


class _Page(HTMLParser):
    """Collects what the extraction needs in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.headline: str | None = None
        self.paragraphs: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.captions: list[str] = []
        self.entries: list[dict[str, str]] = []
        self._open: dict[str, list[str]] = {}
        self._skip = 0
        self._link: list[str] | None = None
        self._href = NO_LINK
        self._linked = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style", "noscript"):
            self._skip += 1
        if tag in _BLOCKS and "p" in self._open:
            self._close("p")
        if tag == "p":
            self._linked = False
            self._open["p"] = []
        elif tag == "h1" and self.headline is None and "h1" not in self._open:
            self._open["h1"] = []
        elif tag == "figcaption":
            self._open["figcaption"] = []
        elif tag == "article":
            self.entries.append({})
        elif tag == "time" and self.entries and "lastmod" not in self.entries[-1]:
            self.entries[-1]["lastmod"] = dict(attrs).get("datetime") or ""
        elif tag == "a":
            href = dict(attrs).get("href")
            if "p" in self._open and not self._linked:
                self._link, self._href, self._linked = [], href or NO_LINK, True
            if self.entries and href and "loc" not in self.entries[-1]:
                self.entries[-1]["loc"] = href

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript"):
            self._skip = max(0, self._skip - 1)
        elif tag == "a" and self._link is not None:
            self.links.append((cleaned("".join(self._link)), self._href))
            self._link = None
        elif tag in self._open:
            self._close(tag)
        elif tag in _BLOCKS and "p" in self._open:
            self._close("p")

    def _close(self, tag: str) -> None:
        text = "".join(self._open.pop(tag))
        if tag == "p":
            self.paragraphs.append(text)
        elif tag == "h1":
            self.headline = text
        else:
            self.captions.append(_QUOTED.sub("", text).strip())

    def handle_data(self, data: str) -> None:
        if self._skip:
            return
        for parts in self._open.values():
            parts.append(data)
        if self._link is not None:
            self._link.append(data)

    def finish(self) -> _Page:
        self.close()
        for tag in list(self._open):
            self._close(tag)
        return self


def parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    return page.finish()


def extracted(html: str | None) -> dict:
    """title, content (None up to three paragraphs), hypertext and figcaption of a page; a text linked twice keeps its last link."""
    page = parsed(html)
    content = cleaned(" ".join(page.paragraphs)) if len(page.paragraphs) > 3 else None
    return {"title": cleaned(page.headline or ""), "content": content, "hypertext": dict(page.links), "figcaption": {str(i): c for i, c in enumerate(page.captions)}}


def listed(html: str | None) -> list[dict[str, str]]:
    """loc and lastmod of each article of a listing page; articles without a link are left out."""
    return [{"loc": e["loc"], "lastmod": e.get("lastmod", "")} for e in parsed(html).entries if "loc" in e]


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every row of ``pages`` with title, content, hypertext and figcaption; columns of those names are replaced."""
    new = ("title", "content", "hypertext", "figcaption")
    rows = pages.drop(*new)
    keep = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([extracted(x) for x in frame[html]], columns=list(new))
            yield pd.concat([frame.reset_index(drop=True), out], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "title string", "content string", "hypertext map<string,string>", "figcaption map<string,string>"])
    return rows.select(*keep).mapInPandas(run, schema)


def extract_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(loc, lastmod): the articles of listing pages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([e for x in frame[html] for e in listed(x)], columns=["loc", "lastmod"])

    return pages.select(html).mapInPandas(run, "loc string, lastmod string")
