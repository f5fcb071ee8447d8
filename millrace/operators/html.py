"""Extraction from HTML with the nesting rules of a lenient parser.

An element stays open until its own end tag or that of an element around it; a paragraph does not close the one
before; end tags without an open element are passed over. The text of an element is a stretch of the page's strings,
so elements are kept as pairs of places, and no tree is built.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.functions.text import clean_text_py
from millrace.session import ship_package

# What is removed, what makes sections, and what has no content.
REMOVED = frozenset(("script", "style", "noscript", "nav", "footer", "header"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BODY = frozenset(("p", "li", "table"))
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem "
                 "meta nextid param source spacer track wbr".split())  # fmt: skip


class Page(HTMLParser):
    """Strings and elements of a page, in document order, outside removed elements."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.strings: list[str] = []
        self.all_strings: list[str] = []
        self.elements: list[list] = []  # [tag, first string, end]
        self.links: list[str] = []
        self.anchors: list[list] = []  # [href, first of all strings, end], removed elements included
        self.title: str | None = None
        self._open: list[tuple] = []  # (tag, element, anchor, title start, removed)
        self._removed = 0
        self._tags: dict[str, int] = {}
        self.feed(source)
        self.close()
        while self._open:
            self._pop()

    def handle_starttag(self, tag, attrs):
        removed = tag in REMOVED
        element = anchor = title_at = None
        if not self._removed and not removed and (tag in HEADINGS or tag in BODY):
            element = [tag, len(self.strings), None]
            self.elements.append(element)
        if tag == "a" and (href := dict(reversed(attrs)).get("href", "")) is not None and any(k == "href" for k, _ in attrs):
            anchor = [href, len(self.all_strings), None]
            self.anchors.append(anchor)
            if not self._removed:
                self.links.append(href)
        if tag == "title" and self.title is None:
            title_at = len(self.all_strings)
            self.title = ""
        self._open.append((tag, element, anchor, title_at, removed))
        self._tags[tag] = self._tags.get(tag, 0) + 1
        self._removed += removed
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self._tags.get(tag, 0):
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        self.all_strings.append(data)
        if not self._removed:
            self.strings.append(data)

    def _pop(self) -> str:
        tag, element, anchor, title_at, removed = self._open.pop()
        self._tags[tag] -= 1
        self._removed -= removed
        if element:
            element[2] = len(self.strings)
        if anchor:
            anchor[2] = len(self.all_strings)
        if title_at is not None:
            self.title = joined(self.all_strings[title_at:])
        return tag

    def raw_sections(self) -> list[tuple[str, str]]:
        """(heading, text) of the body text below each heading; a heading without any is lost."""
        found, heading, lines = [], "", []
        for tag, begin, end in self.elements:
            text = joined(self.strings[begin:end])
            if tag in HEADINGS:
                if lines:
                    found.append((heading, "\n".join(lines)))
                    lines = []
                heading = text
            elif text:
                lines.append(text)
        if lines:
            found.append((heading, "\n".join(lines)))
        return found

    def text(self) -> str:
        return "\n".join(x for x in (line.strip() for line in "\n".join(self.strings).splitlines()) if x)

    def anchor_texts(self) -> list[tuple[str, str]]:
        return [(href, joined(self.all_strings[begin:end])) for href, begin, end in self.anchors]


def joined(strings: list[str]) -> str:
    return " ".join(x for x in (s.strip() for s in strings) if x)


def make_section(text: str, heading: str = "", index: int = 0, page: int | None = None) -> dict | None:
    """A cleaned section; none if nothing is left of the text. A heading with share text or links is blanked."""
    cleaned, head = clean_text_py(text), clean_text_py(heading)
    if not cleaned:
        return None
    if any(x in head.lower() for x in ("whatsapp", "http://", "https://")):
        head = ""
    return {"heading": head, "text": cleaned, "page_number": page, "section_index": index}


def html_sections_py(source: str) -> list[dict]:
    page, out = Page(source), []
    for heading, text in page.raw_sections():
        section = make_section(text, heading, len(out))
        if section:
            out.append(section)
    if not out and (section := make_section("\n".join(page.strings))):
        out.append(section)
    return out


SECTION_TYPE = "array<struct<heading:string,text:string,page_number:int,section_index:int>>"


def html_sections(html: Column) -> Column:
    """Cleaned sections of a page; the whole text is one section where nothing else is found."""

    @F.pandas_udf(SECTION_TYPE)
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: [] if not p else html_sections_py(p))

    return extract(html)


def fetched_documents(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, title, text, sections, links) of each page, after its other columns; sections are not cleaned, links are
    resolved."""
    ship_package(pages.sparkSession)

    @F.pandas_udf(f"title string, text string, sections {SECTION_TYPE}, hrefs array<string>")
    def extract(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            page = Page(value or "")
            sections = [
                {"heading": h, "text": t, "page_number": None, "section_index": k}
                for k, (h, t) in enumerate(page.raw_sections())
            ]
            rows.append((page.title or "", page.text(), sections, page.links))
        return pd.DataFrame(rows, columns=["title", "text", "sections", "hrefs"])

    others = [c for c in pages.columns if c not in (url_col, html_col, "url", "title", "text", "sections", "links", "d")]
    found = pages.select(*others, F.col(url_col).alias("url"), extract(F.col(html_col)).alias("d")).withColumn(
        "row", F.monotonically_increasing_id()
    )
    return found.select(*others, "url", "d.title", "d.text", "d.sections", _resolve_all(F.col("url"), F.col("d.hrefs")).alias("links"))


def _resolve_all(base: Column, hrefs: Column) -> Column:
    from urllib.parse import urljoin

    @F.pandas_udf("array<string>")
    def join(bases: pd.Series, lists: pd.Series) -> pd.Series:
        def one(b, h):
            try:
                return urljoin(b or "", h)
            except ValueError:
                return h

        return pd.Series([[one(b, h) for h in hs] for b, hs in zip(bases, lists)], dtype=object)

    return join(base, hrefs)


def page_anchors(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, pos, href, anchor_text) of every anchor with a target, page chrome included."""
    ship_package(pages.sparkSession)

    @F.pandas_udf("array<struct<href:string,anchor_text:string>>")
    def extract(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [{"href": h, "anchor_text": t} for h, t in Page(v or "").anchor_texts()])

    each = pages.select(F.col(url_col).alias("url"), F.posexplode(extract(F.col(html_col))).alias("pos", "a"))
    return each.select("url", "pos", "a.href", "a.anchor_text")


def category_links(pages: DataFrame, prefix: str = "/central/", word: str = "agriculture") -> DataFrame:
    """(url, link) of the different links of a category page: same host, path under ``prefix``, text with ``word``."""
    links = page_anchors(pages).withColumn("link", urls.resolve(F.col("url"), F.col("href")))
    return links.where(
        (urls.netloc(F.col("link")) == urls.netloc(F.col("url")))
        & urls.path(F.col("link")).startswith(prefix)
        & F.contains(F.lower("anchor_text"), F.lit(word.lower()))
    ).select("url", "link").distinct()
