"""URL functions as Spark columns; general reference resolution is the one that needs Python."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are not crawled.
SKIPPED_EXTENSIONS = ("7z", "csv", "doc", "docx", "jpg", "jpeg", "mp3", "mp4", "pdf", "png", "rar", "svg", "zip")


def netloc(url: Column) -> Column:
    """Host with port and user, as written."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def defragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def last_segment(url: Column) -> Column:
    return F.regexp_extract(F.rtrim(path(url), F.lit("/")), r"([^/]*)$", 1)


def is_crawlable(url: Column) -> Column:
    """No template marks, and no extension of a file that is not a page. The query string does not count."""
    return ~F.contains(url, F.lit("{{")) & ~path(url).rlike(rf"(?i)\.(?:{'|'.join(SKIPPED_EXTENSIONS)})$")


def is_html_type(content_type: Column) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit("text/html"))), F.lit("html"))


def is_pdf(content_type: Column, url: Column) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf")) | F.lower(path(url)).endswith(".pdf")


def resolve(base: Column, href: Column) -> Column:
    """``href`` against ``base``. Absolute and rooted references stay in the JVM."""

    @F.pandas_udf("string")
    def join(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        def one(b, h):
            try:
                return None if h is None else urljoin(b or "", h)
            except ValueError:  # brackets that are no address
                return None

        return pd.Series([one(b, h) for b, h in zip(bases, hrefs)], dtype=object)

    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    simple = href.rlike(r"^/(?!/)[^\s\[\]?#;]*$") & ~href.rlike(r"(?:^|/)\.{1,2}(?:/|$)") & (root != "")
    return F.when(simple, F.concat(root, href)).otherwise(join(base, href))
