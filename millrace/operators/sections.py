"""Sections: from lines of pages, by document shape, and merged where they are short."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as T
from millrace.operators.html import SECTION_TYPE, html_sections
from millrace.plans import computed
from millrace.session import ship_package


def none() -> Column:
    return F.array().cast(SECTION_TYPE)


def line_sections(pages: DataFrame, keys: list[str], text_col: str = "text", page_col: str = "page_number") -> DataFrame:
    """(keys, heading, text, page_number, section_index) from the text of numbered pages.

    Heading lines part sections and do not reach over pages; of several in a row the last one counts; sections
    without text after cleaning are dropped and not numbered. A page is cut where it is read, and only its sections are
    shuffled, once, to be numbered.
    """
    ship_package(pages.sparkSession)

    @F.pandas_udf("array<struct<heading:string,text:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [{"heading": h, "text": x} for h, x in _page_sections(t)])

    placed = pages.select(*keys, page_col, F.monotonically_increasing_id().alias("place"), cut(F.col(text_col)).alias("cut"))
    each = placed.select(*keys, page_col, "place", F.posexplode("cut").alias("part", "s"))
    order = Window.partitionBy(*keys).orderBy(page_col, "place", "part")
    return each.select(
        *keys, F.when(T.has_share_text(F.col("s.heading")), "").otherwise(F.col("s.heading")).alias("heading"), "s.text",
        F.col(page_col).cast("int").alias("page_number"), (F.row_number().over(order) - 1).alias("section_index"),
    )


def _page_sections(text: str) -> Iterator[tuple[str, str]]:
    """(heading, text) of the sections of a page, cleaned, without those that have no text."""
    heading, body = "", []
    for line in [*T.split_lines_py(text), None]:
        if line is not None and not T.is_heading_py(line):
            body.append(line)
            continue
        if body and (cleaned := T.clean_text_py("\n".join(body))):
            yield T.clean_text_py(heading), cleaned
        heading, body = line, []


def document_sections(docs: DataFrame) -> DataFrame:
    """``docs`` with ``sections`` by shape: of html if there is any, else its sections as they are, else its text.

    Adds ``is_clean``: whether the sections have been cleaned. Missing columns count as null.
    """
    ship_package(docs.sparkSession)
    have = set(docs.columns)
    col = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    html, given, text = col("html", "string"), col("sections", SECTION_TYPE), col("text", "string")
    prepared = docs.withColumn("__html", html)
    prepared = computed(prepared.withColumn("__text", T.nfkc(text)), __text=T.clean_text(F.col("__text"), normalize=False))
    from_html = html_sections(F.col("__html")) if "html" in have else none()
    one = F.array(
        F.struct(
            F.lit("").alias("heading"), F.col("__text").alias("text"), F.lit(None).cast("int").alias("page_number"),
            F.lit(0).alias("section_index"),
        )
    )
    has_html, has_sections = F.coalesce(F.col("__html") != "", F.lit(False)), F.coalesce(F.size(given) > 0, F.lit(False))
    chosen = (
        F.when(has_html, from_html).when(has_sections, given).when(F.col("__text") != "", one).otherwise(none())
    )
    out = prepared.withColumn("is_clean", has_html | ~has_sections).withColumn("sections", chosen)
    return out.drop("__text", "__html")


def merge_short_sections(sections: Column, min_words: int) -> Column:
    """Sections of fewer than ``min_words`` words joined with what follows, the last one with what precedes.

    A fold from left to right: a section is appended to the last group while that is short, its heading becoming a
    line of the text; heading, page and number are those of the group's first section.
    """
    counted = F.transform(
        F.filter(sections, lambda s: s.isNotNull()),
        lambda s: F.struct(
            F.coalesce(s["heading"], F.lit("")).alias("heading"), F.coalesce(s["text"], F.lit("")).alias("text"),
            s["page_number"].alias("page_number"), s["section_index"].alias("section_index"),
            T.word_count(F.coalesce(s["text"], F.lit(""))).alias("w"),
            T.word_count(F.coalesce(s["heading"], F.lit(""))).alias("hw"),
        ),
    )
    kind = "array<struct<heading:string,text:string,page_number:int,section_index:int,w:int,hw:int>>"

    def joined(a: Column, b: Column) -> Column:
        lines = F.filter(F.array(a["text"], b["heading"], b["text"]), lambda x: x != "")
        return F.struct(
            a["heading"].alias("heading"), F.array_join(lines, "\n").alias("text"), a["page_number"].alias("page_number"),
            a["section_index"].alias("section_index"), (a["w"] + b["hw"] + b["w"]).alias("w"), a["hw"].alias("hw"),
        )

    def butlast(groups: Column) -> Column:
        return F.slice(groups, F.lit(1), F.size(groups) - 1)

    def step(groups: Column, s: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        return F.when((F.size(groups) > 0) & (last["w"] < min_words), F.concat(butlast(groups), F.array(joined(last, s)))).otherwise(
            F.concat(groups, F.array(s))
        )

    def finish(groups: Column) -> Column:
        last, before = F.try_element_at(groups, F.lit(-1)), F.try_element_at(groups, F.lit(-2))
        short = (F.size(groups) > 1) & (last["w"] < min_words)
        head = F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 2, F.lit(0)))
        return F.when(short, F.concat(head, F.array(joined(before, last)))).otherwise(groups)

    merged = F.aggregate(counted, F.array().cast(kind), step, finish)
    return F.transform(merged, lambda s: F.struct(s["heading"], s["text"], s["page_number"], s["section_index"]))
