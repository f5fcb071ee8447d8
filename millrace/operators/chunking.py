"""Chunks: units of text packed into overlapping stretches within limits of words and tokens."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import ChunkingConfig, WordTokens, count_tokens
from millrace.functions import text as T
from millrace.operators.sections import document_sections, merge_short_sections
from millrace.plans import computed
from millrace.session import ship_package

TOO_SMALL = "max_tokens is too small for the section heading and one word"


def split_units(text: str, limit: int) -> tuple[list[str], list[int]]:
    """Lines of lists, and sentences of other lines, with their numbers of words; units over the limit become their words."""
    units, widths = [], []
    for line in T.split_lines_py(text):
        for unit in [line] if T.LIST_ITEM.match(line) else T.sentences_py(line):
            words = unit.split()
            if len(words) <= limit:
                units.append(unit)
                widths.append(len(words))
            else:
                units += words
                widths += [1] * len(words)
    return units, widths


def pack_widths(widths: np.ndarray, room: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """[begin, end) of greedy chunks over units of ``widths`` words: at most ``size`` and ``room`` words each.

    The next chunk begins with as many whole units of the last as fit in ``overlap`` words, but after its first.
    """
    sums = np.concatenate(([0], np.cumsum(widths))).tolist()
    spans, begin, n = [], 0, len(widths)
    while begin < n:
        end = bisect_right(sums, sums[begin] + min(size, room)) - 1
        if end <= begin:
            raise ValueError(TOO_SMALL)
        spans.append((begin, end))
        if end == n:
            break
        back = end
        while back > begin + 1 and sums[end] - sums[back - 1] <= overlap:
            back -= 1
        begin = back
    return spans


def pack_units(units: list[str], prefix: str, config: ChunkingConfig) -> list[tuple[int, int]]:
    """``pack_widths`` for tokenizers whose counts do not follow from words: each candidate is counted."""
    widths = [len(u.split()) for u in units]
    spans, begin = [], 0
    while begin < len(units):
        end, held = begin, 0
        while end < len(units) and held + widths[end] <= config.chunk_size:
            candidate = T.clean_text_py(prefix + " ".join(units[begin : end + 1]))
            if count_tokens(config.tokens, candidate) > config.max_tokens:
                break
            held += widths[end]
            end += 1
        if end == begin:
            raise ValueError(TOO_SMALL)
        spans.append((begin, end))
        if end == len(units):
            break
        back, kept = end, 0
        while back > begin + 1 and kept + widths[back - 1] <= config.chunk_overlap:
            kept += widths[back - 1]
            back -= 1
        begin = back
    return spans


def fitting_units(text: str, prefix: str, config: ChunkingConfig) -> list[str]:
    """Units of which none is over the token limit: those whose text alone is become their words."""

    def fits(unit: str) -> bool:
        return count_tokens(config.tokens, T.clean_text_py(prefix + unit)) <= config.max_tokens

    return [w for u in split_units(text, config.chunk_size)[0] for w in ([u] if fits(u) else u.split())]


def packed(sections: Column, config: ChunkingConfig) -> Column:
    """The texts of the chunks of each section, without its heading."""
    t = config.tokens

    def of_section(heading: str, text: str) -> list[str]:
        if isinstance(t, WordTokens):
            room = (config.max_tokens - t.special) // t.per_word - len(heading.split())
            units, widths = split_units(text, min(config.chunk_size, room))
            spans = pack_widths(np.asarray(widths, np.int64), room, config.chunk_size, config.chunk_overlap)
        else:
            prefix = heading + "\n" if heading else ""
            units = fitting_units(text, prefix, config)
            spans = pack_units(units, prefix, config)
        return [" ".join(units[begin:end]) for begin, end in spans]

    @F.pandas_udf("array<array<string>>")
    def pack(headings: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[of_section(h, t) for h, t in zip(hs, ts)] for hs, ts in zip(headings, texts)], dtype=object)

    return pack(F.transform(sections, lambda s: s["heading"]), F.transform(sections, lambda s: s["text"]))


def token_count(text: Column, tokens) -> Column:
    if isinstance(tokens, WordTokens):
        return T.word_count(text) * tokens.per_word + tokens.special

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count_tokens(tokens, t))

    return count(text)


def chunk_documents(docs: DataFrame, config: ChunkingConfig = ChunkingConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of documents of any shape, with ``keys`` of the documents in front.

    A document's chunks are built in one array and exploded once, so their numbers need no shuffle. With WordTokens the
    token limit counts the words of the heading and of the units.
    """
    ship_package(docs.sparkSession)
    have = set(docs.columns)
    urls = [F.col(c) for c in ("url", "source_url", "path") if c in have]
    ready = document_sections(docs).select(
        *keys, F.coalesce(*urls, F.lit("")).alias("source_url"),
        F.coalesce(F.col("title") if "title" in have else F.lit(None), F.lit("")).alias("title"), "is_clean",
        "sections",
    )
    ready = computed(ready, sections=merge_short_sections(F.col("sections"), config.min_words))
    ready = ready.withColumn("packed", packed(F.col("sections"), config))
    built = F.flatten(
        F.transform(
            F.arrays_zip("sections", "packed"),
            lambda p: F.transform(
                p["packed"],
                lambda x: F.struct(
                    p["sections"]["heading"].alias("section"), p["sections"]["section_index"].alias("section_index"),
                    p["sections"]["page_number"].alias("page_number"), x.alias("packed"),
                ),
            ),
        )
    )
    each = ready.select(*keys, "source_url", "title", "is_clean", F.posexplode(built).alias("chunk_index", "c"))
    raw = F.concat(F.when(F.col("c.section") != "", F.concat("c.section", F.lit("\n"))).otherwise(""), F.col("c.packed"))
    if "sections" in have:  # given sections are not cleaned before; other text is in normal form already
        each = computed(each, raw=raw)
        each = each.withColumn("raw", F.when(F.col("is_clean"), F.col("raw")).otherwise(T.nfkc(F.col("raw"))))
    else:
        each = each.withColumn("raw", raw)
    each = computed(each, text=T.clean_text(F.col("raw"), normalize=False))
    each = computed(each, word_count=T.word_count(F.col("text")))
    tokens = config.tokens
    words_told = isinstance(tokens, WordTokens)
    n_tokens = F.col("word_count") * tokens.per_word + tokens.special if words_told else token_count(F.col("text"), tokens)
    return each.select(
        *keys, T.chunk_id(F.col("source_url"), F.col("chunk_index")).alias("chunk_id"), "source_url", "title",
        F.col("c.section").alias("section"), T.is_faq(F.col("c.section")).alias("is_faq"),
        F.coalesce("c.section_index", F.lit(0)).alias("section_index"), F.col("c.page_number").alias("page_number"),
        "chunk_index", "text", "word_count", n_tokens.alias("token_count"), T.content_hash(F.col("text")).alias("content_hash"),
    )
