"""From a registry of sources to stored documents: each source is crawled, or the links of its category are fetched."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.functions import urls
from millrace.operators import crawl
from millrace.operators.html import category_links, fetched_documents
from millrace.plans import kept
from millrace.sources import readers as R
from millrace.sources import writers as W

log = logging.getLogger("millrace")


def fetch_categories(starts: DataFrame, fetcher: R.Fetcher, prefix: str = "/central/", word: str = "agriculture") -> DataFrame:
    """Documents, by ``source``, of the links that the category page of each of ``starts(source, url)`` lists."""
    pages = kept(R.fetch_pages(starts.select("source", "url").repartition("source"), fetcher))
    links = category_links(pages, prefix, word).join(pages.select("source", "url"), "url").select("source", F.col("link").alias("url"))
    return fetched_documents(R.fetch_pages(links.distinct().repartition("source"), fetcher))


def fetch_sites(starts: DataFrame, fetcher: R.Fetcher, max_pages: int = crawl.MAX_PAGES) -> DataFrame:
    """Documents, by ``source``, of at most ``max_pages`` pages of the site of each of ``starts(source, url)``, breadth first.

    All sites are crawled at once, the pages of a site that a round asks for by one task, one after the other. No page
    is asked for beyond those that are needed, and none twice.
    """
    documents: list[DataFrame] = []

    def fetch(asked: DataFrame) -> DataFrame:
        documents.append(kept(fetched_documents(R.fetch_pages(asked.repartition("source"), fetcher))))
        return documents[-1]

    visited = crawl.crawl_sources(starts, fetch, max_pages)
    every = reduce(DataFrame.unionByName, documents, starts.sparkSession.createDataFrame([], f"source string, {FETCHED}"))
    return every.join(visited, ["source", "url"])


FETCHED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.FETCHED.fields)


def fetch_sources(
    spark: SparkSession, registry: DataFrame, fetcher: R.Fetcher, folder: str, category_urls: tuple[str, ...] = ()
) -> dict[str, dict[str, int]]:
    """Fetch every source of a registry; documents, and the PDF that category pages link, go under ``folder``.

    All sites are one crawl, and all category pages another job. A source whose pages cannot be fetched has none.
    """
    sources = kept(R.dispatch(registry, category_urls).withColumnRenamed("name", "source"))
    category = kept(fetch_categories(sources.where("strategy = 'category'"), fetcher))
    sites = kept(fetch_sites(sources.where("strategy = 'site'"), fetcher))
    links = category.select("source", F.explode("links").alias("url")).where(F.lower(urls.path(F.col("url"))).endswith(".pdf")).distinct()
    pdfs = kept(R.download_pdfs(links.select("url").distinct(), fetcher))
    W.write_pdfs(pdfs, f"{folder}/pdfs")
    of_source = lambda df: df.groupBy("source").agg(F.count("*").alias("n"))
    found = of_source(category.select("source").unionByName(sites.select("source"))).withColumnRenamed("n", "documents")
    files = of_source(links.join(pdfs.select("url"), "url")).withColumnRenamed("n", "pdfs")
    told = sources.join(found, "source", "left").join(files, "source", "left").fillna(0, ["documents", "pdfs"])
    counts = {r["source"]: {"documents": r["documents"], "pdfs": r["pdfs"]} for r in told.collect()}  # a registry's sources
    for name, found_ in counts.items():
        log.info("%s | %s", name, found_)
    W.write_fetched(category.unionByName(sites.drop("rank")).drop("source"), f"{folder}/documents")
    return counts
