"""Bounded breadth-first crawls of any number of sources at once, over a table of links or an injected fetcher.

The frontier is one table keyed by source: every url that is waiting or was visited, with its place in the queue of its
source and, where a page was found, its rank. A round asks for the first urls of every queue, as many as the source still
lacks pages, and links found go to the end of the queue. Since no page of a round can make those that wait before it
unneeded, a crawl asks for exactly the pages that one that takes the queue url by url asks for, in that order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import urls
from millrace.plans import kept

#: Fixed value: pages of a source.
MAX_PAGES = 25

PENDING, VISITED = "pending", "visited"


def _queue(rows: DataFrame) -> DataFrame:
    """One row for each (source, url): that of the visit if there was one, else the first place in the queue."""
    waits = F.col("state") == PENDING
    first = F.min_by(F.struct("host", "state", "place", "rank"), F.struct(waits, "place"))
    return rows.groupBy("source", "url").agg(first.alias("r")).select("source", "url", "r.*")


def _allowed(url: Column, host: Column) -> Column:
    return (urls.netloc(url) == host) & urls.is_crawlable(url)


def crawl_sources(
    starts: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_pages: int = MAX_PAGES
) -> DataFrame:
    """(source, url, rank) in the order of visits, of at most ``max_pages`` pages of each source of ``starts(source, url)``.

    ``fetch`` gives (source, url, links) of those of (source, url) that can be fetched. Only pages of the start's host
    that can be crawled are visited, each once for a source; pages that fail count as visited, not as found. A source
    is a name that starts have once; the pages of a source that wait are links of at most ``max_pages`` pages.
    """
    place = F.struct(F.lit(0).cast("long").alias("rank"), F.lit(0).alias("pos"))
    frontier = starts.select("source", urls.defragment(F.col("url")).alias("url")).withColumn("host", urls.netloc(F.col("url")))
    frontier = frontier.where(_allowed(F.col("url"), F.col("host"))).select(
        "source", "url", "host", F.lit(PENDING).alias("state"), place.alias("place"), F.lit(None).cast("long").alias("rank")
    )
    while True:
        frontier = kept(frontier)
        have = frontier.groupBy("source").agg(F.count("rank").alias("n_found"))
        turn = F.row_number().over(Window.partitionBy("source").orderBy("place", "url"))
        waiting = frontier.where(F.col("state") == PENDING).join(have, "source").where(F.col("n_found") < max_pages)
        asked = kept(waiting.withColumn("turn", turn).where(F.col("turn") <= F.lit(max_pages) - F.col("n_found")))
        if asked.isEmpty():
            return frontier.where(F.col("rank").isNotNull()).select("source", "url", "rank")
        got = kept(fetch(asked.select("source", "url")).select("source", "url", "links"))
        nth = F.row_number().over(Window.partitionBy("source").orderBy("place", "url"))
        ranked = asked.join(got.select("source", "url"), ["source", "url"], "left_semi").withColumn("rank", F.col("n_found") + nth)
        done = asked.drop("rank").join(ranked.select("source", "url", "rank"), ["source", "url"], "left")
        links = got.join(ranked.select("source", "url", "host", "rank"), ["source", "url"]).select(
            "source", "host", "rank", F.posexplode("links").alias("pos", "link")
        )
        fresh = links.withColumn("url", urls.defragment(F.col("link"))).where(_allowed(F.col("url"), F.col("host")))
        columns = ["source", "url", "host", "state", "place", "rank"]
        frontier = _queue(
            frontier.select(columns)
            .unionByName(done.withColumn("state", F.lit(VISITED)).select(columns))
            .unionByName(fresh.select(
                "source", "url", "host", F.lit(PENDING).alias("state"), F.struct(F.col("rank").cast("long").alias("rank"), "pos").alias("place"),
                F.lit(None).cast("long").alias("rank"),
            ))
        )


def crawl_table(edges: DataFrame, known: DataFrame, start: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """(url, rank) of the crawl over ``edges(src, pos, dst)`` from ``start`` where the pages of ``known(url)`` can be fetched."""
    starts = edges.sparkSession.createDataFrame([("start", start)], "source string, url string")
    return crawl_tables(edges, known, starts, max_pages).drop("source")


def crawl_tables(edges: DataFrame, known: DataFrame, starts: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """(source, url, rank) of the crawls over one table of links from each of ``starts(source, url)``."""

    def fetch(asked: DataFrame) -> DataFrame:
        can = asked.join(known.select("url").distinct(), "url", "left_semi")
        linked = edges.join(can.withColumnRenamed("url", "src"), "src").groupBy("source", F.col("src").alias("url")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("l")
        )
        return can.join(linked, ["source", "url"], "left").select("source", "url", F.col("l.dst").alias("links"))

    return crawl_sources(starts, fetch, max_pages)
