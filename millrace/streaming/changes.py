"""Change detection as a stream: the last content hash of every page is keyed state, and timers mark pages that are gone.

Pages arrive as crawls see them. A page whose content is not that of its last sight is new or changed, and is passed on
to be chunked and embedded; one with the same content is the same, and costs nothing more. A page that no crawl has seen
for a time is gone: a timer of its key says so, and its state is dropped, so state is bounded by the pages that there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.plans.reindex import CHANGED, GONE, NEW, SAME
from millrace.session import ship_package

#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOUND = "url string, change string, content_hash string, seen_at timestamp"


class LastSeen(StatefulProcessor):
    """State of a url: the hash and the time of its last sight in milliseconds."""

    def __init__(self, gone_after_ms: int):
        self.gone_after_ms = gone_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "content_hash string, seen_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sights = pd.concat(list(rows)).sort_values(["seen_ms", "content_hash"], kind="stable")
        known = self.last.get() if self.last.exists() else None
        out = []
        for content, ms in zip(sights["content_hash"], sights["seen_ms"]):
            if known is not None and ms < known[1]:
                continue  # a late sight of what has been seen since
            change = NEW if known is None else SAME if known[0] == content else CHANGED
            known = (content, int(ms))
            out.append((key[0], change, content, pd.Timestamp(ms, unit="ms")))
        if out:
            self.last.update(known)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(known[1] + self.gone_after_ms)
        yield pd.DataFrame(out, columns=["url", "change", "content_hash", "seen_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        content, ms = self.last.get()
        self.last.clear()
        yield pd.DataFrame([(key[0], GONE, content, pd.Timestamp(ms, unit="ms"))], columns=["url", "change", "content_hash", "seen_at"])

    def close(self) -> None:
        pass


def page_changes(pages: DataFrame, time_col: str, gone_after: str = "7 days", delay: str = "0 seconds", text_col: str = "text") -> DataFrame:
    """(url, change, content_hash, seen_at) of a stream of sights ``pages(url, text, time)``.

    Every sight is new, changed or same against the one before, in the order of their times; sights that come after a
    later one of their page are passed over. A page is gone, once, when the watermark (``delay`` behind the latest time)
    is ``gone_after`` beyond its last sight; if it comes back, it is new. Null urls are left out, null texts are empty.
    """
    spark = ship_package(pages.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    length = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {gone_after}) AS ms").first()["ms"]
    sights = pages.where("url IS NOT NULL").select(
        "url", F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256).alias("content_hash"), F.col(time_col).alias("seen"),
        F.unix_millis(F.col(time_col).cast("timestamp")).alias("seen_ms"),
    ).withWatermark("seen", delay)
    return sights.groupBy("url").transformWithStateInPandas(
        LastSeen(length), outputStructType=FOUND, outputMode="append", timeMode="eventTime"
    )
