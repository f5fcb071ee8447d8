"""The change stream against the batch answer of every step."""

from datetime import datetime, timedelta

from millrace.streaming.changes import page_changes


def test_stream_of_changes_equals_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    # day by day, what a crawl sees of each page
    days = [
        {"a": "one", "b": "two", "c": None},
        {"a": "one", "b": "two new", "c": ""},
        {"a": "one", "b": "two new", "d": "four"},
        {"a": "one!", "d": "four"},
        {"a": "one!", "d": "four"},
        {"a": "one!", "d": "five"},
        {"a": "one!", "b": "two", "d": "five"},
    ]
    seen, expected, last = {}, [], {}
    for k, pages in enumerate(days):
        for url in [u for u in last if u not in pages and k - last[u] > 2]:
            expected.append((url, "gone", last.pop(url)))
            seen.pop(url)
        for url, text in pages.items():
            text = text or ""
            expected.append((url, "new" if url not in seen else "same" if seen[url] == text else "changed", k))
            seen[url], last[url] = text, k
    rows = lambda k: [(u, t, start + timedelta(days=k)) for u, t in days[k].items()] + [(None, "x", start + timedelta(days=k))]
    schema = "url string, text string, at timestamp"
    got = []

    def take(batch, _):
        got.extend((r.url, r.change, (r.seen_at - start).days) for r in batch.collect())

    for k in range(len(days)):  # the stream stops and starts again after every day, and goes on from its state
        spark.createDataFrame(rows(k), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        pages = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        changes = page_changes(pages, "at", gone_after="2 days")
        query = changes.writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(x for x in got if x[1] != "gone") == sorted(x for x in expected if x[1] != "gone")
    assert sorted(x for x in got if x[1] == "gone") == sorted(x for x in expected if x[1] == "gone")


def test_repeated_and_late_sights(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1, h)
    spark.createDataFrame([("a", "x", at(3)), ("a", "x", at(1)), ("a", "y", at(2))], "url string, text string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    pages = spark.readStream.schema("url string, text string, at timestamp").parquet(str(tmp_path / "in"))
    got = []
    changes = page_changes(pages, "at", delay="1 day")
    changes.writeStream.foreachBatch(lambda b, _: got.extend((r.change, r.seen_at.hour) for r in b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got, key=lambda x: x[1]) == [("new", 1), ("changed", 2), ("changed", 3)]
