import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import coverage, crawl, search
from millrace.plans.fetch import fetch_sites


class Keyword:
    def encode(self, texts, **_):
        return np.array([[1, 0] if "first" in t.lower() else [0, 1] for t in texts], np.float32)


INDEX = "position long, chunk_id string, title string, section string, source_url string, text string, embedding array<float>"


def index(spark, rows=None):
    rows = rows or [(0, "first-id", "First", "S", "https://a.example", "first text", [1.0, 0.0]), (1, "second-id", "Second", "S", "https://b.example", "other", [0.0, 1.0])]
    return spark.createDataFrame(rows, INDEX)


def test_search_cites(spark):
    hits = search.search_chunks(index(spark), "first question", 1, Keyword()).collect()
    assert [(h.rank, h.chunk_id, h.score, h.citation.source_url) for h in hits] == [(1, "first-id", 1.0, "https://a.example")]
    lines = search.render_hits(search.search_chunks(index(spark, [(0, "c", None, "", None, "x", [1.0, 0.0])]), "first", 5, Keyword())).collect()
    assert lines[0].line == "1. Untitled | Unspecified section | score=1.0000 | No source URL"


def test_search_refuses(spark):
    for question, k, row in (("  ", 1, None), ("q", 0, None), ("q", 1, {"chunk_count": 3, "embedding_model": "m"}), ("q", 1, {"chunk_count": 2, "embedding_model": "x"})):
        with pytest.raises(ValueError):
            search.search_chunks(index(spark), question, k, Keyword(), "m", row)


def test_verify(spark):
    chunks = index(spark).drop("embedding")
    cases = spark.createDataFrame([("c", "first?", "x", ["https://a.example"], ["FIRST"])], "id string, query string, category string, relevant_source_urls array<string>, relevant_terms array<string>")
    report = search.verify_index(spark, chunks, index(spark), 2, cases, Keyword(), 1)
    assert report["passed"] and report["normalized_vectors"] and report["source_hit_rate"] == report["evidence_hit_rate"] == 1
    faults = [
        [(0, "a", "", "", "", "", [1.0, 0.0]), (1, "a", "", "", "", "", [0.0, 1.0])],
        [(0, "a", "", "", "", "", [float("nan"), 0.0]), (1, "b", "", "", "", "", [0.0, 1.0])],
        [(0, "a", "", "", "", "", [0.0, 0.0]), (1, "b", "", "", "", "", [0.0, 1.0])],
        [(0, "a", "", "", "", "", [1.0]), (1, "b", "", "", "", "", [0.0, 1.0])],
    ]
    for rows in faults:
        with pytest.raises(ValueError):
            search.verify_index(spark, index(spark, rows).drop("embedding"), index(spark, rows), 2)
    with pytest.raises(ValueError, match="order"):
        swapped = index(spark).drop("embedding").withColumn("position", 1 - F.col("position"))
        search.verify_index(spark, swapped, index(spark), 2)


def test_coverage(spark):
    cases = spark.createDataFrame([("1", ["u"], ["Ein Fuß"]), ("2", ["v"], ["x"]), ("3", ["u"], [])], "id string, relevant_source_urls array<string>, relevant_terms array<string>")
    chunks = spark.createDataFrame([("u", "EIN FUSS hier"), ("w", "x")], "source_url string, text string")
    rows = coverage.case_coverage(cases, chunks)
    got = {r.id: (r.source_chunk_count, r.evidence_chunk_count) for r in rows.collect()}
    assert got == {"1": (1, 1), "2": (0, 0), "3": (1, 1)}
    report = coverage.corpus_coverage(rows, 2).first()
    assert (report.case_count, report.chunk_count) == (3, 2) and abs(report.source_url_coverage - 2 / 3) < 1e-9
    none = coverage.corpus_coverage(rows.limit(0), 2).first()
    assert (none.case_count, none.source_url_coverage) == (0, 0.0)


def test_crawl_order_limits_and_failures(spark):
    u = "https://h.example/"
    edges = [(u + "0", 0, u + "b"), (u + "0", 1, u + "a"), (u + "b", 0, u + "c"), (u + "a", 0, u + "d.pdf"), (u + "a", 1, "https://o.example/x"), (u + "a", 2, u + "e")]
    df = spark.createDataFrame(edges, "src string, pos int, dst string")
    known = spark.createDataFrame([(u + x,) for x in ("0", "b", "c", "e")], "url string")  # a fails
    got = [r.url for r in crawl.crawl_table(df, known, u + "0#f").orderBy("rank").collect()]
    assert got == [u + "0", u + "b", u + "c"]
    everything = known.union(spark.createDataFrame([(u + "a",)], "url string"))
    assert [r.url for r in crawl.crawl_table(df, everything, u + "0", 4).orderBy("rank").collect()] == [u + "0", u + "b", u + "a", u + "c"]
    assert crawl.crawl_table(df, known, u + "{{x}}").count() == 0


def queue_crawl(links, good, start, limit):
    """Url by url, as a queue; (found, asked)."""
    from collections import deque
    from urllib.parse import urldefrag, urlparse

    pending, seen, found, asked = deque([start]), set(), [], []
    while pending and len(found) < limit:
        url = urldefrag(pending.popleft())[0]
        if url in seen or urlparse(url).netloc != urlparse(start).netloc or "{{" in url or urlparse(url).path.lower().endswith(".pdf"):
            continue
        seen.add(url)
        asked.append(url)
        if url in good:
            found.append(url)
            pending.extend(links.get(url, []))
    return found, asked


def test_crawls_ask_for_no_more_than_a_queue(spark, tmp_path):
    """Many sources at once, with failures, fragments, loops and hubs of 300 links; every request is written down."""
    rng = random.Random(5)
    links, good, starts = {}, set(), []
    for s in range(6):
        pages = [f"https://h{s}.example/{k}{'.pdf' if k % 17 == 16 else ''}" for k in range(400)]
        for page in pages:
            links[page] = [rng.choice(pages) + ("#x" if rng.random() < 0.2 else "") for _ in range(rng.randrange(6))] + rng.sample(["https://o.example/", pages[0], "/{{t}}"], 1)
        links[pages[0]] = pages[1:301] if s < 3 else pages[1:4]
        good |= {p for p in pages if rng.random() < (0.9 if s % 2 else 0.4)} | {pages[0]}
        starts.append((f"s{s}", pages[0] + "#top"))
    starts += [("down", "https://nowhere.example/"), ("bad", "https://h0.example/{{x}}")]

    def fetcher(url):
        with open(f"{tmp_path}/asked", "a") as out:
            out.write(url + "\n")
        if url not in good:
            raise OSError("down")
        return 200, "text/html", "".join(f"<a href='{u}'>x</a>" for u in links[url]).encode()

    frame = spark.createDataFrame(starts, "source string, url string")
    got = fetch_sites(frame, fetcher, 25).select("source", "url", "rank").collect()
    expected = {name: queue_crawl(links, good, url, 25) for name, url in starts}
    for name, (found, _) in expected.items():
        assert [r.url for r in sorted((r for r in got if r.source == name), key=lambda r: r.rank)] == found
    asked = open(f"{tmp_path}/asked").read().split()
    assert sorted(asked) == sorted(u for _, urls in expected.values() for u in urls)
    assert len([u for u in asked if u.startswith("https://h1.")]) < 40  # a hub of 300 links
