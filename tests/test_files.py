import json

import pytest
from pyspark.sql import functions as F

from millrace.config import ChunkingConfig
from millrace.operators.html import category_links, fetched_documents
from millrace.plans import fetch, process
from millrace.sources import readers, writers
from millrace.streaming import chunks as stream


def test_folder_to_index_and_search(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    words = " ".join(f"word{i}" for i in range(25))
    (folder / "one.json").write_text(json.dumps({"url": "https://a.example", "title": "A", "text": words}))
    (folder / "meta.json").write_text(json.dumps([{"url": "https://p.example", "title": "P", "pdf": "x/doc.pdf"}, {"url": "https://q.example", "title": "Q", "pdf": "doc.pdf"}]))
    (folder / "empty.json").write_text("{}")
    (folder / "sub" / "page.html").write_text("<h1>How?</h1><p>Short answer.</p>")
    (folder / "sub" / "doc.pdf").write_bytes(b"TITLE LINE\nbody of the file")
    (folder / "chunk_evaluation.json").write_text("{}")
    out = str(tmp_path / "out")
    report = process.process_documents(spark, str(folder), out, ChunkingConfig(25, 5, 8), pdf_reader=lambda b: [b.decode()])
    assert report["total_chunks"] == 3 and report["passed"] is False and report["invalid_chunk_ids"]
    rows = spark.read.json(f"{out}/chunks.jsonl").collect()
    assert [r.source_url for r in rows][0] == "https://a.example" and {r.source_url for r in rows} >= {"https://q.example"}
    manifest = process.build_index(spark, f"{out}/chunks_ready.jsonl", out)
    assert manifest["chunk_count"] == report["ready_chunks"] == 2
    index, row = process.load_index(spark, out)
    assert index.count() == row["chunk_count"] and row["dimension"] == 64


def test_fetch_sources(spark, tmp_path):
    site = {"https://b.example/": "<a href='/one'>1</a><a href='/two#x'>2</a><a href='https://z.example/'>z</a><p>start</p>", "https://b.example/one": "<a href='/'>up</a><p>one</p>", "https://c.example/list": "<a href='/central/s'>Agriculture s</a>", "https://c.example/central/s": "<p>scheme</p><a href='/d.pdf'>pdf</a>"}

    def fetcher(url):
        if url.endswith(".pdf"):
            return 200, "application/pdf", b"%PDF"
        return (200, "text/html", site[url].encode()) if url in site else None

    registry = spark.createDataFrame([("b", "https://b.example/", "x"), ("c", "https://c.example/list", "x")], "name string, url string, publisher_type string")
    counts = fetch.fetch_sources(spark, registry, fetcher, str(tmp_path), ("https://c.example/list",))
    assert counts == {"b": {"documents": 2, "pdfs": 0}, "c": {"documents": 1, "pdfs": 1}}
    assert {r.url for r in spark.read.parquet(str(tmp_path / "documents")).collect()} == {"https://b.example/", "https://b.example/one", "https://c.example/central/s"}
    assert [p.read_bytes() for p in (tmp_path / "pdfs").glob("*.pdf")] == [b"%PDF"]
    made = readers.render_pdfs(registry, lambda u: ("T", b"x") if "list" in u else None).collect()
    assert [(r.title, r.pdf) for r in made] == [("T", "list.pdf")]


def test_last_of_equal_documents_is_written(spark, tmp_path):
    rows = [("u", str(k)) for k in range(5)]
    writers.write_fetched(spark.createDataFrame(rows, "url string, text string").coalesce(1), str(tmp_path / "d"))
    assert [r.text for r in spark.read.parquet(str(tmp_path / "d")).collect()] == ["4"]


def test_ready_chunks_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="chunks_ready.jsonl"):
        readers.read_ready_chunks(spark, str(tmp_path / "chunks.jsonl"))
    for line in ('{"chunk_id": "a", "text": " "}', "[1]", "{broken"):
        (tmp_path / "chunks_ready.jsonl").write_text('{"chunk_id": "a", "text": "x"}\n\n' + line + "\n")
        with pytest.raises(ValueError, match="line 3 "):
            readers.read_ready_chunks(spark, str(tmp_path / "chunks_ready.jsonl"))


def test_registry_and_fetch(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("sources:\n  - {name: a, url: 'https://a.example/c', publisher_type: x}\n  - {name: b, url: 'https://b.example/'}\n")
    registry = readers.dispatch(readers.read_registry(spark, str(tmp_path / "s.yaml")), ("https://a.example/c",))
    assert {r.name: r.strategy for r in registry.collect()} == {"a": "category", "b": "site"}

    def fetcher(url):
        if "b." in url:
            raise OSError("down")
        return 200, "text/html; charset=utf-8", b"<title>Test</title><nav><a href='/m'>Menu</a></nav><p>Useful text</p><script>ignore</script>"

    doc = fetched_documents(readers.fetch_pages(registry, fetcher)).collect()
    assert len(doc) == 1 and doc[0].title == "Test" and "Useful text" in doc[0].text
    assert "Menu" not in doc[0].text and "ignore" not in doc[0].text and doc[0].links == [] and doc[0].sections[0].text == "Useful text"
    pdfs = readers.download_pdfs(registry.where("name = 'a'"), lambda u: (200, "application/pdf", b"x")).collect()
    assert len(pdfs) == 1 and len(pdfs[0].file_id) == 12


def test_category_links(spark):
    page = '<a href="/central/b">Agriculture b</a><nav><a href="/central/a">An AGRICULTURE a</a></nav><a href="/central/c">Other</a><a href="https://o.example/central/d">agriculture</a>'
    df = spark.createDataFrame([("https://h.example/x", page)], "url string, html string")
    assert sorted(r.link for r in category_links(df).collect()) == ["https://h.example/central/a", "https://h.example/central/b"]


def test_files_are_whole_or_not_there(spark, tmp_path):
    pdfs = spark.createDataFrame([("a", b"%PDF a", "https://a/1", "One é", "a.pdf"), ("b", b"%PDF b", "https://a/2", None, "b.pdf")], "file_id string, body binary, url string, title string, pdf string")
    for _ in range(2):  # as a task that is repeated does
        writers.write_pdfs(pdfs, str(tmp_path / "out"))
        writers.write_pdf_metadata(pdfs.coalesce(1), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["a.pdf", "b.pdf", "metadata-00000.json"]
    broken = pdfs.withColumn("body", F.when(F.col("file_id") == "a", F.col("body"))).withColumn("file_id", F.concat("file_id", F.lit("2")))
    with pytest.raises(Exception):
        writers.write_pdfs(broken.coalesce(1), str(tmp_path / "broken"))
    assert [p.name for p in (tmp_path / "broken").iterdir()] == ["a2.pdf"]
    docs = readers.read_documents(spark, str(tmp_path / "out"), pdf_reader=lambda b: [b.decode()]).collect()
    assert sorted((d.url, d.title) for d in docs) == [("https://a/1", "One é"), ("https://a/2", "b")]


def test_metadata_of_an_index(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "u", "t", "s", 0, None, 0, "text"), ("c2", "u", "t", "s", 1, 2, 1, "more")], "chunk_id string, source_url string, title string, section string, section_index int, page_number int, chunk_index int, text string")
    writers.write_jsonl(chunks.withColumn("position", F.monotonically_increasing_id()).coalesce(1), str(tmp_path / "chunks_metadata.jsonl"))
    got = readers.read_metadata(spark, str(tmp_path / "chunks_metadata.jsonl"))
    assert [r.chunk_id for r in got.orderBy("position").collect()] == ["c1", "c2"]


def test_suffixes_in_any_case(spark, tmp_path):
    (tmp_path / "A.HTML").write_text("<p>one</p>")
    (tmp_path / "b.Json").write_text('{"text": "two"}')
    (tmp_path / "c.htm").write_text("<p>no</p>")
    assert [(d.title, d.text) for d in readers.read_documents(spark, str(tmp_path)).orderBy("ord").collect()] == [(None, "two"), ("A", None)]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("u", "word " * 30)], "url string, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("url string, text string").parquet(str(tmp_path / "in"))
    stream.write_chunks(stream.chunk_stream(docs, ChunkingConfig(20, 5, 5)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select(F.count("*")).first()[0] == 2
