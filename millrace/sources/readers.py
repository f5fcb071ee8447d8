"""Readers: source registry, files of documents, pages over a fetcher, and chunk files."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schema as S
from millrace.functions import urls
from millrace.operators.html import SECTION_TYPE
from millrace.operators.sections import line_sections
from millrace.session import ship_package

#: Names of the files that the plans write.
CHUNKS, READY, EVALUATION, INSPECTION = "chunks.jsonl", "chunks_ready.jsonl", "chunk_evaluation.json", "chunk_inspection.jsonl"
METADATA, INVALID = "metadata.jsonl", "chunk_invalid.jsonl"
METADATA_FIELDS = ("chunk_id", "title", "section", "source_url", "text")

#: Fixed value: seconds for a request.
TIMEOUT = 30
#: A fetched response: (status, content type, body), or None for a failure.
Fetcher = Callable[[str], "tuple[int, str | None, bytes] | None"]


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(name, url, publisher_type) of the YAML list ``sources``."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path).collect())  # a configuration file
    rows = [(s.get("name"), s.get("url"), s.get("publisher_type")) for s in yaml.safe_load(text)["sources"]]
    return spark.createDataFrame(rows, S.SOURCE)


def dispatch(registry: DataFrame, category_urls: tuple[str, ...] = ()) -> DataFrame:
    """``registry`` with ``strategy``: category for the stated urls, else site."""
    return registry.withColumn("strategy", F.when(F.col("url").isin(list(category_urls)), "category").otherwise("site"))


def http_get(url: str) -> tuple[int, str | None, bytes]:
    """A GET request within the time of a request."""
    from urllib.request import urlopen

    with urlopen(url, timeout=TIMEOUT) as response:
        return response.status, response.headers.get("content-type"), response.read()


def fetch_pages(frontier: DataFrame, fetcher: Fetcher) -> DataFrame:
    """(url, html) of the urls whose response is a page, after the other columns of ``frontier``; failures of any kind
    are left out. Each row is one request."""
    ship_package(frontier.sparkSession)
    others = [c for c in frontier.columns if c != "url"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch[[*others, "url"]].itertuples(index=False, name=None):
                try:
                    got = fetcher(row[-1])
                except Exception:  # a page that cannot be fetched is skipped
                    got = None
                if got and 200 <= got[0] < 300:
                    rows.append((*row, got[1], got[2].decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=[*others, "url", "content_type", "html"])

    kinds = "".join(f"{c} {t}, " for c, t in frontier.dtypes if c != "url")
    got = frontier.mapInPandas(run, f"{kinds}url string, content_type string, html string")
    return got.where(urls.is_html_type(F.col("content_type"))).select(*others, "url", "html")


def download_pdfs(links: DataFrame, fetcher: Fetcher) -> DataFrame:
    """(url, file_id, body) of the links that are PDF by type or name; a failed request fails the job."""
    ship_package(links.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                got = fetcher(url)
                if not got or not 200 <= got[0] < 300:
                    raise OSError(f"no response for {url}")
                rows.append((url, got[1], got[2]))
            yield pd.DataFrame(rows, columns=["url", "content_type", "body"])

    got = links.select("url").mapInPandas(run, "url string, content_type string, body binary")
    return got.where(urls.is_pdf(F.col("content_type"), F.col("url"))).select(
        "url", F.substring(F.md5(F.col("url").cast("binary")), 1, 12).alias("file_id"), "body"
    )


def render_pdfs(links: DataFrame, renderer: Callable[[str], "tuple[str, bytes] | None"]) -> DataFrame:
    """(url, title, pdf, file_id, body) of pages printed by ``renderer``, which gives (title, PDF) of a url.

    A browser is not part of this package. Files are named by the last part of the url's path.
    """
    ship_package(links.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(url, renderer(url)) for url in batch["url"]]
            rows = [(url, *made) for url, made in got if made]
            yield pd.DataFrame(rows, columns=["url", "title", "body"])

    name = urls.last_segment(F.col("url"))
    made = links.select("url").mapInPandas(run, "url string, title string, body binary")
    return made.select("url", "title", F.concat(name, F.lit(".pdf")).alias("pdf"), name.alias("file_id"), "body")


PdfReader = Callable[[bytes], "list[str]"]


def pypdf_pages(body: bytes) -> list[str]:
    """Text of each page, by the ``pypdf`` package where it is installed."""
    from io import BytesIO

    from pypdf import PdfReader as Library

    return [page.extract_text() or "" for page in Library(BytesIO(body)).pages]


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of an index, a JSON line for each vector, with its ``position`` in the file."""
    kind = T.StructType([f for f in S.CHUNK.fields if f.name in METADATA_FIELDS] + [T.StructField("position", T.LongType())])
    return spark.read.schema(kind).json(path)


def pdf_sections(files: DataFrame, reader: PdfReader) -> DataFrame:
    """(path, sections) of ``files(path, content)``: pages by the injected reader, sections by line windows."""
    ship_package(files.sparkSession)

    @F.pandas_udf("array<string>")
    def pages(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [p or "" for p in reader(bytes(b))])

    each = files.select("path", F.posexplode(pages("content")).alias("page", "text"))
    numbered = each.select("path", (F.col("page") + 1).alias("page_number"), "text")
    rows = line_sections(numbered, ["path"])
    entry = F.struct("section_index", "heading", "text", "page_number")
    ordered = F.transform(
        F.array_sort(F.collect_list(entry)), lambda s: F.struct(s["heading"], s["text"], s["page_number"], s["section_index"])
    )
    found = rows.groupBy("path").agg(ordered.cast(SECTION_TYPE).alias("sections"))
    return files.select("path").join(found, "path", "left")


def read_documents(spark: SparkSession, folder: str, pdf_reader: PdfReader | None = None) -> DataFrame:
    """Documents under a folder, with ``ord``: JSON documents by path first, then pages and PDF by path.

    JSON lists are metadata of PDF files, found by file name, a later entry before an earlier one; JSON objects count
    if they have text, html or sections. Other suffixes and the evaluation file are passed over.
    """

    def files(suffix: str) -> DataFrame:
        """(path, content, name) of the files with a suffix in any case; others are not even listed."""
        any_case = "*." + "".join(f"[{c}{c.upper()}]" for c in suffix)
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", any_case).load(folder)
        return found.select("path", "content", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))

    order = F.split("path", "/")  # paths are ordered by their parts
    value = F.decode("content", "UTF-8").alias("value")
    jsons = files("json").where(F.col("name") != EVALUATION).select("path", "name", value)
    is_list = F.ltrim("value").startswith("[")
    listed = jsons.where(is_list).select(
        "path", F.posexplode(F.from_json("value", T.ArrayType(S.PDF_METADATA))).alias("pos", "m")
    )
    named = listed.where(F.coalesce("m.pdf", F.lit("")) != "").select(
        F.regexp_extract("m.pdf", r"([^/]*)$", 1).alias("name"), "m", F.struct(F.split("path", "/"), "pos").alias("o")
    )
    meta = named.groupBy("name").agg(F.max_by("m", "o").alias("m"))
    documents = jsons.where(~is_list).select("path", F.from_json("value", S.INPUT_DOCUMENT).alias("d"))
    given = documents.where(
        (F.coalesce("d.text", F.lit("")) != "") | (F.coalesce("d.html", F.lit("")) != "") | (F.size("d.sections") > 0)
    ).select(F.struct(F.lit(0).alias("kind"), order.alias("path")).alias("ord"), "d.*")
    pages = files("html").select(
        F.struct(F.lit(1).alias("kind"), order.alias("path")).alias("ord"), "path",
        F.regexp_replace("name", r"\.[^.]*$", "").alias("title"), value.alias("html"),
    )
    out = given.unionByName(pages, allowMissingColumns=True)
    if pdf_reader is not None:
        pdfs = files("pdf")
        found = pdf_sections(pdfs, pdf_reader).join(pdfs.select("path", "name"), "path").join(meta, "name", "left")
        out = out.unionByName(
            found.select(
                F.struct(F.lit(1).alias("kind"), order.alias("path")).alias("ord"), "path",
                F.coalesce("m.url", "path").alias("url"),
                F.coalesce("m.title", F.regexp_replace("name", r"\.[^.]*$", "")).alias("title"), "sections",
            ),
            allowMissingColumns=True,
        )
    return out


def read_ready_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a file or folder named chunks_ready.jsonl, with ``position``; faults raise ValueError."""
    if posixpath.basename(path.rstrip("/")) != READY:
        raise ValueError(f"expected a file named {READY}")
    every = spark.read.text(path).select(
        "value", F.monotonically_increasing_id().alias("position"), F.col("_metadata.file_path").alias("file")
    )
    lines = every.where(F.trim("value") != "")
    kind = T.StructType([*S.CHUNK.fields, T.StructField("__bad", T.StringType())])
    rows = lines.select(
        "position", "file", F.from_json("value", kind, {"columnNameOfCorruptRecord": "__bad"}).alias("c"), "value"
    )
    bad = rows.where(
        F.col("c").isNull() | F.col("c.__bad").isNotNull() | ~F.ltrim("value").startswith("{")
        | (F.trim(F.coalesce("c.text", F.lit(""))) == "")
    ).agg(F.min(F.struct("file", "position")).alias("first")).first()["first"]
    if bad is not None:
        before = every.where((F.col("file") == bad["file"]) & (F.col("position") < bad["position"])).count()
        raise ValueError(f"{bad['file']}: line {before + 1} is no chunk with text")
    return rows.select("position", *[f"c.{f.name}" for f in S.CHUNK.fields])


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CASE).option("multiLine", True).json(path)
