"""The registered queries of the core library, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import index_queries, oracles, registry  # noqa: F401  the first registers queries of its own
from millrace.config import ChunkingConfig, TokenizerFile
from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.functions import vectors as V
from millrace.operators import coverage, crawl, html, quality, search, sections
from millrace.operators.chunking import chunk_documents, token_count
from millrace.operators.windows import word_windows
from millrace.plans import computed, kept, spread
from millrace.registry import QUERIES, query, table  # noqa: F401  the first is read by others

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def input_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of the chunking plan, one url for each."""
    url = F.concat(F.lit("https://"), F.col("source"), F.lit("/"), F.col("doc_id"))
    return documents(spark, sf_dir).select("doc_id", url.alias("url"), F.col("source").alias("title"), "text")


# --- text ---


@query
def doc_clean_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("clean_text"))


@query
def doc_line_dedup_stats(spark, sf_dir):
    lines = F.split("text", "\n")
    return documents(spark, sf_dir).select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.array_distinct(lines)).cast("long").alias("n_distinct")
    )


@query
def doc_word_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query
def doc_content_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query
def page_file_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.file_id(F.col("url")).alias("file_id"))


@query
def doc_sentences(spark, sf_dir):
    lines = computed(documents(spark, sf_dir).withColumn("n", T.nfkc(F.col("text"))), lines=T.clean_lines(F.col("n")))
    each = lines.select("doc_id", F.posexplode("lines").alias("line_no", "line"))
    units = F.when(T.is_list_item(F.col("line")), F.array("line")).otherwise(T.sentences(F.col("line")))
    return each.select("doc_id", "line_no", F.posexplode(units).alias("unit_no", "unit"))


@query
def boilerplate_rules(spark, sf_dir):
    """All documents with a line of page chrome after each of their lines, by id, and what cleaning leaves of them."""
    chrome = F.element_at(F.array(*[F.lit(x) for x in oracles.BOILERPLATE_LINES]), (F.col("doc_id") % len(oracles.BOILERPLATE_LINES) + 1).cast("int"))
    docs = documents(spark, sf_dir).withColumn("chrome", chrome)
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(x, F.lit("\n"), F.col("chrome"))), "\n")
    return docs.select("doc_id", T.clean_text(text).alias("clean_text"))


@query
def doc_token_count(spark, sf_dir):
    """Tokens of all documents by a tokenizer's file, with its special ones."""
    import public_tokenizers

    tokens = TokenizerFile(public_tokenizers.path("word_bpe_49k.json"))
    return documents(spark, sf_dir).select("doc_id", token_count(F.col("text"), tokens).cast("long").alias("n_tokens"))


def _conversation_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query
def heading_predicate(spark, sf_dir):
    line = T.trim_ws(F.col("line"))
    return _conversation_lines(spark, sf_dir).select("conv_id", "turn", "role", "line_no", T.is_heading(line).alias("is_heading"))


@query
def faq_predicate(spark, sf_dir):
    return _conversation_lines(spark, sf_dir).select("conv_id", "turn", "role", "line_no", T.is_faq(F.col("line")).alias("is_faq"))


@query
def clean_conversations(spark, sf_dir):
    c = spread(table(spark, sf_dir, "conversations"))
    return c.select("conv_id", "turn", "role", T.clean_text(F.col("text")).alias("clean_text"))


@query
def casefold_terms(spark, sf_dir):
    terms = F.array(*[F.lit(t.casefold()) for t in ("STRASSE", "The")])
    folded = computed(documents(spark, sf_dir).select("doc_id", "text"), folded=T.fold(F.col("text")))
    return folded.select("doc_id", T.contains_all(F.col("folded"), terms).alias("has_all"))


# --- sections and chunks ---


@query
def line_sections(spark, sf_dir):
    pages = documents(spark, sf_dir).select("doc_id", F.lit(1).alias("page_number"), "text")
    return sections.line_sections(pages, ["doc_id"])


@query
def merge_short_sections(spark, sf_dir):
    lines = F.transform(
        F.filter(F.split("text", "\n"), lambda x: x != ""),
        lambda x, i: F.struct(
            F.lit("").alias("heading"), x.alias("text"), F.lit(None).cast("int").alias("page_number"), i.alias("section_index")
        ),
    )
    merged = sections.merge_short_sections(lines, 40)
    each = documents(spark, sf_dir).select("doc_id", F.posexplode(merged).alias("group_no", "s"))
    return each.select("doc_id", "group_no", F.col("s.section_index").alias("first_line"), F.col("s.text").alias("text"))


@query
def word_window_chunks(spark, sf_dir):
    return word_windows(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"], size=50, overlap=10)


CONFIG = ChunkingConfig()


def _chunks(spark, sf_dir):
    return chunk_documents(input_documents(spark, sf_dir), CONFIG, keys=("doc_id",))


@query
def doc_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select(
        "doc_id", "chunk_id", "chunk_index", "section_index", "is_faq", "text", "word_count", "token_count", "content_hash"
    )


@query
def ready_chunks(spark, sf_dir):
    # used three times, without the texts: whether one is empty is all that the checks need of it
    narrow = _chunks(spark, sf_dir).select(
        "doc_id", "chunk_id", "source_url", "title", "chunk_index", "is_faq", "word_count", "token_count", "content_hash",
        F.substring("text", 1, 1).alias("text"),
    )
    chunks = kept(narrow)
    return quality.ready_chunks(chunks, quality.chunk_issues(chunks, CONFIG)).select(
        "doc_id", "chunk_id", "chunk_index", "word_count", "content_hash"
    )


@query
def page_chunks(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages")).select("page_id", "url", "html")
    return chunk_documents(pages, CONFIG, keys=("page_id",)).drop("page_number")  # web pages have none


@query
def faq_chunk_issues(spark, sf_dir):
    """Short sections under question and other headings, through chunking and the checks."""
    heading = F.concat(F.when(F.col("doc_id") % 2 == 0, "Who may apply under rule ").otherwise("Benefits of rule "), "doc_id")
    heading = F.concat(heading, F.when(F.col("doc_id") % 3 == 0, "?").otherwise(""))
    first = F.array_join(F.slice(T.words(F.col("text")), 1, 12), " ")
    section = F.struct(
        heading.alias("heading"), first.alias("text"), F.lit(None).cast("int").alias("page_number"), F.lit(0).alias("section_index")
    )
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("https://faq.example/"), "doc_id").alias("url"), F.col("source").alias("title"),
        F.array(section).alias("sections"),
    )
    issues = quality.chunk_issues(chunk_documents(docs, CONFIG, keys=("doc_id",)), CONFIG)
    return issues.select("doc_id", "section", "is_faq", "word_count", F.array_join("issues", ",").alias("issues"), "short_faq")


@query
def chunk_id_format(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.chunk_id(F.col("source"), (F.col("doc_id") * 37).cast("int")).alias("chunk_id")
    )


# --- quality ---


def _document_chunks(spark, sf_dir):
    """Documents taken as chunks."""
    return documents(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.col("source").alias("source_url"),
        F.col("source").alias("title"), F.lit(0).alias("chunk_index"), "text",
    )


@query
def duplicate_chunks(spark, sf_dir):
    hashed = _document_chunks(spark, sf_dir).withColumn("content_hash", T.content_hash(F.col("text")))
    return quality.flag_duplicates(hashed.select("doc_id", "content_hash")).select("doc_id", "is_duplicate")


@query
def chunk_issues(spark, sf_dir):
    issues = quality.chunk_issues(_document_chunks(spark, sf_dir), CONFIG)
    return issues.select(F.col("issue_id").alias("chunk_id"), F.array_join("issues", ",").alias("issues"))


@query
def issue_counts(spark, sf_dir):
    return quality.issue_counts(quality.chunk_issues(_document_chunks(spark, sf_dir), CONFIG))


@query
def quality_report(spark, sf_dir):
    report = quality.quality_report(quality.chunk_issues(_document_chunks(spark, sf_dir), CONFIG), CONFIG)
    counts = F.array_join(F.transform(F.map_entries("issue_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return report.select(
        "total_chunks", "valid_chunks", "invalid_chunks", counts.alias("issue_counts"), "min_words", "max_tokens", "short_faq_policy",
        "embedding_model", "passed",
    )


@query
def ready_documents(spark, sf_dir):
    chunks = _document_chunks(spark, sf_dir)
    return quality.ready_chunks(chunks, quality.chunk_issues(chunks, CONFIG)).select("doc_id", "chunk_id")


@query
def inspection_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return quality.inspection_sample(docs, ["doc_id"])


# --- pages and links ---


@query
def page_title(spark, sf_dir):
    return html.fetched_documents(spread(table(spark, sf_dir, "pages"))).select("url", "title")


@query
def page_text(spark, sf_dir):
    return html.fetched_documents(spread(table(spark, sf_dir, "pages"))).select("url", "text", F.size("sections").alias("n_sections"))


@query
def page_sections(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages"))
    each = pages.select("page_id", F.explode(html.html_sections(F.col("html"))).alias("s"))
    return each.select("page_id", "s.section_index", "s.heading", "s.text")


@query
def url_netloc(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", U.netloc(F.col("url")).alias("netloc"), U.defragment(F.col("url")).alias("defragmented")
    )


@query
def crawlable_urls(spark, sf_dir):
    links = html.page_anchors(spread(table(spark, sf_dir, "pages")))
    return links.select("url", "pos", U.is_crawlable(U.resolve(F.col("url"), F.col("href"))).alias("crawlable"))


@query
def page_links_raw(spark, sf_dir):
    links = html.page_anchors(spread(table(spark, sf_dir, "pages")))
    return links.select("url", "pos", "anchor_text", U.resolve(F.col("url"), F.col("href")).alias("link"))


@query
def category_links(spark, sf_dir):
    return html.category_links(spread(table(spark, sf_dir, "pages")), prefix="/t", word="th")


@query
def crawl_bfs(spark, sf_dir):
    """Pages as a tree of links under one host, the later child first, crawled to the limit of pages of a source.

    Every seventh page cannot be fetched, every fifth is a file that is not crawled, and all link back to the start.
    """
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("n"))
    url = lambda n: F.concat(F.lit("https://site.example/"), n, F.when(n % 5 == 4, ".pdf").otherwise(""))
    children = F.array(F.col("n") * 2 + 2, F.lit(0).cast("long"), F.col("n") * 2 + 1)
    edges = pages.select(url(F.col("n")).alias("src"), F.posexplode(children).alias("pos", "m")).select(
        "src", "pos", url(F.col("m")).alias("dst")
    )
    known = pages.where("n % 7 <> 6").select(url(F.col("n")).alias("url"))
    return crawl.crawl_table(edges, known, "https://site.example/0#top")


# --- vectors ---


@query
def vector_norms(spark, sf_dir):
    e = spread(table(spark, sf_dir, "embeddings"))
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query
def vector_normalize(spark, sf_dir):
    e = spread(table(spark, sf_dir, "embeddings"))
    unit = computed(e.select("vec_id", "embedding"), unit=V.normalize(F.transform("embedding", lambda x: x * 3)))
    return unit.select(
        "vec_id", F.round(V.norm(F.col("unit")), 6).alias("norm"), F.round(F.col("unit")[0], 6).alias("first"),
        F.round(F.element_at("unit", -1), 6).alias("last"),
    )


@query
def verify_vectors(spark, sf_dir):
    return search.verify_vectors(table(spark, sf_dir, "embeddings"), id_col="vec_id")


def _neighbours(spark, sf_dir, k=5):
    """The best vectors of each query vector, itself left out; queries are the ids divisible by 50."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))
    best = search.nearest(q.select("query_id", "embedding"), e.select("vec_id", "embedding"), "query_id", "vec_id", k, same=False)
    return best.join(q.select("query_id", "query_label"), "query_id").join(e.select("vec_id", "label"), "vec_id")


@query
def vector_topk(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query
def search_hits_citation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "lang")
    return _neighbours(spark, sf_dir).join(docs, "vec_id", "left").select(
        "query_id", "rank", "vec_id", F.coalesce("source", F.lit("No source URL")).alias("source_url"),
        F.format_string("%d. %s | score=%.4f", "rank", F.coalesce("lang", F.lit("Untitled")), "score").alias("line"),
    )


@query
def label_hit_rate(spark, sf_dir):
    per = _neighbours(spark, sf_dir).groupBy("query_id").agg(
        F.bool_or(F.col("label") == F.col("query_label")).alias("hit"), F.max("score").alias("top")
    )
    return per.agg(
        F.count("*").alias("queries"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"),
        F.round(F.avg("top"), 6).alias("mean_top_score"),
    )


@query
def positional_alignment(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    meta = e.select(F.col("vec_id").alias("position"), F.when(F.col("label") == 3, -1).otherwise(F.col("vec_id")).alias("key"))
    return search.align(e.select(F.col("vec_id").alias("position"), F.col("vec_id").alias("key")), meta, "key")


@query
def index_search(spark, sf_dir):
    """Documents embedded with the hashing encoder and searched for a question."""
    docs = documents(spark, sf_dir).select(
        F.col("doc_id").alias("position"), F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.col("source").alias("source_url"),
        F.col("source").alias("title"), F.lit("").alias("section"), "text",
    )
    hits = search.search_chunks(search.embed_chunks(docs), "the thing and the other of it", 5)
    return hits.select("rank", "chunk_id", F.round("score", 5).alias("score"), F.col("citation.source_url").alias("cited"))


class AlternatingEncoder:
    """Any text as the same vector of unit length, its components of alternating sign; so SQL can make it too."""

    def encode(self, texts, **_):
        import numpy as np

        return np.tile(np.array([1, -1] * 32, np.float32) / 8, (len(texts), 1))


def _cited_vectors(spark, sf_dir):
    """Vectors as an index of chunks, those of some documents with nothing to cite."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(
        F.col("doc_id").alias("position"), F.col("lang").alias("title"), F.col("source").alias("source_url"), "text"
    )
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("position"), "embedding")
    section = F.when(F.col("position") % 2 == 0, "").otherwise(F.concat(F.lit("part "), "position"))
    return vectors.join(docs, "position", "left").select(
        "*", F.concat(F.lit("v"), "position").alias("chunk_id"), section.alias("section")
    )


@query
def search_citations(spark, sf_dir):
    hits = search.search_chunks(_cited_vectors(spark, sf_dir), "a question", 20, AlternatingEncoder())
    return hits.select("rank", F.round("score", 6).alias("score"), "citation.title", "citation.source_url", "citation.section", "citation.chunk_id")


@query
def rendered_hits(spark, sf_dir):
    return search.render_hits(search.search_chunks(_cited_vectors(spark, sf_dir), "a question", 20, AlternatingEncoder()))


@query
def case_hit_rate(spark, sf_dir):
    """Cases whose query vectors are those of the ids divisible by 50, against all vectors with their documents."""
    index = _cited_vectors(spark, sf_dir)
    word = lambda n: F.get(F.split("text", " "), F.lit(n))
    cases = index.where("position % 50 = 0").select(
        F.col("position").cast("string").alias("id"), "embedding",
        F.array(F.concat(F.lit("src"), F.col("position") % 20), F.coalesce("source_url", F.lit("none"))).alias("relevant_source_urls"),
        F.array_compact(F.array(F.upper(word(0)), word(1))).alias("relevant_terms"),
    )
    return search.case_hits(cases, index, 5).withColumn("top_score", F.round("top_score", 6))


@query
def index_manifest(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return search.manifest(e, "data/chunks_ready.jsonl", "hashing", "chunks_index")


# --- coverage and joins ---


def _cases(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    parts = F.split(F.trim("text"), " ")
    return b.select(
        F.col("item_id").cast("string").alias("id"),
        F.array(F.concat(F.lit("src"), F.col("item_id") % 20), F.concat(F.lit("src"), (F.col("item_id") + 7) % 20)).alias("relevant_source_urls"),
        F.array(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("relevant_terms"),
    )


def _case_rows(spark, sf_dir):
    chunks = documents(spark, sf_dir).select(F.col("source").alias("source_url"), "text")
    return coverage.case_coverage(_cases(spark, sf_dir), chunks)


@query
def evidence_cases(spark, sf_dir):
    return _case_rows(spark, sf_dir)


@query
def corpus_coverage(spark, sf_dir):
    total = table(spark, sf_dir, "documents").agg(F.count("*").alias("chunk_total"))
    report = coverage.corpus_coverage(_case_rows(spark, sf_dir).crossJoin(total), F.col("chunk_total"))
    return report.select(*[F.round(c, 6).alias(c) if c[:3] in ("sou", "evi", "ave") else F.col(c) for c in report.columns])


@query
def metadata_lookup_join(spark, sf_dir):
    # a list of metadata is a lookup by name, in which a later entry counts
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.struct("quality", "toxic")).alias("m"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "source", F.coalesce("m.quality", F.lit(-1)).alias("quality"), F.coalesce("m.toxic", F.lit(-1)).alias("toxic")
    )


@query
def source_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit(0).alias("kind"), F.col("doc_id").alias("id"), F.length("text").alias("n"))
    p = table(spark, sf_dir, "pages").select(F.lit(1).alias("kind"), F.col("page_id").alias("id"), F.length("html").alias("n"))
    c = table(spark, sf_dir, "conversations").select(F.lit(2).alias("kind"), F.col("conv_id").alias("id"), F.length("text").alias("n"))
    return d.unionByName(p).unionByName(c)


# --- plain relational use, which has no counterpart in the document plans ---


@query
def tpch_join_agg(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    exact = lambda c: F.col(c).cast("decimal(12,2)")  # noqa: E731  sums of doubles depend on the order of rows
    revenue = F.sum(exact("l_extendedprice") * (1 - exact("l_discount")))
    return (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "c_mktsegment")
        .agg(F.round(revenue, 2).cast("double").alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))
    )


@query
def events_session(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    marked = e.withColumn("new", F.coalesce((gap > 1_800_000_000).cast("int"), F.lit(1)))
    numbered = marked.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("events"))


ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL | registry.ORACLE_SQL
