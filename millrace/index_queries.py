"""Registered queries over indexes that are kept as tables: keywords, lists of vectors, and versions of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import oracles
from millrace.functions import text as T
from millrace.operators import keyword, metrics, routing, search, trust, vector_lists
from millrace.plans.reindex import DocumentIndex, classify
from millrace.plans.tables import Tables
from millrace.registry import query, query_as, table

# --- keywords, and rankings put together ---

#: The best 20 documents of each benchmark item: keyword(item_id, doc_id, score, rank).
KEYWORD_SQL = r"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
facts AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM w),
tf AS (SELECT doc_id, len(ws) AS length, unnest(ws) AS term FROM w),
freq AS (SELECT doc_id, length, term, count(*) AS f FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM freq GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM q JOIN df USING (term) JOIN freq USING (term), facts WHERE term <> '' GROUP BY ALL
),
keyword AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores) WHERE rank <= 20)
"""
#: The best 20 vectors of each item, whose own vector is that of its number: vector(item_id, doc_id, score, rank).
VECTOR_SQL = """
dots AS (
  SELECT item_id, e.vec_id AS doc_id, list_inner_product(CAST(o.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
  FROM benchmark JOIN embeddings o ON o.vec_id = item_id, embeddings e
),
vector AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, doc_id) AS INTEGER) AS rank FROM dots) WHERE rank <= 20)
"""
HYBRID_SQL = f"""{KEYWORD_SQL}, {VECTOR_SQL},
parts AS (SELECT item_id, doc_id, 1 / (60 + rank) AS part FROM keyword UNION ALL SELECT item_id, doc_id, 1 / (60 + rank) FROM vector),
sums AS (SELECT item_id, doc_id, round(sum(part), 9) AS score FROM parts GROUP BY ALL),
hybrid AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sums) WHERE rank <= 20)
"""
#: Documents of an item's source are relevant to it, some of them more so: relevance(item_id, doc_id, grade).
RELEVANCE_SQL = """
relevance AS (SELECT item_id, doc_id, 1 + CAST(doc_id % 3 = 0 AS INTEGER) AS grade FROM benchmark JOIN documents ON source = 'src' || (item_id % 20))
"""


def _keyword(spark, sf_dir, k=20):
    index = keyword.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return keyword.bm25(table(spark, sf_dir, "benchmark"), "item_id", index, k)


def _vector(spark, sf_dir, k=20):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    items = table(spark, sf_dir, "benchmark").select("item_id")
    own = items.join(vectors.withColumnRenamed("doc_id", "item_id"), "item_id")
    return search.nearest(own, vectors, "item_id", "doc_id", k)


@query_as(f"WITH {KEYWORD_SQL} SELECT item_id, doc_id, score, rank FROM keyword")
def keyword_topk(spark, sf_dir):
    """All benchmark items as keyword queries over all documents."""
    return _keyword(spark, sf_dir)


@query_as(f"WITH {HYBRID_SQL} SELECT item_id, doc_id, score, rank FROM hybrid")
def hybrid_topk(spark, sf_dir):
    """The same items by keywords and by vectors, the two rankings put together."""
    return keyword.fused([_keyword(spark, sf_dir), _vector(spark, sf_dir)], "item_id", "doc_id", 20)


@query_as(f"""WITH {KEYWORD_SQL}, {RELEVANCE_SQL},
ideal AS (SELECT item_id, count(*) AS relevant, sum((2 ** grade - 1) / log2(place + 1)) AS ideal
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, doc_id) AS place FROM relevance) GROUP BY item_id),
met AS (SELECT item_id, count(*) FILTER (rank <= 10) AS hits, min(rank) AS first, sum((2 ** grade - 1) / log2(rank + 1)) AS gained
  FROM keyword JOIN relevance USING (item_id, doc_id) GROUP BY item_id)
SELECT item_id, round(coalesce(hits / relevant, 0), 9) AS recall, round(coalesce(1 / first, 0), 9) AS reciprocal_rank,
  round(coalesce(gained / ideal, 0), 9) AS ndcg FROM ideal LEFT JOIN met USING (item_id)""")
def ranking_metrics(spark, sf_dir):
    """Recall of the first 10, reciprocal rank and nDCG of the keyword ranking of each item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"))
    grade = F.lit(1) + (F.col("doc_id") % 3 == 0).cast("int")
    relevance = items.join(docs, "source").select("item_id", "doc_id", grade.alias("grade"))
    found = metrics.query_metrics(_keyword(spark, sf_dir), relevance, "item_id", "doc_id", 10)
    return found.select("item_id", *[F.round(c, 9).alias(c) for c in metrics.MEASURES])


@query_as(f"""WITH {KEYWORD_SQL},
hits AS (SELECT item_id, doc_id, score, CAST(substr(source, 4) AS INTEGER) % 3 AS trusted, source, quality AS value
  FROM keyword JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)),
stated AS (SELECT *, first_value(value) OVER (PARTITION BY item_id, source ORDER BY trusted, doc_id DESC) AS counts,
  row_number() OVER (PARTITION BY item_id, source ORDER BY trusted, doc_id DESC) AS nth FROM hits WHERE value IS NOT NULL),
lists AS (SELECT a.item_id, a.doc_id, string_agg(b.doc_id, ',' ORDER BY b.doc_id) FILTER (b.value = a.counts AND b.doc_id <> a.doc_id) AS supporting,
  string_agg(b.doc_id, ',' ORDER BY b.doc_id) FILTER (b.value <> a.counts) AS conflicting
  FROM stated a JOIN stated b USING (item_id, source) WHERE a.nth = 1 GROUP BY ALL),
kept AS (SELECT h.item_id, h.doc_id, round(h.score * [1.0, 0.8, 0.5][1 + h.trusted], 6) AS score, coalesce(supporting, '') AS supporting,
  coalesce(conflicting, '') AS conflicting FROM hits h LEFT JOIN stated s USING (item_id, doc_id) LEFT JOIN lists USING (item_id, doc_id)
  WHERE s.doc_id IS NULL OR s.value = s.counts)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM kept) WHERE rank <= 10""")
def trusted_topk(spark, sf_dir):
    """The keyword ranking of each item by trust in publishers. What documents of a source state of its quality differs:
    the latest by id counts, and those that say otherwise are cited with it."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    hits = _keyword(spark, sf_dir).join(docs, "doc_id").withColumn("publisher_rank", F.substring("source", 4, 9).cast("int") % 3)
    facts = docs.join(labels, "doc_id").select(
        "doc_id", F.col("source").alias("thing"), F.lit("quality").alias("field"), F.col("quality").alias("value"), F.col("doc_id").alias("stated_at")
    )
    found = trust.trusted_ranking(hits, facts, "item_id", "doc_id", 10)
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("item_id", "doc_id", "score", "rank", listed("supporting"), listed("conflicting"))


@query
def routed_turns(spark, sf_dir):
    """All turns of conversations by the languages of all documents, or neither where that is not sure."""
    labelled = search.embed_chunks(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label")))
    turns = search.embed_chunks(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    found = routing.route(turns, routing.fit_router(labelled, "doc_id"))
    return found.select("conv_id", "turn", "route", F.round("similarity", 5).alias("similarity"), F.round("margin", 5).alias("margin"))


# --- vectors in lists ---

LISTS = vector_lists.ListParams(lists=16)
FILTERS = {"few": "label = 3", "some": "label < 3", "most": "label <> 0", "every": "true"}


def _lists(spark, sf_dir):
    return vector_lists.write_lists(table(spark, sf_dir, "embeddings"), "vec_id", ("label",), LISTS)


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query_as("""SELECT count(*) AS queries, true AS recall_is_enough, true AS all_lists_are_exact FROM embeddings WHERE vec_id % 50 = 0""")
def list_recall(spark, sf_dir):
    """Whether as many lists as the index's own vectors call for give at least 0.95 of the exact neighbours of the ids
    divisible by 50, and all lists all."""
    index, asked = _lists(spark, sf_dir), _asked(spark, sf_dir)
    exact = search.nearest(asked, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "query_id", "vec_id", 10)
    probes = (vector_lists.probes_for(index, 10), LISTS.lists)
    some, every = (vector_lists.search_lists(asked, "query_id", index, 10, n) for n in probes)
    told = [vector_lists.recall(x, exact, "query_id", "vec_id").withColumnRenamed("recall", n) for x, n in ((some, "some"), (every, "every"))]
    count = asked.agg(F.count("*").alias("queries"))
    return count.crossJoin(told[0]).crossJoin(told[1]).select(  # one row each
        "queries", (F.col("some") >= 0.95).alias("recall_is_enough"), (F.col("every") == 1).alias("all_lists_are_exact")
    )


_FILTERED = " UNION ALL ".join(
    f"""SELECT '{name}' AS selectivity, query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 12) DESC, e.vec_id) AS INTEGER) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND ({rule.replace('label', 'e.label')})) WHERE rank <= 5"""
    for name, rule in FILTERS.items()
)


@query_as(_FILTERED)
def filtered_topk(spark, sf_dir):
    """The best vectors among those that pass filters of four selectivities, which reach the scan of the lists."""
    index, asked = _lists(spark, sf_dir), _asked(spark, sf_dir)
    parts = [
        vector_lists.search_lists(asked, "query_id", index, 5, LISTS.lists if rule == "true" else 1, F.expr(rule)).select(
            F.lit(name).alias("selectivity"), "query_id", "vec_id", F.round("score", 6).alias("score"), "rank"
        )
        for name, rule in FILTERS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- versions of documents ---

#: The documents as they were before, by a stated rule: some were not there, some said something else, some went since.
_WAS_THERE, _SAID_ELSE = "doc_id % 7 <> 3", "doc_id % 5 = 1"


def _documents(spark, sf_dir):
    url = F.concat(F.lit("https://"), "source", F.lit("/"), "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", url.alias("url"), F.col("source").alias("title"), "text")
    gone = docs.where("doc_id % 9 = 2").select((-F.col("doc_id") - 1).alias("doc_id"), "url", "title", "text")
    text = F.when(F.expr(_SAID_ELSE), F.concat(F.lit("Before. "), "text")).otherwise(F.col("text"))
    return docs.where(_WAS_THERE).withColumn("text", text).unionByName(gone), docs


@query_as(f"""SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'new' WHEN doc_id % 5 = 1 THEN 'changed' ELSE 'same' END AS change FROM documents
UNION ALL SELECT -doc_id - 1, 'gone' FROM documents WHERE doc_id % 9 = 2""")
def document_changes(spark, sf_dir):
    """How each document differs from what it was, by its hash."""
    hashed = (d.select("doc_id", T.content_hash(F.col("text")).alias("content_hash")) for d in _documents(spark, sf_dir))
    return classify(*hashed, "doc_id")


@query_as(f"""WITH RECURSIVE {oracles.CHUNKS} SELECT doc_id, chunk_id, chunk_index, text, content_hash,
  count(*) OVER (PARTITION BY content_hash) > 1 AS is_duplicate FROM full_chunks""")
def incremental_chunks(spark, sf_dir):
    """The chunks of all documents, of which only those new or changed since the version before were made again."""
    index = DocumentIndex(spark, Tables(spark, "documents").root, "doc_id")
    for version in _documents(spark, sf_dir):
        index.update(version)
    return index.chunks().select("doc_id", "chunk_id", "chunk_index", "text", "content_hash", "is_duplicate")
