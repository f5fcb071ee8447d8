"""Keyword search: an inverted index as tables, BM25 with postings skipped by upper bounds, and fusion of rankings.

The index has three tables. ``postings`` has a row for each term and block of documents: their ids, frequencies and
lengths as arrays, and the greatest frequency and least length among them, which bound every score of the row. A block is
some documents that stand together, and its rows are made where these are read, so building shuffles no postings, and texts
only where files give a task too many of them. ``terms`` has a term's number of documents and the bounds over all its rows, ``totals`` one row on the
collection. Terms are dealt over folders by their hash, and files are sorted by term, so a query reads the folders of its
terms alone, and of these the row groups that have them. Texts are never read at query time.

Queries are answered block by block: the rows of a block that any query of a group has words of meet in one task, once for
all of the group, and the best documents of each query leave it. What cannot matter is skipped: the rarest words of a query
tell a score that its k-th best document reaches for certain, and a block whose bounds for the query's words add up to less
is not looked at.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.search import top_k
from millrace.plans import kept
from millrace.plans.tables import Tables
from millrace.session import ship_package

#: Letters and digits of any script make words.
WORD = re.compile(r"[^\W_]+")
#: Postings of a block at most, beside its number of documents; about 50 bytes each while it is made.
BLOCK_POSTINGS = 500_000
#: Bytes of text of which a task makes and sorts the postings; about nine times as much memory.
TASK_BYTES = 32 << 20
#: Row groups of the postings' files, of which a query reads those that have its terms.
ROW_GROUP_BYTES = 4 << 20
#: Scores are rounded to this many places, so that they do not depend on the order of sums.
PLACES = 6
SLACK = 1e-5
#: Documents, as a multiple of ``k``, that the rarest words of a query bring in for its first bound.
SEEDS = 20
#: Queries that a task answers for a block of documents at once: as many sums of scores for each document.
GROUP_QUERIES = 256
#: Words of queries, with what goes with them, up to which they are sent to the postings; beyond it both are shuffled.
SENT_ROWS = 100_000


@dataclass(frozen=True)
class Bm25:
    """``k1`` and ``b`` as usual; ``block_rows`` documents in a block, ``folders`` of terms."""

    k1: float = 1.2
    b: float = 0.75
    block_rows: int = 4096
    folders: int = 16

    def __post_init__(self):
        if self.k1 < 0 or not 0 <= self.b <= 1 or self.block_rows < 1 or self.folders < 1:
            raise ValueError("k1 must not be negative, b be from 0 to 1, block_rows and folders at least 1")

    def weight(self, frequency: Column, length: Column, mean: Column) -> Column:
        """What a term's frequency counts in a document of a length; it grows with the first and falls with the second."""
        norm = 1 - self.b + self.b * length / F.greatest(mean, F.lit(1e-9))
        return frequency * (self.k1 + 1) / (frequency + self.k1 * norm)


@dataclass(frozen=True)
class KeywordIndex:
    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    params: Bm25


def keywords(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _folder(term: Column, params: Bm25) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(params.folders)).cast("int")


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as they are read, if no partition has more text than a task is to sort; else dealt by their ids."""
    size = F.sum(F.coalesce(F.octet_length(text_col), F.lit(0))).alias("size")
    found = docs.groupBy(F.spark_partition_id()).agg(size).agg(F.max("size").alias("most"), F.sum("size").alias("all")).first()
    if (found["most"] or 0) <= TASK_BYTES:
        return docs
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-found["all"] // TASK_BYTES)), id_col)


def build_index(
    docs: DataFrame, id_col: str, text_col: str = "text", params: Bm25 = Bm25(), tables: Tables | None = None
) -> KeywordIndex:
    """Write the index of ``docs``, whose ids are unique, and return it. Null texts have no words, null ids are left out.

    A row of postings has at most ``block_rows`` documents whatever the number of documents with its term, so a word of
    every document is many rows.
    """
    tables = tables or Tables(docs.sparkSession, "keywords")
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    columns = ["term", "block", "n", "most", "least", "docs", "frequencies", "lengths"]
    schema = f"term string, block long, n long, most int, least int, docs array<{kind}>, frequencies array<int>, lengths array<int>"

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, id_type = TaskContext.get().partitionId() << 32, None
        places: defaultdict[str, int] = defaultdict()  # of the block's terms, in the order in which they came
        places.default_factory = places.__len__
        ids: list = []  # of the block's documents
        held, frequencies, n_terms, n_words = (array("i") for _ in range(4))  # two for each posting, two for each document

        def rows() -> pa.RecordBatch:
            terms, per_doc = np.array(held), np.array(n_terms)
            order = np.argsort(terms, kind="stable")
            sizes = np.bincount(terms)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            counts, lengths = np.array(frequencies)[order], np.repeat(np.array(n_words), per_doc)[order]
            docs_ = pa.array(ids, id_type).take(pa.array(np.repeat(np.arange(len(ids)), per_doc)[order]))
            made = [
                pa.array(list(places), pa.string()), pa.array(np.full(len(sizes), block), pa.int64()), pa.array(sizes, pa.int64()),
                pa.array(np.maximum.reduceat(counts, starts[:-1]), pa.int32()), pa.array(np.minimum.reduceat(lengths, starts[:-1]), pa.int32()),
                *[pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x) for x in (docs_, pa.array(counts, pa.int32()), pa.array(lengths, pa.int32()))],
            ]
            places.clear()
            ids.clear()
            for part in (held, frequencies, n_terms, n_words):
                del part[:]
            return pa.RecordBatch.from_arrays(made, columns)

        for batch in batches:
            id_type = batch.column("doc").type
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                words = keywords(text)
                found = Counter(words)
                held.extend(map(places.__getitem__, found))
                frequencies.extend(found.values())
                ids.append(doc)
                n_terms.append(len(found))
                n_words.append(len(words))
                if held and (len(ids) >= params.block_rows or len(held) >= BLOCK_POSTINGS):
                    yield rows()
                    block += 1
        if held:
            yield rows()

    named = docs.where(F.col(id_col).isNotNull())
    texts = _dealt(named.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "doc", "text")
    inverted = texts.mapInArrow(invert, schema)
    postings = inverted.withColumn("folder", _folder(F.col("term"), params)).sortWithinPartitions("folder", "term", "block")
    written = tables.write(postings, "postings", ["folder"], **{"parquet.block.size": ROW_GROUP_BYTES})
    terms = written.groupBy("folder", "term").agg(F.sum("n").alias("df"), F.max("most").alias("most"), F.min("least").alias("least"))
    stats = tables.write(terms.sortWithinPartitions("folder", "term"), "terms", ["folder"])
    length = written.agg(F.coalesce(F.sum(F.aggregate("frequencies", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("words"))
    totals = named.agg(F.count("*").alias("documents")).crossJoin(length)  # one row each
    return KeywordIndex(written, stats, tables.write(totals, "totals"), params)


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be sent to all tasks, if ``rows``, a number that has been counted, is small enough."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def _query_terms(queries: DataFrame, query_id: str, text_col: str, index: KeywordIndex) -> DataFrame:
    """(query, folder, term, idf, mean, bound): the different words of each query that the index has."""

    @F.pandas_udf("array<string>")
    def asked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(keywords(t))))

    ship_package(queries.sparkSession)
    words = queries.select(F.col(query_id).alias("query"), F.explode(asked(F.col(text_col))).alias("term"))
    facts = index.totals.first()  # one row
    n, mean = F.lit(facts["documents"]), F.lit(facts["words"] / max(1, facts["documents"]))
    words = kept(words.withColumn("folder", _folder(F.col("term"), index.params)))
    known = index.terms.join(_sent(words, words.count()), ["folder", "term"])
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return known.select(
        "query", "folder", "term", "df", idf.alias("idf"), mean.alias("mean"),
        (idf * index.params.weight(F.col("most"), F.col("least"), mean)).alias("bound"),
    )


def _scored(rows: DataFrame, params: Bm25) -> DataFrame:
    """(query, block, doc, part) of each document of postings rows: what one term adds to one score."""
    each = rows.select("query", "block", "idf", "mean", F.explode(F.arrays_zip("docs", "frequencies", "lengths")).alias("p"))
    part = F.col("idf") * params.weight(F.col("p.frequencies"), F.col("p.lengths"), F.col("mean"))
    return each.select("query", "block", F.col("p.docs").alias("doc"), part.alias("part"))


def with_floors(terms: DataFrame, index: KeywordIndex, k: int) -> DataFrame:
    """``terms`` with ``floor``, a score that the query's k-th best document reaches: that of its rarest words alone."""
    rarest = Window.partitionBy("query").orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = terms.withColumn("before", before).where(F.col("before") < SEEDS * k).where(F.col("df") <= SEEDS * k)
    seeds = _sent(seeds.select("query", "folder", "term", "idf", "mean"), terms.count())
    postings = index.postings.join(seeds, ["folder", "term"])
    sums = _scored(postings, index.params).groupBy("query", "doc").agg(F.sum("part").alias("score"))
    kth = top_k(sums, "query", "doc", k).where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    return terms.join(kth, "query", "left").fillna(-1.0, ["floor"])


def live_blocks(terms: DataFrame, index: KeywordIndex) -> DataFrame:
    """(group, block) in which the bounds of some query of the group add up to its floor; from the bounds alone."""
    bounds = index.postings.select("folder", "term", "block", "most", "least").join(_sent(terms, terms.count()), ["folder", "term"])
    most = F.col("idf") * index.params.weight(F.col("most"), F.col("least"), F.col("mean"))
    sums = bounds.groupBy("group", "query", "block").agg(F.sum(most).alias("most"), F.first("floor").alias("floor"))
    return sums.where(F.col("most") >= F.col("floor") - SLACK).select("group", "block").distinct()


def bm25(
    queries: DataFrame, query_id: str, index: KeywordIndex, k: int, doc_id: str = "doc_id", text_col: str = "text",
    skip: bool = True,
) -> DataFrame:
    """(query id, document id, score, rank): the ``k`` best documents of each query that have a word of it.

    Queries are a stated set, taken in groups of about ``GROUP_QUERIES``; a word counts once however often a query has
    it. Equal scores are ordered by the smaller id. ``skip`` false looks at all blocks, for the same result. Queries
    without known words have no rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    params = index.params
    groups = F.lit(max(1, -(-queries.count() // GROUP_QUERIES)))
    terms = _query_terms(queries, query_id, text_col, index).withColumn("group", F.pmod(F.xxhash64("query"), groups).cast("int"))
    terms = kept(terms)
    terms = kept(with_floors(terms, index, k)) if skip else terms.withColumn("floor", F.lit(-1.0))
    asked = F.collect_list(F.struct("query", "idf", "floor"))
    by_term = terms.groupBy("group", "folder", "term").agg(asked.alias("asked"), F.first("mean").alias("mean"))
    rows = index.postings.join(_sent(by_term, terms.count()), ["folder", "term"])
    if skip:
        rows = rows.join(live_blocks(terms, index), ["group", "block"], "left_semi")
    kinds = (dict(queries.dtypes)[query_id], dict(index.postings.dtypes)["docs"][6:-1])

    def weight(n, length, mean):
        return n * (params.k1 + 1) / (n + params.k1 * (1 - params.b + params.b * length / max(mean, 1e-9)))

    def score(group: pd.DataFrame) -> pd.DataFrame:
        docs, place = np.unique(np.concatenate(group["docs"].tolist()), return_inverse=True)
        ends = np.cumsum([len(d) for d in group["docs"]])
        bounds: dict = {}
        floors: dict = {}
        for wanted, most, least, mean in zip(group["asked"], group["most"], group["least"], group["mean"]):
            for a in wanted:
                bounds[a["query"]] = bounds.get(a["query"], 0.0) + a["idf"] * weight(most, least, mean)
                floors[a["query"]] = a["floor"]
        sums = {q: np.zeros(len(docs)) for q, most in bounds.items() if most >= floors[q] - SLACK}
        for wanted, n, length, mean, end in zip(group["asked"], group["frequencies"], group["lengths"], group["mean"], ends):
            at, part = place[end - len(n) : end], weight(np.asarray(n, float), np.asarray(length, float), mean)
            for a in wanted:
                if a["query"] in sums:
                    sums[a["query"]][at] += a["idf"] * part
        found = []
        for q, scores in sums.items():
            scores = np.round(scores, PLACES)
            limit = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
            for at in np.nonzero((scores >= limit) & (scores > 0))[0].tolist():
                found.append((q, docs[at], float(scores[at])))
        return pd.DataFrame(found, columns=["query", "doc", "score"])

    best = top_k(
        rows.groupBy("group", "block").applyInPandas(score, f"query {kinds[0]}, doc {kinds[1]}, score double"), "query", "doc", k
    )
    return best.select(F.col("query").alias(query_id), F.col("doc").alias(doc_id), "score", "rank")


def fused(rankings: list[DataFrame], query_id: str, doc_id: str, k: int, constant: int = 60) -> DataFrame:
    """(query id, document id, score, rank) by reciprocal-rank fusion: the sum of 1 / (constant + rank) over rankings."""
    if not rankings or k < 1 or constant < 0:
        raise ValueError("there must be a ranking, k be at least 1, and the constant not negative")
    parts = [r.select(query_id, doc_id, (1 / (F.lit(constant) + F.col("rank"))).alias("part")) for r in rankings]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    scores = both.groupBy(query_id, doc_id).agg(F.round(F.sum("part"), 9).alias("score"))
    return top_k(scores, query_id, doc_id, k)
