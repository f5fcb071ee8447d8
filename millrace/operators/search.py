"""Embedding, exact inner-product search with citations, and verification of a vector table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators.coverage import evidence
from millrace.plans import computed
from millrace.session import ship_package

METRIC = "inner_product_on_normalized_embeddings"


class Encoder(Protocol):
    def encode(self, texts: list[str], **options: Any) -> np.ndarray: ...


class _Places(dict):
    """The component of each word, those that count against it after all others; words seen are remembered, in bounds."""

    MOST = 200_000

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(self) >= self.MOST:
            self.clear()
        place = self[word] = h % self.dimension + (0 if h >> 63 else self.dimension)
        return place


_places = lru_cache(maxsize=4)(_Places)  # for each worker process


class HashingEncoder:
    """A deterministic encoder: signed hashed words, scaled to unit length."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def encode(self, texts: list[str], normalize_embeddings: bool = True, **_: Any) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        place = _places(self.dimension).__getitem__
        for row, text in zip(out, texts):
            counts = np.bincount(np.fromiter(map(place, text.lower().split()), np.int64), minlength=2 * self.dimension)
            row[:] = counts[: self.dimension] - counts[self.dimension :]
            if normalize_embeddings and (n := np.linalg.norm(row)):
                row /= n
        return out


def encode(encoder: Encoder, texts: list[str], batch_size: int) -> np.ndarray:
    parts = [
        np.asarray(
            encoder.encode(
                texts[k : k + batch_size], normalize_embeddings=True, convert_to_numpy=True, batch_size=batch_size,
                show_progress_bar=False,
            ),
            np.float32,
        )
        for k in range(0, len(texts), batch_size)
    ]
    found = np.concatenate(parts) if parts else np.empty((0, 0), np.float32)
    if found.ndim != 2 or len(found) != len(texts):
        raise ValueError("the encoder must return one vector for each text")
    return found


def embed_chunks(chunks: DataFrame, encoder: Encoder | None = None, batch_size: int = 32, text_col: str = "text") -> DataFrame:
    """``chunks`` with ``embedding``; vectors are stored as the encoder gives them."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    ship_package(chunks.sparkSession)
    model = encoder or HashingEncoder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encode(model, [t or "" for t in texts], batch_size)), dtype=object)

    return chunks.withColumn("embedding", run(F.col(text_col)))


def manifest(index: DataFrame, source_file: str, embedding_model: str, index_file: str, metadata_file: str | None = None) -> DataFrame:
    """One row on a vector table."""
    return index.agg(F.max(F.size("embedding")).alias("dimension"), F.count("*").alias("chunk_count")).select(
        F.lit(source_file).alias("source_file"), F.regexp_extract(F.lit(source_file), r"([^/]*)$", 1).alias("source_file_name"),
        F.lit(embedding_model).alias("embedding_model"), F.lit(METRIC).alias("metric"), "dimension", "chunk_count",
        F.lit(index_file).alias("index_file"), F.lit(metadata_file or index_file).alias("metadata_file"),
    )


#: Queries and vectors of a block: a pair of blocks is a matrix product of 1024 by 4096 doubles, made in slices.
QUERY_ROWS, VECTOR_ROWS = 1024, 4096
#: Queries of a block whose scores are held at once.
SLICE_ROWS = 64


def _blocks(rows: DataFrame, id_col: str, names: tuple[str, str, str], size: int, within: list[str]) -> DataFrame:
    """A row for each block of at most about ``size`` rows of one dimension, and of one value of ``within``: ids and
    components, one after the other."""
    keys = [F.col(c) for c in within]
    dealt = rows.select(
        *keys, F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias(names[2])
    ).where(F.col(names[2]) > 0)
    if within:
        counts = rows.groupBy(*within).agg(F.ceil(F.count("*") / size).alias("n_blocks"))
        dealt = dealt.join(counts, within)
    else:
        dealt = dealt.withColumn("n_blocks", F.lit(max(1, -(-rows.count() // size))))
    one = F.collect_list(F.struct("id", "v"))
    grouped = dealt.groupBy(*within, names[2], F.pmod(F.xxhash64("id"), "n_blocks").alias("block")).agg(F.array_sort(one).alias("rows"))
    return grouped.select(
        *within, names[2], F.transform("rows", lambda r: r["id"]).alias(names[0]),
        F.flatten(F.transform("rows", lambda r: r["v"])).alias(names[1]),
    )


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best; of those as good as the last, the first, as a block is in the order of its ids."""
    if len(scores) <= k:
        return np.arange(len(scores))
    limit = np.partition(scores, -k)[-k]
    better = np.nonzero(scores > limit)[0]
    return np.concatenate((better, np.nonzero(scores == limit)[0][: k - len(better)]))


def nearest(
    queries: DataFrame, vectors: DataFrame, query_id: str, vector_id: str, k: int, same: bool = True, within: str | None = None
) -> DataFrame:
    """(query id, vector id, score, rank) of the ``k`` vectors of the greatest inner product with each query.

    ``queries`` is a stated set, compared with all vectors in blocks: a pair of blocks is a matrix product, of which
    the best ``k`` of each query leave, so what is shuffled are ``k`` rows for a query and block, and no scores of all
    pairs. Equal scores are ordered by the smaller vector id; a product that is no number is none. ``same`` is false where a query is not to find its own id.
    ``within`` names a column of both sides whose values must be equal; a query may have rows with several.
    """
    ship_package(vectors.sparkSession)
    keys = [within] if within else []
    q = _blocks(queries, query_id, ("qs", "qv", "qd"), QUERY_ROWS, keys)
    v = _blocks(vectors, vector_id, ("vs", "vv", "vd"), VECTOR_ROWS, keys)
    kinds = (dict(queries.dtypes)[query_id], dict(vectors.dtypes)[vector_id])

    @F.pandas_udf(f"array<struct<q:{kinds[0]},v:{kinds[1]},score:double>>")
    def compare(qs: pd.Series, qv: pd.Series, vs: pd.Series, vv: pd.Series) -> pd.Series:
        out = []
        for a, x, b, y in zip(qs, qv, vs, vv):
            a, b = list(a), list(b)
            left, right = (np.asarray(m, np.float64).reshape(len(ids), -1) for ids, m in ((a, x), (b, y)))
            if left.shape[1] != right.shape[1]:
                out.append([])
                continue
            place = {name: i for i, name in enumerate(b)} if not same else {}
            rows = []
            for begin in range(0, len(a), SLICE_ROWS):
                part = left[begin : begin + SLICE_ROWS]
                scores = np.round(part @ right.T, 12)  # so that equal vectors have equal scores in every block
                scores[~np.isfinite(scores)] = -np.inf  # vectors with null or infinite components are near to none
                for name, row in zip(a[begin:], scores):
                    if name in place:
                        row[place[name]] = -np.inf
                    rows += [(name, b[j], float(row[j])) for j in best_of(row, k).tolist() if row[j] > -np.inf]
            out.append(rows)
        return pd.Series(out, dtype=object)

    # every block of queries meets every block of vectors, which is what a stated query set against all rows is
    met = v.join(q, within) if within else v.crossJoin(q)
    pairs = met.select(F.explode(compare("qs", "qv", "vs", "vv")).alias("r"))
    found = pairs.select(F.col("r.q").alias(query_id), F.col("r.v").alias(vector_id), "r.score")
    return top_k(found, query_id, vector_id, k)


def top_k(scores: DataFrame, query_id: str, vector_id: str, k: int) -> DataFrame:
    """The ``k`` best rows of each query with their rank; equal scores by the smaller vector id."""
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(vector_id))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def citation() -> Column:
    return F.struct("title", "source_url", "section", "chunk_id").alias("citation")


def search_chunks(
    index: DataFrame, question: str, k: int = 5, encoder: Encoder | None = None, embedding_model: str = "hashing",
    manifest_row: dict | None = None,
) -> DataFrame:
    """The best chunks for a question, with score, rank and citation. ``index`` has position, embedding and chunks."""
    if not question.strip():
        raise ValueError("question must not be blank")
    if k < 1:
        raise ValueError("top_k must be at least 1")
    if manifest_row is not None:
        if manifest_row["chunk_count"] != index.count():
            raise ValueError("vectors and metadata differ in number")
        if manifest_row["embedding_model"] != embedding_model:
            raise ValueError(f"the index was made with {manifest_row['embedding_model']}")
    vector = encode(encoder or HashingEncoder(), [question], 1)[0].tolist()
    have = set(index.columns)
    for name in ("title", "source_url", "section", "chunk_id"):
        if name not in have:
            index = index.withColumn(name, F.lit(None).cast("string"))
    best = (
        index.withColumn("score", V.dot(F.array(*[F.lit(float(x)) for x in vector]), F.col("embedding")))
        .orderBy(F.col("score").desc(), "position").limit(k)
    )
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "position"))  # of k rows
    return best.select(rank.alias("rank"), *[c for c in index.columns if c != "embedding"], "score", citation())


def render_hits(hits: DataFrame) -> DataFrame:
    """A line for each hit, with names for what is missing."""
    named = lambda c, name: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(name))
    return hits.select(
        "rank",
        F.format_string(
            "%d. %s | %s | score=%.4f | %s", "rank", named("title", "Untitled"), named("section", "Unspecified section"),
            "score", named("source_url", "No source URL"),
        ).alias("line"),
    )


def align(vectors: DataFrame, metadata: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(position, aligned) of each position of either side: whether both have it, with the same key."""
    left = vectors.select("position", F.col(key).alias("__v"))
    right = metadata.select("position", F.col(key).alias("__m"))
    return left.join(right, "position", "full").select("position", F.col("__v").eqNullSafe(F.col("__m")).alias("aligned"))


def verify_vectors(index: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """One row: counts, dimension, and whether vectors are finite, nonzero and of unit length, and ids are different."""
    v = F.col("embedding")
    return index.agg(
        F.count("*").alias("vector_count"), F.countDistinct(id_col).alias("id_count"),
        F.min(F.size(v)).alias("min_dimension"), F.max(F.size(v)).alias("max_dimension"),
        F.coalesce(F.bool_and(V.is_finite(v)), F.lit(True)).alias("finite_vectors"),
        F.coalesce(F.bool_and(V.norm(v) > 0), F.lit(True)).alias("nonzero_vectors"),
        F.coalesce(F.bool_and(V.is_unit(v)), F.lit(True)).alias("normalized_vectors"),
    )


def verify_index(
    spark: SparkSession, chunks: DataFrame, index: DataFrame, dimension: int, cases: DataFrame | None = None,
    encoder: Encoder | None = None, k: int = 5,
) -> dict[str, Any]:
    """Raises ValueError at the first fault of the index; returns the report. Chunks and index have positions."""
    if k < 1:
        raise ValueError("top_k must be at least 1")
    ids = chunks.agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("d")).first()
    if ids["n"] != ids["d"]:
        raise ValueError("chunk ids are repeated")
    facts = verify_vectors(index).first()
    if facts["vector_count"] != ids["n"]:
        raise ValueError("there is not one vector for each chunk")
    if not align(index, chunks).where("not aligned").isEmpty():
        raise ValueError("metadata do not follow the order of the chunks")
    if ids["n"] and not facts["min_dimension"] == facts["max_dimension"] == dimension:
        raise ValueError("the dimension differs from the manifest")
    if not facts["finite_vectors"]:
        raise ValueError("a vector is not finite")
    if not facts["nonzero_vectors"]:
        raise ValueError("a vector is zero")
    report = {
        "passed": True, "chunk_count": ids["n"], "vector_count": facts["vector_count"], "dimension": dimension,
        "finite_vectors": True, "nonzero_vectors": True, "metadata_aligned": True,
        "normalized_vectors": facts["normalized_vectors"], "semantic_cases": [],
    }
    if cases is not None:
        hits = case_hits(embed_chunks(cases, encoder, text_col="query"), index, k).orderBy("id").collect()  # a row for each case
        report["semantic_cases"] = [r.asDict() for r in hits]
        if hits:
            report["source_hit_rate"] = sum(r["source_hit"] for r in hits) / len(hits)
            report["evidence_hit_rate"] = sum(r["evidence_hit"] for r in hits) / len(hits)
    return report


def case_hits(cases: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(id, source_hit, evidence_hit, top_score) of each case over its ``k`` best chunks, whose texts are fetched last."""
    best = nearest(cases, index, "id", "position", k).select("id", "position", "score")
    told = T.fold_terms(cases.select("id", "relevant_source_urls", "relevant_terms"), "id", "relevant_terms")
    met = best.join(told, "id").join(index.select("position", "source_url", "text"), "position")
    met = computed(met, folded=T.fold(F.col("text")))
    source = F.array_contains("relevant_source_urls", F.col("source_url"))
    return met.groupBy("id").agg(
        F.bool_or(F.coalesce(source, F.lit(False))).alias("source_hit"),
        F.bool_or(F.coalesce(source & evidence(F.col("folded"), F.col("relevant_terms")), F.lit(False))).alias("evidence_hit"),
        F.max("score").alias("top_score"),
    )
