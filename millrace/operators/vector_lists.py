"""A vector index in inverted lists: coarse centres, one folder for each list, and filters that reach the scan.

Centres are fitted by k-means on a bounded sample. Every vector is written into the folder of its nearest centre, within
it in the order of the filter columns, so that a file's row groups have narrow ranges of them. A search reads the folders
of the lists that its queries probe (partition filters) and the row groups that its filter can match (pushed filters),
and compares in blocks what is left. It is exact if all lists are probed.

A filter that few rows pass is answered by comparing all of these, whatever their lists: the lists nearest to a query
need not have any of them, and there are few to compare.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.search import nearest
from millrace.plans.tables import Tables


@dataclass(frozen=True)
class ListParams:
    """``lists`` to make, from at most ``sample_rows`` vectors chosen by a hash of their id; filters that at most
    ``exact_rows`` rows pass are answered exactly. Files have row groups of about ``row_group_bytes``, which is what a
    filter passes over."""

    lists: int = 64
    sample_rows: int = 65_536
    iterations: int = 20
    seed: int = 7
    exact_rows: int = 20_000
    row_group_bytes: int = 8 << 20

    def __post_init__(self):
        if min(self.lists, self.sample_rows, self.iterations) < 1 or self.exact_rows < 0:
            raise ValueError("lists, sample_rows and iterations must be at least 1, and exact_rows not negative")


@dataclass(frozen=True)
class VectorLists:
    vectors: DataFrame  # with ``list``, the folder
    centres: np.ndarray  # a row for each list
    id_col: str
    params: ListParams


def fit_centres(vectors: DataFrame, id_col: str, params: ListParams = ListParams()) -> np.ndarray:
    """Centres of a sample of at most ``sample_rows`` vectors, at most ``lists`` of them; there is one at least."""
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    sample = usable.orderBy(F.xxhash64(id_col), id_col).limit(params.sample_rows)
    points = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if points.isEmpty():
        return np.zeros((1, 1))
    model = KMeans(k=params.lists, maxIter=params.iterations, seed=params.seed, initSteps=2)
    if params.lists == 1:  # k-means starts at two
        return np.mean([r.features.toArray() for r in points.limit(1000).collect()], axis=0, keepdims=True)
    return np.array(model.fit(points).clusterCenters())


def _products(embeddings: pd.Series, centres: np.ndarray) -> np.ndarray:
    """Inner products of vectors with all centres; what is no vector of their dimension is as far from one as another."""
    rows = np.zeros((len(embeddings), centres.shape[1]))
    for row, e in zip(rows, embeddings):
        if e is not None and len(e) == centres.shape[1]:
            row[:] = np.nan_to_num(np.asarray(e, np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    return rows @ centres.T


def write_lists(
    vectors: DataFrame, id_col: str, filter_cols: tuple[str, ...] = (), params: ListParams = ListParams(), tables: Tables | None = None
) -> VectorLists:
    """Write ``vectors(id, embedding, ...)`` as lists. Every row is in one list, also null and empty vectors."""
    tables = tables or Tables(vectors.sparkSession, "vectors")
    centres = fit_centres(vectors, id_col, params)
    half = (centres**2).sum(1) / 2  # the nearest centre has the greatest product less half its square

    @F.pandas_udf("int")
    def closest(embeddings: pd.Series) -> pd.Series:
        return pd.Series((_products(embeddings, centres) - half).argmax(1), dtype="int32")

    dealt = vectors.withColumn("list", closest(F.col("embedding").cast("array<double>")))
    order = ["list", *filter_cols, id_col]
    # ranges of (list, filter columns), so that a list with a third of all rows is several tasks and files
    ranged = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    written = tables.write(ranged, "lists", ["list"], **{"parquet.block.size": params.row_group_bytes})
    return VectorLists(written, centres, id_col, params)


def probed_lists(queries: DataFrame, index: VectorLists, probes: int, place_col: str = "place") -> DataFrame:
    """``queries`` with ``list``, and its place from 0: a row for each of the ``probes`` lists whose centres have the
    greatest products."""
    centres, n = index.centres, min(probes, len(index.centres))

    @F.pandas_udf("array<int>")
    def best(embeddings: pd.Series) -> pd.Series:
        order = np.argsort(-_products(embeddings, centres), axis=1, kind="stable")[:, :n]
        return pd.Series(list(order.astype(np.int32)), dtype=object)

    each = F.posexplode(best(F.col("embedding").cast("array<double>"))).alias(place_col, "list")
    return queries.select("*", each)


def probes_for(index: VectorLists, k: int, recall: float = 0.98, sample_rows: int = 512) -> int:
    """How many lists to probe for a recall of ``k`` neighbours, judged by the index's own vectors.

    At most ``sample_rows`` of them, chosen by a hash of their id, are searched exactly; where in its query's order of
    lists each neighbour is tells the recall of every number of probes at once.
    """
    id_col, lists = index.id_col, len(index.centres)
    sample = index.vectors.where(F.size("embedding") > 0).orderBy(F.xxhash64(id_col, F.lit(index.params.seed)), id_col).limit(sample_rows)
    asked = sample.select(F.col(id_col).alias("query"), "embedding")
    exact = nearest(asked, index.vectors.select(id_col, "embedding"), "query", id_col, k + 1)
    others = exact.where(F.col("query") != F.col(id_col)).join(index.vectors.select(id_col, "list"), id_col)
    order = probed_lists(asked, index, lists, place_col="place").select("query", "list", "place")
    rows = others.join(order, ["query", "list"]).groupBy("place").count().collect()  # at most one for each list
    met, total = 0, sum(r["count"] for r in rows)
    for r in sorted(rows, key=lambda r: r["place"]):
        met += r["count"]
        if met >= recall * total:
            return r["place"] + 1
    return lists


def search_lists(
    queries: DataFrame, query_id: str, index: VectorLists, k: int, probes: int, where: Column | None = None, same: bool = True
) -> DataFrame:
    """(query id, vector id, score, rank) of the ``k`` best vectors of each query, a stated set, among those that pass
    ``where`` in the ``probes`` lists nearest to the query; among all that pass, if they are few or all lists are asked."""
    if k < 1 or probes < 1:
        raise ValueError("k and probes must be at least 1")
    vectors = index.vectors if where is None else index.vectors.where(where)
    asked = queries.select(query_id, "embedding")
    everything = probes >= len(index.centres)
    # counting reads the filter's columns of the row groups that its ranges let through, and stops at the bound
    if not everything and where is not None:
        everything = vectors.select(F.lit(1)).limit(index.params.exact_rows + 1).count() <= index.params.exact_rows
    if everything:
        return nearest(asked, vectors.select(index.id_col, "embedding"), query_id, index.id_col, k, same)
    dealt = probed_lists(asked, index, probes)
    lists = [r["list"] for r in dealt.select("list").distinct().collect()]  # at most as many as there are centres
    read = vectors.where(F.col("list").isin(lists)).select(index.id_col, "embedding", "list")
    return nearest(dealt, read, query_id, index.id_col, k, same, within="list")


def recall(found: DataFrame, exact: DataFrame, query_id: str, vector_id: str) -> DataFrame:
    """One row: the share of the exact neighbours that were found, and whether all were; 1 where there are none."""
    both = exact.select(query_id, vector_id).join(found.select(query_id, vector_id, F.lit(1).alias("hit")), [query_id, vector_id], "left")
    return both.agg(F.coalesce(F.count("hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("recall"))
