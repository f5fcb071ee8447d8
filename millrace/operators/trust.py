"""Ranking by how far a publisher is trusted, and passages that contradict each other.

Passages of a ranking may state values of a field, as facts drawn from them. Of those that state the same field of the
same thing with different values, that of the most trusted publisher counts, of equal ones the latest; passages with
another value leave the ranking and are cited with it as conflicting, those with the same value as supporting it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import urls
from millrace.operators.search import top_k


@dataclass(frozen=True)
class Trust:
    """Hosts of primary publishers and their domains; hosts of verified secondary ones are the caller's.

    ``weights`` are what scores are multiplied with: of primary, verified secondary and all other publishers.
    """

    primary: tuple[str, ...] = ("gov.in", "nic.in")
    secondary: tuple[str, ...] = ()
    weights: tuple[float, float, float] = (1.0, 0.8, 0.5)

    def __post_init__(self):
        if len(self.weights) != 3 or min(self.weights) < 0:
            raise ValueError("there are three weights, none of them negative")


def publisher_rank(url: Column, trust: Trust = Trust()) -> Column:
    """0 for primary publishers, 1 for verified secondary ones, 2 for all others and for what is no url."""
    host = F.lower(F.regexp_extract(F.coalesce(urls.netloc(url), F.lit("")), r"^(?:[^@]*@)?([^:]*)", 1))

    def of(domains: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for d in domains:
            found = found | (host == d) | host.endswith("." + d)
        return found

    return F.when(of(trust.primary), 0).when(of(trust.secondary), 1).otherwise(2)


def trusted_ranking(
    hits: DataFrame, facts: DataFrame, query_id: str, doc_id: str, k: int, trust: Trust = Trust()
) -> DataFrame:
    """(query id, document id, score, rank, supporting, conflicting) of the ``k`` best hits that contradict none better.

    ``hits`` has (query id, document id, score, publisher_rank), a bounded number for each query. ``facts`` has (document
    id, thing, field, value, stated_at); a document may state several, and one without any stands for itself. A hit is
    out if it states another value than the one that counts, of any field. Order within a field: publisher rank, latest
    date, score, smaller id; a null date is the oldest, a null value states nothing. Lists are of ids, in order.
    """
    stated = facts.where(F.col("value").isNotNull()).select(doc_id, "thing", "field", "value", "stated_at").distinct()
    met = hits.select(query_id, doc_id, "score", "publisher_rank").join(stated, doc_id)
    group = Window.partitionBy(query_id, "thing", "field")
    best = group.orderBy("publisher_rank", F.col("stated_at").desc_nulls_last(), F.col("score").desc(), doc_id, "value")
    told = met.select(
        "*", F.first("value").over(best).alias("__counts"), F.row_number().over(best).alias("__nth"),
        F.collect_list(F.struct(F.col(doc_id).alias("d"), F.col("value").alias("v"))).over(group).alias("__all"),
    )
    cited = lambda same: F.transform(F.filter("__all", lambda x: (x["v"] == F.col("__counts")) == F.lit(same)), lambda x: x["d"])
    first = F.col("__nth") == 1
    of_doc = told.groupBy(query_id, doc_id).agg(
        F.bool_or(F.col("value") != F.col("__counts")).alias("__out"),
        F.flatten(F.collect_list(F.when(first, cited(True)))).alias("__same"),
        F.flatten(F.collect_list(F.when(first, cited(False)))).alias("__other"),
    )
    weight = F.element_at(F.array(*map(F.lit, trust.weights)), (F.col("publisher_rank") + 1).cast("int"))
    left = hits.join(of_doc, [query_id, doc_id], "left").where(~F.coalesce("__out", F.lit(False)))
    named = lambda c: F.array_sort(F.array_except(F.array_distinct(F.coalesce(c, F.array().cast(f"array<{dict(hits.dtypes)[doc_id]}>"))), F.array(doc_id)))
    scored = left.select(
        query_id, doc_id, F.round(F.col("score") * weight, 6).alias("score"), named("__same").alias("supporting"), named("__other").alias("conflicting")
    )
    return top_k(scored, query_id, doc_id, k)
