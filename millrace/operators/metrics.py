"""Measures of rankings against graded relevance, and how sure the difference of two rankers is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MEASURES = ("recall", "reciprocal_rank", "ndcg")


def query_metrics(ranking: DataFrame, relevance: DataFrame, query_id: str, doc_id: str, k: int) -> DataFrame:
    """(query id, recall, reciprocal_rank, ndcg) of each query that has relevant documents.

    ``ranking`` has (query id, document id, rank from 1), ``relevance`` (query id, document id, grade); grades above 0
    are relevant, and a repeated pair counts with its greatest grade. Recall is that of the first ``k``; the reciprocal
    rank is that of the first relevant document at any rank; gains are 2^grade - 1, discounted by log2(rank + 1) over
    all ranks, and divided by those of the best order of all relevant documents. A query that the ranking lacks has 0.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    told = relevance.where(F.col("grade") > 0).groupBy(query_id, doc_id).agg(F.max("grade").alias("grade"))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    # the best order needs the number of documents of each grade only, and those stand at ranks one after the other
    grades = told.groupBy(query_id, "grade").agg(F.count("*").alias("n"))
    above = Window.partitionBy(query_id).orderBy(F.col("grade").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(above), F.lit(0)).cast("long")
    best = grades.withColumn("first", first).select(
        query_id, "n",
        (gain * F.aggregate(F.sequence(F.col("first") + 1, F.col("first") + F.col("n")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))).alias("ideal"),
    ).groupBy(query_id).agg(F.sum("n").alias("relevant"), F.sum("ideal").alias("ideal"))
    met = ranking.select(query_id, doc_id, "rank").join(told, [query_id, doc_id]).groupBy(query_id).agg(
        F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"), F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("gained")
    )
    share = lambda c: F.coalesce(c, F.lit(0.0))
    return best.join(met, query_id, "left").select(
        query_id, share(F.col("hits") / F.col("relevant")).alias("recall"), share(1 / F.col("first")).alias("reciprocal_rank"),
        share(F.col("gained") / F.col("ideal")).alias("ndcg"),
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """One row: the number of queries and the means; 0 where there are none."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return per_query.agg(F.count("*").alias("queries"), *[mean(c) for c in MEASURES])


@dataclass(frozen=True)
class Bootstrap:
    """``rounds`` of resampling with a ``seed``; ``level`` is the share of rounds that the interval holds."""

    rounds: int = 1000
    seed: int = 1
    level: float = 0.95


def paired_bootstrap(
    left: DataFrame, right: DataFrame, query_id: str, measure: str = "ndcg", params: Bootstrap = Bootstrap()
) -> DataFrame:
    """One row: the mean of ``left - right`` over the queries of both, and the interval of it over resampled queries.

    A query's weight in a round is a Poisson number drawn from a hash of the query, the round and the seed, so rounds
    need no order and no state: all of them are one aggregate, and the same wherever tasks run.
    """
    both = left.select(query_id, F.col(measure).alias("l")).join(right.select(query_id, F.col(measure).alias("r")), query_id)
    drawn = both.select((F.col("l") - F.col("r")).alias("d"), query_id, F.explode(F.sequence(F.lit(1), F.lit(params.rounds))).alias("round"))
    uniform = F.shiftrightunsigned(F.xxhash64(F.col(query_id).cast("string"), "round", F.lit(params.seed)), 11) / F.lit(float(1 << 53))
    weight, below, term = F.lit(0), 0.0, 0.36787944117144233  # exp(-1)
    for n in range(1, 13):
        below += term
        term /= n
        weight = weight + F.when(uniform >= F.lit(below), F.lit(1)).otherwise(F.lit(0))
    sums = drawn.withColumn("w", weight).groupBy("round").agg(F.sum(F.col("w") * F.col("d")).alias("s"), F.sum("w").alias("n"))
    means = sums.where(F.col("n") > 0).select((F.col("s") / F.col("n")).alias("mean"))
    tail = (1 - params.level) / 2
    ends = F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail)))
    return means.agg(ends.alias("e"), F.avg((F.col("mean") > 0).cast("double")).alias("share_above")).crossJoin(
        both.agg(F.avg(F.col("l") - F.col("r")).alias("difference"), F.count("*").alias("queries"))  # one row each
    ).select("queries", "difference", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"), "share_above")
