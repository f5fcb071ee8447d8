"""Routes for questions, learnt from labelled ones: the nearest class centre, or none where that is not sure enough.

Questions are vectors of an encoder. A class is the mean of its labelled questions. A question that is far from every
class is ``unsupported``; one that lies between two classes needs ``clarification``. Both limits come from a part of the
labelled questions that the centres have not seen: no words are listed anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans import kept

UNSUPPORTED, CLARIFICATION = "unsupported", "clarification"


@dataclass(frozen=True)
class RouteParams:
    """``held_out`` of 10 parts calibrate; ``accuracy`` is that of accepted questions there; ``strange`` is the share of
    a class's own questions that may be taken for unsupported."""

    held_out: int = 3
    accuracy: float = 0.95
    strange: float = 0.02
    steps: int = 100

    def __post_init__(self):
        if not 0 < self.held_out < 10 or not 0 < self.accuracy <= 1 or not 0 <= self.strange < 1 or self.steps < 1:
            raise ValueError("held_out is from 1 to 9, accuracy and strange are shares, and steps at least 1")


@dataclass(frozen=True)
class Router:
    labels: tuple[str, ...]
    centres: np.ndarray
    least_similarity: float
    least_margin: float


def _centres(rows: DataFrame, dimension: int) -> tuple[tuple[str, ...], np.ndarray]:
    sums = rows.groupBy("label").agg(*[F.avg(F.col("embedding")[k].cast("double")).alias(f"e{k}") for k in range(dimension)])
    found = sums.orderBy("label").collect()  # a row for each class
    centres = np.array([list(r[1:]) for r in found], np.float64).reshape(len(found), dimension)
    return tuple(r["label"] for r in found), centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def _judged(embedding: Column, centres: np.ndarray) -> Column:
    """(nearest, similarity, margin): the class of the greatest cosine, it, and how much more it is than the next."""

    @F.pandas_udf("nearest int, similarity double, margin double")
    def judge(vectors: pd.Series) -> pd.DataFrame:
        x = np.zeros((len(vectors), centres.shape[1]))
        for row, v in zip(x, vectors):
            if v is not None and len(v) == len(row):
                row[:] = np.nan_to_num(np.asarray(v, np.float64))
        cosine = x @ centres.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        first = cosine.argmax(1)
        best = np.take_along_axis(cosine, first[:, None], 1)[:, 0]
        rest = cosine.copy()
        np.put_along_axis(rest, first[:, None], -1.0, 1)
        return pd.DataFrame({"nearest": first.astype(np.int32), "similarity": best, "margin": best - rest.max(1)})

    return judge(embedding.cast("array<double>"))


def fit_router(labelled: DataFrame, id_col: str, params: RouteParams = RouteParams()) -> Router:
    """A router from ``labelled(id, embedding, label)``; null labels and empty vectors are left out."""
    # read several times, and filtered only then: encoders are asked once for each text
    told = kept(labelled.select(id_col, "embedding", F.col("label").cast("string").alias("label")))
    usable = told.where(F.col("label").isNotNull() & (F.size("embedding") > 0))
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(10))
    dimension = usable.agg(F.max(F.size("embedding")).alias("d")).first()["d"]
    if dimension is None:
        raise ValueError("there are no labelled questions")
    labels, centres = _centres(usable.where(part >= params.held_out), dimension)
    if not labels:
        raise ValueError("there are no labelled questions beside those that are held out")
    names = F.array(*map(F.lit, labels))
    judged = usable.where(part < params.held_out).withColumn("j", _judged(F.col("embedding"), centres))
    right = F.element_at(names, F.col("j.nearest") + 1) == F.col("label")
    seen = judged.select(F.col("j.similarity").alias("similarity"), F.col("j.margin").alias("margin"), right.alias("right"))
    shares = F.array(*[F.lit(k / params.steps) for k in range(params.steps)])
    facts = seen.agg(
        F.percentile(F.when(F.col("right"), F.col("similarity")), F.lit(params.strange)).alias("s"), F.percentile("margin", shares).alias("m")
    ).first()
    if facts["m"] is None:
        return Router(labels, centres, -1.0, 0.0)
    limits = sorted({0.0, *map(float, facts["m"])})
    # a row for each number of limits that a margin reaches; the accuracy at a limit is that of all that reach it
    reached = F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: F.col("margin") >= x))
    counts = {r["n"]: r for r in seen.groupBy(reached.alias("n")).agg(F.count("*").alias("all"), F.count_if("right").alias("ok")).collect()}
    rates, passed, right_ = [], 0, 0
    for n in range(len(limits), 0, -1):
        if n in counts:
            passed, right_ = passed + counts[n]["all"], right_ + counts[n]["ok"]
        if passed:
            rates.append({"limit_": limits[n - 1], "a": right_ / passed})
    rates.reverse()
    enough = [r["limit_"] for r in rates if r["a"] >= params.accuracy]
    margin = min(enough) if enough else max(rates, key=lambda r: (r["a"], -r["limit_"]))["limit_"]
    return Router(labels, centres, float(facts["s"]) if facts["s"] is not None else -1.0, float(margin))


def route(questions: DataFrame, router: Router) -> DataFrame:
    """``questions(..., embedding)`` with ``route``, ``similarity`` and ``margin``; what has no vector is unsupported."""
    j = F.col("__j")
    names = F.array(*map(F.lit, router.labels))
    empty = F.coalesce(F.size("embedding"), F.lit(-1)) <= 0
    chosen = (
        F.when(empty | (j["similarity"] < router.least_similarity), UNSUPPORTED)
        .when(j["margin"] < router.least_margin, CLARIFICATION).otherwise(F.element_at(names, j["nearest"] + 1))
    )
    judged = questions.withColumn("__j", _judged(F.col("embedding"), router.centres))
    return judged.select(*questions.columns, chosen.alias("route"), j["similarity"].alias("similarity"), j["margin"].alias("margin"))
