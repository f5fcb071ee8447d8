"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.workspace import Workspace


def union_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merge the label classes of each pair of positions; a class is named by its smallest position."""
    while True:
        a, b = labels[left], labels[right]
        differ = a != b
        if not differ.any():
            return labels
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(mins, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    mins = _smallest(edges)
    linked = edges.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(mins.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(ws: Workspace, links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links(a, b)``; the component is its smallest node.

    Every round is two joins on node ids over tables of the links' size; each round is written to the workspace, so
    a lost executor costs one round at most. Links are never gathered in one place.
    """
    edges = ws.table(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )
    seen = None
    while True:
        mark = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).collect()[0]
        if mark == seen or mark["n"] == 0:
            break
        seen = mark
        edges = ws.table(_small_star(_large_star(edges)), "stars", instead_of=edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
