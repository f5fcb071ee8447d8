"""Vectors in lists: exact with all lists, recall with some, pruned folders and pushed filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import vector_lists as L
from millrace.operators.search import nearest


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((24, 16))
    x = centres[rng.integers(0, 24, 3000)] + 0.35 * rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:2000] = x[1000]  # a third of all rows are one vector
    rows = [(i, x[i].tolist(), i % 7 if i % 11 else None, f"p{i % 3}") for i in range(3000)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, publisher string")


def pairs(df):
    return {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in df.collect()}


def metric(df, name):
    """A metric of the scans of a plan that has run."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan") and node.metrics().contains(name):
            total += node.metrics().apply(name).value()
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return total


@pytest.fixture(scope="module")
def index(clustered):
    return L.write_lists(clustered, "vec_id", ("label",), L.ListParams(lists=24, exact_rows=300))


def test_lists_hold_every_row_once(clustered, index):
    assert index.vectors.count() == clustered.count() == index.vectors.select("vec_id").distinct().count()
    assert len(index.centres) <= 24


def test_recall_and_exactness(clustered, index):
    asked = clustered.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = nearest(asked, clustered, "query_id", "vec_id", 10)
    assert pairs(L.search_lists(asked, "query_id", index, 10, 24)) == pairs(exact)
    probes = L.probes_for(index, 10)
    assert probes <= 8  # of 24: the data have clusters
    found = L.search_lists(asked, "query_id", index, 10, probes)
    # of equal vectors any will do, so scores are compared
    scores = lambda df: {(r.query_id, r.rank): round(r.score, 9) for r in df.collect()}
    a, b = scores(found), scores(exact)
    assert np.mean([a.get(key) == value for key, value in b.items()]) >= 0.95
    assert L.recall(exact, exact, "query_id", "vec_id").first().recall == 1
    assert L.recall(exact.limit(0), exact.limit(0), "query_id", "vec_id").first().recall == 1


def test_few_lists_are_read(clustered, index):
    one = clustered.where("vec_id = 50").select(F.col("vec_id").alias("query_id"), "embedding")
    lists = [r.list for r in L.probed_lists(one, index, 2).collect()]
    read = index.vectors.where(F.col("list").isin(lists))
    plan = L.search_lists(one, "query_id", index, 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read.collect()
    index.vectors.collect()
    assert 0 < metric(read, "numFiles") < 0.4 * metric(index.vectors, "numFiles")


@pytest.mark.parametrize("rule", ["label = 3 AND publisher = 'p1'", "label < 2", "label IS NULL", "label <> 5", "label = 99"])
def test_filters_reach_the_scan(clustered, index, rule):
    asked = clustered.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = nearest(asked, clustered.where(rule), "query_id", "vec_id", 5)
    assert pairs(L.search_lists(asked, "query_id", index, 5, 24, F.expr(rule))) == pairs(exact)
    few = clustered.where(rule).count() <= 300
    found = L.search_lists(asked, "query_id", index, 5, 6, F.expr(rule))
    if few:  # whatever the lists
        assert pairs(found) == pairs(exact)
    else:
        assert found.count() > 0 and found.join(clustered, "vec_id").where(f"NOT ({rule})").count() == 0
    scan = index.vectors.where(rule)
    assert "PushedFilters: [" in (plan := scan._jdf.queryExecution().executedPlan().toString()) and "label" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_row_groups_outside_a_filter_are_not_read(spark, clustered, tmp_path):
    """Rows lie in the order of the filter columns, so narrow filters pass over row groups."""
    more = clustered.where("label IS NOT NULL").withColumn("label", (F.col("vec_id") % 100).cast("int"))
    index = L.write_lists(more, "vec_id", ("label",), L.ListParams(lists=2, row_group_bytes=4096))
    few = index.vectors.where("label = 42").select("vec_id")
    few.collect()
    index.vectors.select("vec_id", "label").collect()
    assert few.count() < 60 and metric(few, "numOutputRows") < 0.5 * more.count()


def test_odd_vectors_and_empty_tables(spark, clustered):
    odd = spark.createDataFrame([(1, None, 1), (2, [], 1), (3, [1.0, 0.0], 1), (4, [float("nan"), 1.0], 2), (5, [0.5, None], 2), (6, [0.0, 1.0], None)], "vec_id long, embedding array<float>, label int")
    index = L.write_lists(odd, "vec_id", ("label",), L.ListParams(lists=2))
    assert sorted(r.vec_id for r in index.vectors.collect()) == [1, 2, 3, 4, 5, 6]
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert L.search_lists(asked, "query_id", index, 1, 5).first().vec_id == 3
    empty = L.write_lists(clustered.limit(0), "vec_id")
    assert L.search_lists(asked, "query_id", empty, 1, 1).count() == 0
    with pytest.raises(ValueError):
        L.search_lists(asked, "query_id", index, 0, 1)
