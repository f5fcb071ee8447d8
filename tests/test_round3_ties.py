import numpy as np

from millrace.operators import search


def test_no_more_than_k_of_equal_scores_leave_a_block(spark):
    assert sorted(search.best_of(np.array([1.0, 2, 1, 3, 1]), 3).tolist()) == [0, 1, 3]
    assert sorted(search.best_of(np.zeros(5000), 3).tolist()) == [0, 1, 2]
    # more queries than a slice has, and copies of each vector; each finds the smallest ids of its copies
    rows = [(i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)]) for i in range(2000, 0, -1)] + [(0, [float("nan"), 1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "v long, embedding array<double>")
    queries = vectors.where("v % 20 = 1").withColumnRenamed("v", "q")
    found: dict = {}
    for r in search.nearest(queries, vectors, "q", "v", 4, same=False).collect():
        found.setdefault(r.q, []).append((r["rank"], r.v, r.score))
    assert len(found) == 100 > search.SLICE_ROWS
    for q, hits in found.items():
        others = [i for i in range(1, 2001) if i % 3 == q % 3 and i != q][:4]
        assert sorted(hits) == [(n + 1, v, 1.0) for n, v in enumerate(others)]
