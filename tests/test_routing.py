"""Routes of questions: accuracy and rejections."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import routing
from millrace.operators.search import HashingEncoder


def questions(rng, topics, n, noise=0.3):
    common = [f"c{i}" for i in range(12)]
    out = []
    for i in range(n):
        topic = rng.choice(sorted(topics))
        out.append((i, " ".join(rng.choice(common) if rng.random() < noise else rng.choice(topics[topic]) for _ in range(10)), topic))
    return out


def encoded(spark, rows):
    vectors = HashingEncoder(128).encode([t for _, t, _ in rows])
    return spark.createDataFrame([(i, [float(x) for x in v], label) for (i, _, label), v in zip(rows, vectors)], "id int, embedding array<float>, label string")


def test_accuracy_and_rejections(spark):
    rng = random.Random(4)
    topics = {t: [f"{t}{i}" for i in range(15)] for t in ("database", "knowledge", "hybrid")}
    router = routing.fit_router(encoded(spark, questions(rng, topics, 900)), "id")
    assert router.labels == ("database", "hybrid", "knowledge")
    asked = questions(rng, topics, 300)
    got = {r.id: r for r in routing.route(encoded(spark, asked), router).collect()}
    accepted = [(got[i].route, label) for i, _, label in asked if got[i].route in topics]
    assert np.mean([a == b for a, b in accepted]) >= 0.95 and len(accepted) >= 0.85 * len(asked)
    strange = questions(rng, {"x": [f"other{i}" for i in range(200)]}, 200, noise=0.0)
    routes = [r.route for r in routing.route(encoded(spark, strange), router).collect()]
    assert np.mean([r in (routing.UNSUPPORTED, routing.CLARIFICATION) for r in routes]) >= 0.9
    between = [(i, " ".join(rng.sample(topics["database"], 5) + rng.sample(topics["knowledge"], 5)), "x") for i in range(100)]
    unsure = [r.route for r in routing.route(encoded(spark, between), router).collect()]
    assert np.mean([r in topics for r in unsure]) < np.mean([r.route in topics for r in got.values()])


def test_overlapping_classes_are_rejected_more(spark):
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(15)]
    topics = {"a": shared + ["a1", "a2"], "b": shared + ["b1", "b2"]}
    rows = encoded(spark, questions(rng, topics, 800))
    strict = routing.fit_router(rows, "id", routing.RouteParams(accuracy=0.97))
    loose = routing.fit_router(rows, "id", routing.RouteParams(accuracy=0.5))
    assert strict.least_margin > loose.least_margin == 0.0
    asked = encoded(spark, questions(rng, topics, 300))
    rate = lambda r: routing.route(asked, r).where(F.col("route").isin("a", "b"))
    assert rate(strict).count() < rate(loose).count()
    right = lambda df: df.where("route = label").count() / max(1, df.count())
    assert right(rate(strict)) > right(rate(loose))


def test_odd_questions(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, None, "a"), (4, [], "b"), (5, [1.0, 1.0], None)] + [(10 + k, [1.0, 0.1 * k], "a") for k in range(9)] + [(30 + k, [0.1 * k, 1.0], "b") for k in range(9)], "id int, embedding array<float>, label string")
    router = routing.fit_router(rows, "id")
    got = {r.id: r.route for r in routing.route(rows, router).collect()}
    assert got[3] == got[4] == routing.UNSUPPORTED and len(got) == rows.count()
    assert {got[i] for i in (1, *range(10, 19))} <= {"a", routing.UNSUPPORTED, routing.CLARIFICATION} and "a" in got.values()
    with pytest.raises(ValueError):
        routing.fit_router(rows.limit(0), "id")
