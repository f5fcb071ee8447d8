"""Keyword index, fusion and measures of rankings against brute-force versions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import keyword, metrics, trust
from millrace.operators.search import top_k

WORDS = [f"w{i}" for i in range(300)] + ["the", "of", "Éa", "straße"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    common = lambda n: [rng.choice(WORDS[-4:]) if rng.random() < 0.5 else WORDS[min(299, int(rng.expovariate(0.02)))] for _ in range(n)]
    docs = [(i, ", ".join(common(rng.randrange(1, 60)))) for i in range(400)] + [(400, None), (401, ""), (402, "--"), (None, "w1 w2")]
    docs += [(500 + i, docs[7][1]) for i in range(30)]
    queries = [(i, " ".join(common(9)) + " The the") for i in range(12)] + [(20, "unknown words"), (21, None), (22, "of")]
    return docs, queries, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "q int, text string")


def brute_bm25(docs, queries, k, k1=1.2, b=0.75):
    split = lambda t: [w for w in re.split(r"[^\w]+", (t or "").lower()) if w]
    bags = {i: Counter(split(t)) for i, t in docs if i is not None}
    mean = sum(sum(c.values()) for c in bags.values()) / len(bags)
    df = Counter(w for c in bags.values() for w in c)
    out = {}
    for q, text in queries:
        scores = {}
        for i, bag in bags.items():
            size = sum(bag.values())
            parts = [math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * (k1 + 1) / (bag[w] + k1 * (1 - b + b * size / mean)) for w in set(split(text)) if bag[w]]
            if parts:
                scores[i] = round(sum(parts), 6)
        out[q] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
    return {q: found for q, found in out.items() if found}


@pytest.mark.parametrize("k", [1, 5, 600])
def test_bm25_against_all_documents(spark, corpus, k):
    docs, queries, df, asked = corpus
    index = keyword.build_index(df, "doc_id", params=keyword.Bm25(block_rows=32, folders=3))
    expected = brute_bm25(docs, queries, k)
    for skip in (True, False):
        got = {}
        for r in keyword.bm25(asked, "q", index, k, skip=skip).orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append((r.doc_id, r.score))
        assert {q: [d for d, _ in x] for q, x in got.items()} == {q: [d for d, _ in x] for q, x in expected.items()}
        assert all(abs(a - b) < 2e-6 for q in got for (_, a), (_, b) in zip(got[q], expected[q]))


def test_bounds_skip_blocks_and_folders(spark, corpus):
    _, _, df, asked = corpus
    # texts of rare words stand together, so most blocks have none of those of a query
    rare = df.where("doc_id < 400").withColumn("text", F.concat("text", F.lit(" rare"), (F.col("doc_id") / 40).cast("int")))
    index = keyword.build_index(rare.coalesce(1).sortWithinPartitions("doc_id"), "doc_id", params=keyword.Bm25(block_rows=16, folders=8))
    queries = spark.createDataFrame([(q, f"rare{q} of the") for q in range(10)], "q int, text string")
    terms = keyword.with_floors(keyword._query_terms(queries, "q", "text", index), index, 3).withColumn("group", F.col("query"))
    every = terms.withColumn("floor", F.lit(-1.0))
    assert keyword.live_blocks(terms, index).count() < 0.4 * keyword.live_blocks(every, index).count()
    rows = lambda skip: sorted(map(tuple, keyword.bm25(queries, "q", index, 3, skip=skip).collect()))
    assert rows(True) == rows(False) and len(rows(True)) == 30
    # no score is above the bounds of its words
    scored = keyword.bm25(asked, "q", index, 1).select(F.col("q").alias("query"), "score")
    bounds = keyword._query_terms(asked, "q", "text", index).groupBy("query").agg(F.sum("bound").alias("bound"))
    assert scored.join(bounds, "query").where("score > bound + 1e-5").count() == 0
    one = index.postings.where((F.col("folder") == 3) & (F.col("term") == "w5"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(term,w5)" in plan


def test_queries_in_groups(spark, corpus, monkeypatch):
    _, _, df, asked = corpus
    index = keyword.build_index(df, "doc_id", params=keyword.Bm25(block_rows=64))
    whole = sorted(map(tuple, keyword.bm25(asked, "q", index, 4).collect()))
    monkeypatch.setattr(keyword, "GROUP_QUERIES", 4)
    assert sorted(map(tuple, keyword.bm25(asked, "q", index, 4).collect())) == whole


def test_empty_collections(spark, corpus):
    _, _, df, asked = corpus
    index = keyword.build_index(df.limit(0), "doc_id")
    assert keyword.bm25(asked, "q", index, 3).count() == 0
    with pytest.raises(ValueError):
        keyword.bm25(asked, "q", index, 0)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "q int, d int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "q int, d int, rank int")
    got = [(r.q, r.d, r.rank, r.score) for r in keyword.fused([a, b], "q", "d", 2).orderBy("q", "rank").collect()]
    assert got == [(1, 11, 1, round(1 / 62 + 1 / 61, 9)), (1, 10, 2, round(1 / 61, 9)), (2, 10, 1, round(1 / 61, 9))]


def test_measures_of_a_ranking(spark):
    rng = random.Random(2)
    relevance = [(q, d, rng.randrange(4)) for q in range(8) for d in rng.sample(range(40), 12)] + [(0, 1, 3), (9, 5, 1), (10, 5, 0)]
    ranking = [(q, d, r + 1) for q in range(7) for r, d in enumerate(rng.sample(range(40), 25))]
    got = metrics.query_metrics(spark.createDataFrame(ranking, "q int, d int, rank int"), spark.createDataFrame(relevance, "q int, d int, grade int"), "q", "d", 5)
    grades = {}
    for q, d, g in relevance:
        if g > 0:
            grades.setdefault(q, {})[d] = max(g, grades.get(q, {}).get(d, 0))
    expected = {}
    for q, told in grades.items():
        found = [(r, told[d]) for p, d, r in ranking if p == q and d in told]
        gain = lambda pairs: sum((2**g - 1) / math.log2(r + 1) for r, g in pairs)
        ideal = gain(enumerate(sorted(told.values(), reverse=True), 1))
        expected[q] = (sum(r <= 5 for r, _ in found) / len(told), 1 / min(r for r, _ in found) if found else 0, gain(found) / ideal)
    rows = {r.q: tuple(r[c] for c in metrics.MEASURES) for r in got.collect()}
    assert set(rows) == set(expected) and all(math.isclose(a, b, abs_tol=1e-9) for q in rows for a, b in zip(rows[q], expected[q]))
    assert rows[9] == (0, 0, 0)
    assert metrics.mean_metrics(got.limit(0)).first().queries == 0


def test_bootstrap_of_two_rankers(spark):
    rng = random.Random(1)
    rows = [(q, rng.random(), 0.0) for q in range(300)]
    left = spark.createDataFrame([(q, x, 0.0, x) for q, x, _ in rows], "q int, recall double, reciprocal_rank double, ndcg double")
    right = left.withColumn("ndcg", F.col("ndcg") - 0.03 + 0.1 * F.sin("q"))
    once, again = (metrics.paired_bootstrap(left, right.repartition(n), "q").first() for n in (2, 5))
    mean = sum(0.03 - 0.1 * math.sin(q) for q in range(300)) / 300
    assert math.isclose(once.difference, mean, abs_tol=1e-9) and once.low < mean < once.high and once.queries == 300
    assert math.isclose(once.low, again.low) and math.isclose(once.high, again.high)
    # the width of a normal interval of the mean
    assert abs((once.high - once.low) - 2 * 1.96 * 0.1 / math.sqrt(2 * 300)) < 0.004 and once.share_above > 0.95
    other = metrics.paired_bootstrap(left, right, "q", params=metrics.Bootstrap(seed=2)).first()
    assert other.low != once.low


def test_top_k_orders_ties(spark):
    rows = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.5), (1, 1, 0.1)], "q int, d int, score double")
    assert [r.d for r in top_k(rows, "q", "d", 2).orderBy("rank").collect()] == [2, 3]


def test_publishers_and_conflicts(spark):
    u = spark.createDataFrame([("https://x.gov.in/a",), ("http://nic.in:80/",), ("https://notgov.in/",), ("https://s.example.org/x",), ("gov.in",), (None,)], "url string")
    found = u.select(trust.publisher_rank(F.col("url"), trust.Trust(secondary=("example.org",))).alias("r")).collect()
    assert [r.r for r in found] == [0, 0, 2, 1, 2, 2]
    hits = spark.createDataFrame([(1, d, s, p) for d, s, p in [(1, 9.0, 2), (2, 8.0, 0), (3, 7.0, 0), (4, 6.0, 1), (5, 5.0, 2), (6, 4.0, 2)]] + [(2, 1, 3.0, 2)], "q int, d int, score double, publisher_rank int")
    facts = spark.createDataFrame(
        [(1, "A", "limit", "50", 9), (2, "A", "limit", "60", 1), (3, "A", "limit", "70", 2), (4, "A", "limit", "70", None), (5, "A", "limit", None, 9), (4, "B", "due", "May", 1), (6, "B", "due", "May", 2)],
        "d int, thing string, field string, value string, stated_at int",
    )
    got = {(r.q, r.d): (r.rank, r.score, r.supporting, r.conflicting) for r in trust.trusted_ranking(hits, facts, "q", "d", 9).collect()}
    # 3 is primary and later than 2; 1 and 2 say otherwise; 5 states nothing; 4 and 6 agree
    assert got == {(1, 3): (1, 7.0, [4], [1, 2]), (1, 4): (2, 4.8, [6], []), (1, 5): (3, 2.5, [], []), (1, 6): (4, 2.0, [], []), (2, 1): (1, 1.5, [], [])}
