"""The registered operator queries and the pipeline on the smallest tables."""

import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")

from millrace.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, expected = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rows = lambda df: sorted(map(repr, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(expected)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, DATA).toPandas(), docs.schema)
        assert docs.columns == columns and 0.5 * before < docs.count() <= before, name
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0


def test_near_duplicates_of_whole_table(spark):
    """The near-duplicate stage on all documents, against all pairs that share a shingle."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    root, holders, sets = {}, {}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for doc, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        sets[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}
        root[doc] = doc
        shared = Counter(other for s in sets[doc] for other in holders.get(s, ()))
        for other, both in shared.items():
            if both >= 0.8 * (len(sets[doc]) + len(sets[other]) - both):
                a, b = sorted((find(doc), find(other)))
                root[b] = a
        for s in sets[doc]:
            holders.setdefault(s, []).append(doc)
    kept = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [d for d, _ in rows if find(d) == d]


def test_links_where_there_are_some(spark):
    """The tables have no vectors as near as 0.93; at 0.3 they have links, and groups of them."""
    from millrace.llm import rpforest

    data = DATA.replace("0.001", "0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    expected = sorted(con.sql(rpforest.ORACLE_SQL.replace("0.93", "0.3")).fetchall())
    found = rpforest.embedding_components(spark.read.parquet(f"{data}/embeddings.parquet"), params=rpforest.ForestParams(threshold=0.3))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect())
    assert got == expected and sum(r[1] for r in got) > 200 and max(Counter(r[2] for r in got).values()) > 3
