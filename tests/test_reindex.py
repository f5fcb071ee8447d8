"""An index kept up to date by changes against a full rebuild."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.config import ChunkingConfig
from millrace.operators.search import HashingEncoder
from millrace.plans import reindex
from millrace.plans.reindex import DocumentIndex, classify, rebuilt

CONFIG = ChunkingConfig(chunk_size=20, chunk_overlap=4, min_words=3)
KIND = "id long, url string, title string, text string"


class Counting(HashingEncoder):
    """Writes down how many texts it has seen, in a folder, since tasks run elsewhere."""

    def __init__(self, folder):
        super().__init__(16)
        self.folder = str(folder)

    def encode(self, texts, **options):
        with open(f"{self.folder}/seen", "a") as out:
            out.write("".join("x" for _ in texts))
        return super().encode(texts, **options)

    def seen(self):
        with open(f"{self.folder}/seen") as f:
            return len(f.read())


def corpus(rng, n):
    words = [f"w{i}" for i in range(50)]
    say = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(4, 14))) for _ in range(rng.randrange(1, 8)))
    rows = {i: (f"https://a/{i}", f"t{i % 4}", say()) for i in range(n)}
    for i in range(0, n, 6):  # copies
        rows[i] = (rows[i][0], rows[i][1], rows[1][2])
    return rows, say


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in rows.items()], KIND)


def same_rows(a, b):
    columns = sorted(a.columns)
    return sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


def test_versions_equal_full_rebuilds(spark, tmp_path):
    rng = random.Random(9)
    rows, say = corpus(rng, 60)
    encoder = Counting(tmp_path)
    index = DocumentIndex(spark, f"file://{tmp_path}/index", "id", CONFIG, encoder)
    first = index.update(frame(spark, rows))
    assert first.number == 1 and first.counts["new"] == 60 and first.counts["same"] == 0
    made = encoder.seen()
    for step in range(3):
        old = dict(rows)
        for i in rng.sample(sorted(rows), 5):
            del rows[i]
        for i in rng.sample(sorted(rows), 6):
            rows[i] = (*rows[i][:2], say() if step else rows[1][2])
        title = rng.choice([i for i in rows if rows[i] == old[i]])
        rows[title] = (rows[title][0], "another title", rows[title][2])
        rows |= {100 + 10 * step + k: (f"https://b/{step}/{k}", "t", say()) for k in range(4)}
        docs = frame(spark, rows)
        version = index.update(docs)
        expected = {
            "new": len(set(rows) - set(old)), "gone": len(set(old) - set(rows)),
            "changed": sum(rows[i] != old[i] for i in set(rows) & set(old)), "same": sum(rows[i] == old[i] for i in set(rows) & set(old)),
        }
        assert {c: version.counts[c] for c in expected} == expected
        assert same_rows(index.chunks(), rebuilt(docs, "id", CONFIG))
        hashes = {r.content_hash for r in index.chunks().collect()}
        vectors = index.vectors().collect()
        assert len(vectors) == len(hashes) == len({r.content_hash for r in vectors})
        assert encoder.seen() - made == version.counts["vectors"] < 0.6 * len(hashes)  # only what is new was embedded
        made = encoder.seen()
    text = index.chunks().limit(1).collect()[0]
    vector = next(r.embedding for r in index.vectors().collect() if r.content_hash == text.content_hash)
    assert np.allclose(vector, HashingEncoder(16).encode([text.text])[0])
    assert index.versions() == [1, 2, 3, 4] and same_rows(index.chunks(1).select("id").distinct(), frame(spark, {i: r for i, r in corpus(random.Random(9), 60)[0].items()}).select("id"))
    whole = index.compact(f"file://{tmp_path}/whole")
    assert same_rows(whole.chunks(), index.chunks()) and same_rows(whole.vectors(), index.vectors())
    rows[1] = (*rows[1][:2], "new text of it all.")
    assert whole.update(frame(spark, rows)).counts["changed"] == 1 and same_rows(whole.chunks(), rebuilt(frame(spark, rows), "id", CONFIG))


def test_a_run_that_failed_is_repeated(spark, tmp_path, monkeypatch):
    rows, say = corpus(random.Random(2), 12)
    index = DocumentIndex(spark, f"file://{tmp_path}/index", "id", CONFIG)
    index.update(frame(spark, rows))
    before = index.chunks().collect()
    rows[3] = (*rows[3][:2], say())

    def broken(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(reindex, "embed_chunks", broken)
        with pytest.raises(OSError):
            index.update(frame(spark, rows))
    assert index.versions() == [1] and sorted(index.chunks().collect()) == sorted(before)
    rows[4] = (*rows[4][:2], say())
    assert index.update(frame(spark, rows)).counts["changed"] == 2
    assert same_rows(index.chunks(), rebuilt(frame(spark, rows), "id", CONFIG))


def test_nothing_changed_and_everything_went(spark, tmp_path):
    rows, _ = corpus(random.Random(3), 8)
    index = DocumentIndex(spark, f"file://{tmp_path}/index", "id", CONFIG)
    index.update(frame(spark, rows))
    again = index.update(frame(spark, rows).repartition(3))
    assert again.counts == {"new": 0, "changed": 0, "same": 8, "gone": 0, "chunks": 0, "vectors": 0}
    assert index.update(frame(spark, rows).limit(0)).counts["gone"] == 8
    assert index.chunks().count() == index.vectors().count() == 0
    assert index.chunks(2).count() == rebuilt(frame(spark, rows), "id", CONFIG).count()


def test_classes_of_nulls_and_repeated_ids(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "id int, content_hash string")
    new = spark.createDataFrame([(1, "a"), (2, None), (3, None), (5, "e")], "id int, content_hash string")
    assert sorted(map(tuple, classify(old, new, "id").collect())) == [(1, "same"), (2, "same"), (3, "changed"), (4, "gone"), (5, "new")]
    index = DocumentIndex(spark, f"file://{tmp_path}/index", "id", CONFIG)
    docs = frame(spark, {1: ("u", "t", "a b c d")})
    with pytest.raises(ValueError):
        index.update(docs.unionByName(docs))
    with pytest.raises(ValueError):
        index.update(docs.withColumn("id", F.lit(None).cast("long")))
    assert index.versions() == []
