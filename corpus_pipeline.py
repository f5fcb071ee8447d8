"""The corpus pipeline: documents judged, cleaned of repeated lines, near copies and benchmark passages, and packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontam import decontaminate
from millrace.llm.linededup import dedup_lines
from millrace.llm.neardup import NearDupParams, drop_near_duplicates
from millrace.llm.packing import PackingParams, pack_documents
from millrace.llm.quality import QualityParams, fit, held_out, score_column
from millrace.llm.workspace import Workspace


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now; null texts keep theirs."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from labels of rows that are not held out."""
    params = QualityParams()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    weights = fit(docs, labels, params)
    return docs.where(score_column(docs, weights, params) >= params.threshold)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats, up to one edit, go; so do documents that have no other lines."""
    return _counted(dedup_lines(docs, min_words=5, edit_bound=1, drop_emptied=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 5-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, params=NearDupParams(ngram=5, similarity=0.8))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 10 or more words of benchmark items are cut out; documents that are mostly such runs go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _counted(decontaminate(docs, benchmark, window=10, max_coverage=0.5))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 4096 ids."""
    return pack_documents(docs.select("doc_id", "text"), params=PackingParams(capacity=4096, end_id=1))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, the sketches and the packing have no equivalent in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again as the next stage's input."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
