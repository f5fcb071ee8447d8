"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import changepoints, decontam, filteraudit, htmltext, linededup, rpforest, secrets
from millrace.llm.fingerprints import fingerprint_documents
from millrace.llm.htmltext import extract_main_text
from millrace.llm.linededup import dedup_lines
from millrace.llm.packing import PackingParams, pack_documents
from millrace.llm.quality import QualityParams, score_documents
from millrace.llm.rpforest import ForestParams, embedding_components
from millrace.llm.sharding import reshard_documents
from millrace.llm.simhash import simhash_components
from millrace.llm.tokenfile import encode_and_read_back


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 or more between all vectors of a label, and their components."""
    return embedding_components(_table(spark, sf_dir, "embeddings"), params=ForestParams(threshold=0.93))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels of rows that are not held out."""
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), QualityParams())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside windows of 10 words of benchmark items."""
    return decontam.document_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that have an earlier line within one character edit."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_words=5, edit_bound=1, count_cols=True)


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in bit-packed files, in ascending id order, read back from the files."""
    return encode_and_read_back(_table(spark, sf_dir, "documents"), end_id=2)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; the source is both the repository and the owner."""
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return pack_documents(_table(spark, sf_dir, "documents"), params=PackingParams(capacity=4096, end_id=1))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 3-word shingles, links within 2 bits, components of all documents."""
    return simhash_components(_table(spark, sf_dir, "documents"), ngram=3, radius=2)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from 16 old into 24 new shards of near equal sizes."""
    return reshard_documents(_table(spark, sf_dir, "documents"), n_old=16, n_new=24)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages, with the templates of their hosts taken out."""
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op11_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the daily quantities of all vendors."""
    return changepoints.vendor_segments(_table(spark, sf_dir, "sale_lines"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters on all documents, in all their orders, by language."""
    return filteraudit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_forest": op1_embedding_forest,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_file": op5_token_file,
    "op6_secrets": op6_secrets,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_sharding": op9_sharding,
    "op10_html_text": op10_html_text,
    "op11_change_points": op11_change_points,
    "op12_fingerprints": op12_fingerprints,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_forest": rpforest.ORACLE_SQL,
    "op3_decontamination": decontam.ORACLE_SQL,
    "op4_line_dedup": linededup.ORACLE_SQL,
    "op6_secrets": secrets.ORACLE_SQL,
    "op10_html_text": htmltext.ORACLE_SQL,
    "op11_change_points": changepoints.ORACLE_SQL,
    "op13_filter_audit": filteraudit.ORACLE_SQL,
}
