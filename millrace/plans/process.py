"""Plans over folders: documents to chunk files, and chunk files to an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import ChunkingConfig
from millrace.operators import quality as Q
from millrace.operators.chunking import chunk_documents
from millrace.operators.search import Encoder, embed_chunks, manifest
from millrace.plans import kept
from millrace.sources import readers as R
from millrace.sources import writers as W

#: Ids of invalid chunks that a report lists itself, like a page of them; its file of ids has all.
LISTED = 10_000


def process_documents(
    spark: SparkSession, input_folder: str, output_folder: str, config: ChunkingConfig = ChunkingConfig(),
    pdf_reader: R.PdfReader | None = None, embedding_model: str = "hashing",
) -> dict:
    """Read, chunk and evaluate a folder; writes all chunks, the ready ones, a sample and the report."""
    docs = R.read_documents(spark, input_folder, pdf_reader)
    chunks_path = f"{output_folder}/chunks_table"
    chunk_documents(docs, config, keys=("ord",)).write.mode("overwrite").parquet(chunks_path)
    chunks = spark.read.parquet(chunks_path)
    order = ["ord", "chunk_index"]
    # judged once for its several uses, without the texts: whether one is empty is all that the checks need of it
    narrow = chunks.withColumn("text", F.substring("text", 1, 1)).drop("section", "section_index", "page_number", "ord")
    issues = kept(Q.chunk_issues(narrow, config))
    ready = Q.ready_chunks(chunks, issues)
    sample = Q.inspection_sample(chunks, order)
    for df, name in ((chunks, R.CHUNKS), (ready, R.READY)):
        W.write_jsonl(df.orderBy(*order).drop("ord"), f"{output_folder}/{name}")
    W.write_jsonl(sample.orderBy("sample_position").drop("ord", "sample_position"), f"{output_folder}/{R.INSPECTION}", single=True)
    invalid = Q.invalid_ids(issues)
    W.write_jsonl(invalid.orderBy("chunk_id"), f"{output_folder}/{R.INVALID}")  # all of them
    report = Q.quality_report(issues, config, embedding_model)
    totals = report.first()
    bad = [r[0] for r in invalid.orderBy("chunk_id").limit(LISTED).collect()]
    return W.write_report(
        report, f"{output_folder}/{R.EVALUATION}", invalid_chunk_ids=bad, invalid_ids_file=f"{output_folder}/{R.INVALID}",
        invalid_chunk_ids_are_all=totals["invalid_chunks"] <= LISTED, ready_chunks=totals["valid_chunks"],
        chunks_file=f"{output_folder}/{R.CHUNKS}", ready_chunks_file=f"{output_folder}/{R.READY}",
        inspection_file=f"{output_folder}/{R.INSPECTION}", inspection_sample_size=min(25, chunks.count()),
    )


def build_index(
    spark: SparkSession, chunks_path: str, output_folder: str, encoder: Encoder | None = None,
    embedding_model: str = "hashing", batch_size: int = 32,
) -> dict:
    """Embed the ready chunks and write the index; returns the manifest."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    chunks = R.read_ready_chunks(spark, chunks_path)
    if chunks.isEmpty():
        raise ValueError("there are no chunks to embed")
    target = f"{output_folder}/chunks_index"
    embed_chunks(chunks, encoder, batch_size).sortWithinPartitions("position").write.mode("overwrite").parquet(target)
    index = spark.read.parquet(target)
    W.write_jsonl(index.select(*R.METADATA_FIELDS, "position").orderBy("position"), f"{output_folder}/{R.METADATA}")
    facts = manifest(index, chunks_path, embedding_model, target, f"{output_folder}/{R.METADATA}")
    return W.write_report(facts, f"{output_folder}/manifest.json")


def load_index(spark: SparkSession, output_folder: str) -> tuple[DataFrame, dict]:
    """(vectors with metadata, manifest)."""
    row = spark.read.option("multiLine", True).json(f"{output_folder}/manifest.json").first().asDict()
    return spark.read.parquet(f"{output_folder}/chunks_index").withColumn("position", F.col("position").cast("long")), row
