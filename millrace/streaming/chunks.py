"""Chunking as a stream: cleaning, sections and packing keep no state, so new documents flow through as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.config import ChunkingConfig
from millrace.operators.chunking import chunk_documents


def chunk_stream(documents: DataFrame, config: ChunkingConfig = ChunkingConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of a streaming DataFrame of documents."""
    return chunk_documents(documents, config, keys)


def new_content(documents: DataFrame, time_col: str, delay: str = "1 day", text_col: str = "text") -> DataFrame:
    """Documents whose content has not come within ``delay``, by a watermark, so the state stays bounded."""
    hashed = documents.withColumn("content_hash", F.sha2(F.col(text_col).cast("binary"), 256))
    return hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["content_hash"])


def write_chunks(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append chunks as Parquet, exactly once, all that is there now."""
    return (
        chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
