"""Writers: JSON lines of chunks, reports, fetched documents, and the vector table. All overwrite."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import file_id


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines with nulls written; ``single`` for results of a bounded number of rows."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file through the file system of the path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def write_report(report: DataFrame, path: str, **more) -> dict:
    """A one-row report as indented JSON."""
    row = json.loads(report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
    write_text(report.sparkSession, path, json.dumps(row | more, ensure_ascii=False, indent=2))
    return row | more


def write_fetched(documents: DataFrame, path: str) -> None:
    """Fetched documents by file id, of equal ids the one that comes last in the table."""
    named = documents.select(file_id(F.col("url")).alias("file_id"), F.struct("*").alias("d"), F.monotonically_increasing_id().alias("row"))
    last = named.groupBy("file_id").agg(F.max_by("d", "row").alias("d"))
    last.select("d.*", "file_id").write.mode("overwrite").parquet(path)


def _put(folder: str, name: str, body: bytes) -> None:
    """A file under a folder that all executors reach. It has its name only when it is whole: an attempt writes a file of
    its own and renames it, so a task that is lost leaves none by that name, and one that is repeated writes the same."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    store.create_dir(inner, recursive=True)
    attempt = f"{inner}/_{name}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(attempt) as out:
            out.write(bytes(body))
        store.move(attempt, f"{inner}/{name}")
    except BaseException:
        if store.get_file_info(attempt).type != fs.FileType.NotFound:
            store.delete_file(attempt)
        raise


def write_pdfs(pdfs: DataFrame, folder: str) -> None:
    """``pdfs(file_id, body, ...)`` as files of that name under ``folder``, which all executors reach."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for name, body in zip(batch["file_id"], batch["body"]):
                _put(folder, f"{name}.pdf", body)
            yield pd.DataFrame({"n": [len(batch)]})

    pdfs.select("file_id", "body").mapInPandas(run, "n long").agg(F.sum("n")).collect()  # one number


def write_pdf_metadata(pdfs: DataFrame, folder: str) -> None:
    """What is known of files, ``pdfs(url, title, pdf)``, as JSON lists beside them, one for each partition."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = [dict(zip(("url", "title", "pdf"), r)) for batch in rows for r in batch.itertuples(index=False, name=None)]
        if told:
            _put(folder, f"metadata-{TaskContext.get().partitionId():05d}.json", json.dumps(told, ensure_ascii=False, indent=2).encode())
        yield pd.DataFrame({"n": [len(told)]})

    pdfs.select("url", "title", "pdf").mapInPandas(run, "n long").agg(F.sum("n")).collect()  # one number
