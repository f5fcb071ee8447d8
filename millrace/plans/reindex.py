"""Change detection, and an index of chunks and vectors that is kept up to date by what changed.

An index is a folder of versions. ``documents/version=N`` is a narrow snapshot: of every document its id, content hash and
the version that its chunks were made in. Chunks and vectors are only ever added, ``chunks/version=N`` and
``vectors/version=N`` hold what version N had to make. A chunk is current if the newest snapshot has its document with
its version, so what was changed or went away needs no rewriting; ``compact`` writes current rows anew. ``copies`` has the
number of current chunks of each content hash, kept up by adding and subtracting what changed, and from it follow the
duplicate flags of all chunks. Vectors are named by content hash: text that was embedded once is not embedded again.

A version exists once its file in ``commits`` does, which is written last. What a run that failed has left is written
over by the next, so a run can be repeated at any time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import ChunkingConfig
from millrace.operators.chunking import chunk_documents
from millrace.operators.search import Encoder, embed_chunks
from millrace.plans.tables import Tables
from millrace.sources.writers import write_text

NEW, CHANGED, SAME, GONE = "new", "changed", "same", "gone"


def classify(before: DataFrame, now: DataFrame, id_col: str, hash_col: str = "content_hash") -> DataFrame:
    """(id, change) of each id of either table: new, changed, same or gone, by its content hash. Ids are unique and not
    null in each; null hashes are equal to each other."""
    old = before.select(id_col, F.col(hash_col).alias("__old"), F.lit(True).alias("__was"))
    new = now.select(id_col, F.col(hash_col).alias("__new"), F.lit(True).alias("__is"))
    change = (
        F.when(F.col("__was").isNull(), NEW).when(F.col("__is").isNull(), GONE)
        .when(F.col("__old").eqNullSafe(F.col("__new")), SAME).otherwise(CHANGED)
    )
    return old.join(new, id_col, "full").select(id_col, change.alias("change"))


@dataclass(frozen=True)
class Version:
    number: int
    counts: dict[str, int]  # documents of each change, chunks and vectors made


class DocumentIndex:
    """The versions under ``folder``, a path that the driver and all executors reach."""

    def __init__(
        self, spark: SparkSession, folder: str, id_col: str, config: ChunkingConfig = ChunkingConfig(),
        encoder: Encoder | None = None,
    ):
        self.spark, self.id_col, self.config, self.encoder = spark, id_col, config, encoder
        self.tables = Tables(spark, "index", folder)

    # --- versions ---

    def _files(self, name: str) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.tables.path(name))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        """The numbers of committed versions, in order."""
        return sorted(int(f.partition(".")[0]) for f in self._files("commits") if f.endswith(".json"))

    def _newest(self) -> int:
        return max(self.versions(), default=0)

    def snapshot(self, number: int | None = None) -> DataFrame:
        """(id, content_hash, version) of the documents of a version, by default the newest."""
        number = self._newest() if number is None else number
        return self.tables.read(f"documents/version={number}")

    def _parts(self, name: str, upto: int) -> DataFrame | None:
        """Rows of all committed versions up to one, with their ``version``."""
        have = {int(f.partition("=")[2]) for f in self._files(name) if f.startswith("version=")}
        numbers = [n for n in self.versions() if n <= upto and n in have]
        if not numbers:
            return None
        paths = [self.tables.path(f"{name}/version={n}") for n in numbers]
        return self.spark.read.option("basePath", self.tables.path(name)).parquet(*paths).withColumn("version", F.col("version").cast("long"))

    def chunks(self, number: int | None = None) -> DataFrame:
        """The chunks of a version, with ``is_duplicate``: whether another chunk of it has the same text."""
        number = self._newest() if number is None else number
        made = self._parts("chunks", number)
        current = made.join(self.snapshot(number).select(self.id_col, "version"), [self.id_col, "version"], "left_semi")
        copies = self.tables.read(f"copies/version={number}").where("n > 1").select("content_hash", F.lit(True).alias("is_duplicate"))
        flagged = current.drop("version").join(copies, "content_hash", "left")
        return flagged.withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))

    def vectors(self, number: int | None = None) -> DataFrame:
        """(content_hash, embedding) of the different texts of the chunks of a version."""
        number = self._newest() if number is None else number
        copies = self.tables.read(f"copies/version={number}")
        return self._parts("vectors", number).drop("version").join(copies.select("content_hash"), "content_hash", "left_semi")

    # --- updates ---

    def update(self, documents: DataFrame) -> Version:
        """Make a version of ``documents`` (id, and what ``chunk_documents`` reads), which are all there are now.

        Only documents that are new or changed are chunked, and only texts that no version has are embedded. Hashes
        cover all columns of a document but its id, so a new title counts as a change. Ids are unique and not null.
        """
        before, number = self._newest(), self._newest() + 1
        content = F.sha2(F.to_json(F.struct(*[c for c in documents.columns if c != self.id_col])).cast("binary"), 256)
        now = self.tables.write(documents.select(self.id_col, content.alias("content_hash")), f"working/hashes={number}")
        if now.groupBy(self.id_col).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(self.id_col).isNull()).count():
            raise ValueError("ids of documents must be unique and not null")
        old = self.snapshot(before) if before else now.limit(0).withColumn("version", F.lit(0).cast("long"))
        changes = self.tables.write(classify(old, now, self.id_col), f"working/changes={number}")
        touched = changes.where(F.col("change").isin(NEW, CHANGED)).select(self.id_col)

        fresh = chunk_documents(documents.join(touched, self.id_col, "left_semi"), self.config, keys=(self.id_col,))
        made = self.tables.write(fresh, f"chunks/version={number}")
        kept = old.select(self.id_col, "version").join(changes.where(F.col("change") == SAME).select(self.id_col), self.id_col, "left_semi")
        snapshot = now.join(kept, self.id_col, "left").withColumn("version", F.coalesce("version", F.lit(number).cast("long")))
        self.tables.write(snapshot, f"documents/version={number}")

        deltas = made.select("content_hash", F.lit(1).cast("long").alias("n"))
        if before:
            lost = old.join(changes.where(F.col("change").isin(CHANGED, GONE)).select(self.id_col), self.id_col, "left_semi")
            dropped = self._parts("chunks", before).join(lost.select(self.id_col, "version"), [self.id_col, "version"], "left_semi")
            deltas = deltas.unionByName(dropped.select("content_hash", F.lit(-1).cast("long").alias("n")))
            deltas = deltas.unionByName(self.tables.read(f"copies/version={before}"))
        copies = deltas.groupBy("content_hash").agg(F.sum("n").alias("n")).where("n > 0")
        self.tables.write(copies, f"copies/version={number}")

        texts = made.groupBy("content_hash").agg(F.first("text").alias("text"))
        known = self._parts("vectors", before)
        if known is not None:
            texts = texts.join(known.select("content_hash"), "content_hash", "left_anti")
        embedded = self.tables.write(embed_chunks(texts, self.encoder).drop("text"), f"vectors/version={number}")

        counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
        counts = {c: counts.get(c, 0) for c in (NEW, CHANGED, SAME, GONE)} | {"chunks": made.count(), "vectors": embedded.count()}
        write_text(self.spark, self.tables.path(f"commits/{number}.json"), json.dumps(counts))
        return Version(number, counts)

    def changes(self, number: int | None = None) -> DataFrame:
        """(id, change) of a version against the one before."""
        return self.tables.read(f"working/changes={self._newest() if number is None else number}")

    def compact(self, folder: str) -> "DocumentIndex":
        """The newest version as the first of a new folder, without what is no longer current."""
        out, number = DocumentIndex(self.spark, folder, self.id_col, self.config, self.encoder), self._newest()
        if out.versions():
            raise ValueError("the folder has versions already")
        out.tables.write(self.snapshot().withColumn("version", F.lit(1).cast("long")), "documents/version=1")
        out.tables.write(self.chunks().drop("is_duplicate"), "chunks/version=1")
        out.tables.write(self.vectors(), "vectors/version=1")
        out.tables.write(self.tables.read(f"copies/version={number}"), "copies/version=1")
        out.tables.write(self.snapshot().select(self.id_col, F.lit(NEW).alias("change")), "working/changes=1")
        write_text(self.spark, out.tables.path("commits/1.json"), json.dumps({"compacted": number}))
        return out


def rebuilt(documents: DataFrame, id_col: str, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """What ``DocumentIndex.chunks`` gives, from all documents anew."""
    chunks = chunk_documents(documents, config, keys=(id_col,))
    hashed = chunks.groupBy("content_hash").agg((F.count("*") > 1).alias("is_duplicate"))
    return chunks.join(hashed, "content_hash")

