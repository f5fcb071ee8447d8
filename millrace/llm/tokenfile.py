"""Token files: every id in the fewest bits that the vocabulary needs, in blocks, with an index at the end.

Layout of a file, all numbers little-endian: the packed blocks, each of ``block_ids`` ids (the last one may have
fewer) in ``bits`` bits from the lowest bit up, padded to a byte; then the byte offset of each block (u64); then for
each document its id (i64), a mark for a null id (u8), its first id's number in the file (u64) and its count of ids
(u64); then a trailer of fixed size. A reader takes the trailer, and can then unpack any block or document alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.tokens import default_tokenizer, text_encoder
from millrace.llm.workspace import Workspace, release

MAGIC, BLOCK_IDS = b"MRFB0001", 1 << 16
FILE_ROW = pa.schema([("part", pa.int32()), ("path", pa.string()), ("ids", pa.int64()), ("docs", pa.int64())])
TRAILER = struct.Struct("<8sIIQQQQ")  # magic, bits, ids of a block, ids, documents, blocks, start of the index


def id_bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing from the lowest bit up."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def open_fs(path: str):
    """(file system, path in it) of a URI that the driver and all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class TokenFileWriter:
    """Writes one file in a single pass; at most a block of ids is held."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.offsets, self.held, self.n_held, self.n_ids, self.at = array("Q"), [], 0, 0, 0
        self.docs = (array("q"), array("B"), array("Q"), array("Q"))  # id, whether it is null, first id, count of ids

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for column, value in zip(self.docs, (0 if doc_id is None else doc_id, doc_id is None, self.n_ids, len(ids))):
            column.append(value)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            ready = np.concatenate(self.held)
            whole = len(ready) // self.block_ids * self.block_ids
            for k in range(0, whole, self.block_ids):
                self._block(ready[k : k + self.block_ids])
            self.held, self.n_held = [ready[whole:]], len(ready) - whole

    @property
    def n_docs(self) -> int:
        return len(self.docs[0])

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        for values, kind in zip((self.offsets, *self.docs), ("<u8", "<i8", "u1", "<u8", "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(
            TRAILER.pack(MAGIC, self.bits, self.block_ids, self.n_ids, self.n_docs, len(self.offsets), self.at)
        )


class TokenFile:
    """Random access to one file; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - TRAILER.size)
        magic, self.bits, self.block_ids, self.n_ids, n_docs, n_blocks, self.index_at = TRAILER.unpack(
            source.read(TRAILER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(self.index_at)
        data, at, parts = source.read(end - TRAILER.size - self.index_at), 0, []
        for kind, count in (("<u8", n_blocks), ("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u8", n_docs)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        self.offsets, self.doc_ids, self.is_null, self.starts, self.counts = parts

    def block(self, k: int) -> np.ndarray:
        begin = int(self.offsets[k])
        end = int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else self.index_at
        self.source.seek(begin)
        count = min(self.block_ids, self.n_ids - k * self.block_ids)
        return unpack(self.source.read(end - begin), count, self.bits)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids by position; only the blocks that hold them are read."""
        if not count:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (start + count - 1) // self.block_ids
        found = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return found[start - first * self.block_ids :][:count]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.counts[i]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) in file order; each block is read once."""
        held, held_at, following = np.empty(0, np.uint32), 0, 0
        for doc_id, null, start, count in zip(
            self.doc_ids.tolist(), self.is_null.tolist(), self.starts.tolist(), self.counts.tolist()
        ):
            parts = [held[start - held_at :]]
            have = len(parts[0])
            while have < count:
                parts.append(self.block(following))
                following += 1
                have += len(parts[-1])
            held, held_at = np.concatenate(parts) if len(parts) > 1 else parts[0], start
            yield (None if null else doc_id), start, held[:count]


@dataclass(frozen=True)
class TokenFiles:
    """Files in ascending order of document id: (path, ids before it, ids, documents)."""

    files: tuple[tuple[str, int, int, int], ...]


def write_token_files(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    end_id: int = 2,
) -> TokenFiles:
    """Encode whole texts and write them under ``folder``, which all executors share, in ascending id order.

    Rows are dealt by ranges of the id, with the place in the input to part equal ids, so no task holds more than
    its range. Each attempt of a task writes a file of its own name; only those of attempts that Spark accepted are
    listed, and the others are removed. Ids are 64-bit integers; an id that cannot be read as one is taken as null; null ids
    come first; null texts are empty; an empty table gives no files.
    """
    path = tokenizer or default_tokenizer()
    bits = id_bits(max(text_encoder(path).vocabulary, end_id + 1))

    # batches of Arrow, since pandas turns integers beside a null into floats, which cannot hold every id
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = text_encoder(path), np.array([end_id], np.uint32)
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.mrfb"
        writer = out = None
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if writer is None:
                    fs, inner = open_fs(name)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(inner)
                    writer = TokenFileWriter(out, bits)
                ids = np.frombuffer(encoder.encode(text), "<u4")
                writer.add(doc_id, np.concatenate((ids, end)))
        if writer is not None:
            writer.close()
            out.close()
            row = {"part": part, "path": name, "ids": writer.n_ids, "docs": writer.n_docs}
            yield pa.RecordBatch.from_pylist([row], FILE_ROW)
        release()  # but not of the words, which are bounded, and would each be encoded again by every task

    placed = docs.select(
        F.col(id_col).try_cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("place"),
    )
    ordered = placed.repartitionByRange("id", "place").sortWithinPartitions("id", "place").select("id", "text")
    found = ordered.mapInArrow(run, "part int, path string, ids long, docs long").collect()  # a row for each file
    files, before = [], 0
    for row in sorted(found, key=lambda r: r["part"]):
        files.append((row["path"], before, row["ids"], row["docs"]))
        before += row["ids"]
    _remove_others(folder, {f[0].rpartition("/")[2] for f in files})
    return TokenFiles(tuple(files))


def _remove_others(folder: str, keep: set[str]) -> None:
    from pyarrow import fs as pafs

    fs, inner = open_fs(folder)
    for info in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
        if info.base_name.endswith(".mrfb") and info.base_name not in keep:
            fs.delete_file(info.path)


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; a task reads one file, by blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, before in zip(batch["path"], batch["before"]):
                fs, inner = open_fs(path)
                with fs.open_input_file(inner) as source:
                    rows = []
                    for doc_id, start, ids in TokenFile(source).documents():
                        rows.append((doc_id, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 10_000:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    listed = spark.createDataFrame([(f[0], f[1]) for f in files.files], "path string, before long")
    return listed.repartition(max(1, len(files.files))).mapInPandas(run, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*rows)) or [(), (), (), ()]
    frame = pd.DataFrame({"doc_id": pd.array(columns[0], "Int64")})
    for name, values in zip(("start", "n_tokens", "ids_crc32"), columns[1:]):
        frame[name] = np.array(values, np.int64)
    return frame


def encode_and_read_back(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back; one row for each document."""
    ws = Workspace(docs.sparkSession, "tokenfile")
    files = write_token_files(docs, ws.path("files"), tokenizer=tokenizer, end_id=end_id)
    return read_token_files(docs.sparkSession, files)
