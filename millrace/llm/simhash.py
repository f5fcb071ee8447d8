"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Distinct fingerprints are dealt into tiles by population count: first of the whole 64 bits, and for larger tables of
each half, quarter or byte, so that tiles keep their size as the table grows. The population counts of two
fingerprints within ``radius`` bits differ by at most ``radius`` in total, so a pair of tiles beyond that is skipped
without losing a link. The remaining tile pairs are compared in full with numpy exclusive-or and bit counts, in
blocks. Of the links of a tile pair a spanning forest is kept, which has fewer rows than the tile.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components, union_labels
from millrace.llm.workspace import Workspace

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows of a tile, elements of one compared block, and the mean rows of a tile that a finer cut should leave.
TILE_ROWS, BLOCK, MEAN_ROWS = 4096, 1 << 18, 512
#: Standard deviations of the population counts of 64 even bits cut in 1, 2, 4 or 8 parts, as numbers of tiles in use.
TILES_IN_USE = {1: 16, 2: 140, 4: 4_700, 8: 1_350_000}


def shingle_hashes(text: bytes | None, ngram: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``ngram`` words; of the whole sequence where there are fewer; none for no words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= ngram:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - ngram or None].tolist(), ends[ngram - 1 :].tolist())],
        np.uint64,
    )


def majority_bits(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: bytes | None, ngram: int = 3) -> int:
    return majority_bits(shingle_hashes(text, ngram))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """(id, fp long) of each row, over whole texts; a null text counts as empty."""

    # ids stay in Arrow: pandas turns integers beside a null into floats, which cannot hold every id
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, ngram) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"id {kind}, fp long")


def _offsets(parts: int, radius: int) -> list[int]:
    """Packed differences of population counts, of ``radius`` in total at most, each pair of tiles once."""
    found = {0}
    for size in range(1, radius + 1):
        for places in itertools.combinations_with_replacement(range(parts), size):
            for signs in itertools.product((1, -1), repeat=size):
                found.add(sum(s << (7 * p) for s, p in zip(signs, places)))
    return sorted(x for x in found if x >= 0)


def _parts(rows: int, radius: int) -> int:
    parts = 1
    for more in (2, 4, 8):
        if radius <= 3 and rows / TILES_IN_USE[more] >= MEAN_ROWS:
            parts = more
    return parts


def linked_blocks(home: np.ndarray, guests: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in home and guests of fingerprints within the radius, block by block."""
    step = max(1, BLOCK // max(1, len(guests)))
    for at in range(0, len(home), step):
        for to in range(0, len(guests), BLOCK):
            near = np.bitwise_count(home[at : at + step, None] ^ guests[None, to : to + BLOCK]) <= radius
            i, j = np.nonzero(near)
            if len(i):
                yield i + at, j + to


def tile_pairs(ws: Workspace, fps: DataFrame, radius: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows of each pair of tiles that has to be compared: (tile, chunk, with_chunk, guest, fp, *carry).

    ``fps`` has distinct ``fp``. A tile of over TILE_ROWS rows is dealt into chunks; every pair of chunks meets.
    """
    rows = fps.count()
    parts = _parts(rows, radius)
    width = 64 // parts
    mask = (1 << width) - 1 if width < 64 else -1
    code = sum(
        (
            F.bit_count(F.shiftrightunsigned("fp", p * width).bitwiseAND(F.lit(mask))).cast("long") * F.lit(1 << (7 * p))
            for p in range(parts)
        ),
        F.lit(0).cast("long"),
    )
    coded = fps.withColumn("tile", code)
    sizes = ws.table(coded.groupBy("tile").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("chunks")), "tiles")
    dealt = coded.join(sizes, "tile").select(
        "tile", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk"), "fp", *carry
    )
    chunks = sizes.select("tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    near = chunks.withColumn("other", F.explode(F.array(*[F.lit(x).cast("long") for x in _offsets(parts, radius)])))
    near = near.withColumn("other", F.col("tile") + F.col("other"))
    met = near.join(
        chunks.select(F.col("tile").alias("other"), F.col("chunk").alias("with_chunk")), "other"
    ).where("other <> tile or with_chunk >= chunk")
    met = ws.table(met, "pairs")
    homes = met.select("tile", "chunk", "with_chunk").distinct()
    own = dealt.join(homes, ["tile", "chunk"]).select(
        "tile", "chunk", "with_chunk", F.lit(False).alias("guest"), "fp", *carry
    )
    guests = met.where("other <> tile or with_chunk <> chunk").join(
        dealt.select(F.col("tile").alias("other"), F.col("chunk").alias("with_chunk"), "fp", *carry),
        ["other", "with_chunk"],
    )
    return own.unionByName(guests.select("tile", "chunk", "with_chunk", F.lit(True).alias("guest"), "fp", *carry))


def hamming_links(ws: Workspace, fps: DataFrame, radius: int) -> DataFrame:
    """(a, b) links between distinct fingerprints that give the same components as all links within the radius."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        values = group["fp"].to_numpy(np.int64).view(np.uint64)
        guest = group["guest"].to_numpy(bool)
        order = np.argsort(guest, kind="stable")
        values, n_home = values[order], int((~guest).sum())
        inside = group["chunk"].iat[0] == group["with_chunk"].iat[0]
        others = values if inside else values[n_home:]
        labels, shift = np.arange(len(values)), len(values) - len(others)
        for i, j in linked_blocks(values[:n_home], others, radius):
            labels = union_labels(labels, i, j + shift)
        signed, linked = values.view(np.int64), np.nonzero(labels != np.arange(len(values)))[0]
        return pd.DataFrame({"a": signed[linked], "b": signed[labels[linked]]})

    pairs = tile_pairs(ws, fps, radius)
    return pairs.groupBy("tile", "chunk", "with_chunk").applyInPandas(run, "a long, b long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, radius: int = 2
) -> DataFrame:
    """(id, fingerprint hex, component_id) of each row: the smallest id reachable over links of fingerprints.

    Null and empty texts have fingerprint zero and link like any other; equal fingerprints always link; rows with a
    repeated id give a row each; a null id keeps its row, and names a component only if no row of it has an id.
    An empty table gives an empty result. Columns besides the two named ones are not read.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    marked = ws.table(fingerprints(docs, id_col, text_col, ngram), "fingerprints")
    classes = ws.table(marked.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    found = connected_components(ws, hamming_links(ws, classes.select("fp"), radius))
    rooted = ws.table(
        classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first", F.coalesce("component", "fp").alias("root")
        ),
        "roots",
    )
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(firsts, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
