"""Near-duplicate documents by word shingles, on the tiled SimHash comparison.

A document is its set of different shingles. Documents of equal sets, by a 128-bit hash of the sorted set, are one
class. A class's sketch is four SimHash words of the set, and its tile is given by the logarithm of the set's size:
sets of a Jaccard similarity ``s`` have sizes within a factor ``s``, so only a tile and the next one are compared.
There, fingerprints are sorted by population count, blocks beyond the radius are skipped, and the others compared in
full on the first word, then on all 256 bits. This finds candidates only: documents with a partner in reach meet again
with their texts, and every link between classes is verified on the shingles, nearest pairs first, as long as the two
are still apart. Only a spanning forest of links leaves a task, never the pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.linededup import fixed_filter, maybe_in
from millrace.llm.simhash import BLOCK, majority_bits, shingle_hashes
from millrace.llm.workspace import Workspace, release

WORDS = 4
#: Rows of a tile that are compared in one task; a row has 50 bytes.
CHUNK_ROWS = 16_384


@dataclass(frozen=True)
class NearDupParams:
    ngram: int = 5
    similarity: float = 0.8
    miss: float = 1e-5  # share of pairs just at the similarity that each of the two comparisons may lose


def _at_least(n: int) -> np.ndarray:
    """For k of 0 to n + 1, the probability that k or more of n even bits are set."""
    return np.append(np.cumsum([math.comb(n, k) / 2**n for k in range(n, -1, -1)])[::-1], 0.0)


def flip_share(size: int, similarity: float) -> float:
    """The most probable that a majority bit of ``size`` shingles differs from that of as many or more at the similarity."""
    worst = 0.0
    for other in range(size, int(size / similarity + 1e-9) + 1):
        both = math.ceil(similarity * (size + other) / (1 + similarity) - 1e-9)
        if both > size:
            continue
        k, own, theirs = np.arange(both + 1), _at_least(size - both), _at_least(other - both)
        mine = own[np.clip(size // 2 + 1 - k, 0, len(own) - 1)]
        others = theirs[np.clip(other // 2 + 1 - k, 0, len(theirs) - 1)]
        shared = _at_least(both)
        worst = max(worst, float(((shared[:-1] - shared[1:]) * (mine * (1 - others) + others * (1 - mine))).sum()))
    return worst


@lru_cache(maxsize=4096)
def reach(tile: int, params: NearDupParams) -> tuple[int, int]:
    """Differing bits, of the first word and of all, up to which a tile's sets are candidates."""
    s = params.similarity
    sizes = [x for x in range(max(1, int(s**-tile) - 1), int(s ** -(tile + 1)) + 2) if int(math.log(x) / -math.log(s)) == tile] if s**-tile < 64 else []
    if not sizes or sizes[-1] > 64:
        sizes += range(48, 65)  # the share hardly changes with more shingles
    share, found = max(flip_share(x, s) for x in sizes), []
    for bits in (64, 64 * WORDS):
        chance = np.array([math.comb(bits, k) * share**k * (1 - share) ** (bits - k) for k in range(bits + 1)])
        beyond = np.append(np.cumsum(chance[::-1])[::-1][1:], 0.0)
        found.append(int(np.argmax(beyond <= params.miss)))
    return found[0], found[1]


def sketch(text: bytes | None, ngram: int) -> tuple[list[int], int, tuple[int, int]]:
    """Four SimHash words of the different shingles, their number, and a hash of their set in two words."""
    hashes = np.unique(shingle_hashes(text, ngram))
    words = [majority_bits(hashes)]
    for k in range(1, WORDS):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        words.append(majority_bits(x ^ (x >> np.uint64(31))))
    return words, len(hashes), divmod(xxhash.xxh3_128_intdigest(hashes.astype("<u8").tobytes()), 1 << 64)


def similar(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of shingles; 1 of two empty ones."""
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def jaccard(a: bytes | None, b: bytes | None, ngram: int) -> float:
    return similar(np.unique(shingle_hashes(a, ngram)), np.unique(shingle_hashes(b, ngram)))


def _bits(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(1, dtype=np.int64)


def compare_tiles(words: np.ndarray, n_home: int, inside: bool, radius: int, wide: int, ask) -> np.ndarray:
    """Labels of a tile's rows after comparing them with themselves or with its guests.

    Pairs up to ``wide`` that are still apart go to ``ask(labels, i, j, d)`` block by block, which gives the labels back.
    """
    labels = np.arange(len(words))
    home = np.argsort(np.bitwise_count(words[:n_home, 0]), kind="stable")
    others = home if inside else n_home + np.argsort(np.bitwise_count(words[n_home:, 0]), kind="stable")
    left, right = words[home, 0], words[others, 0]
    left_bits, right_bits = (np.bitwise_count(x).astype(np.int64) for x in (left, right))
    step = 256
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        begin = int(np.searchsorted(right_bits, left_bits[at] - radius, "left"))
        end = int(np.searchsorted(right_bits, left_bits[at : at + step][-1] + radius, "right"))
        for to in range(begin, end, BLOCK // step):
            block = right[to : min(end, to + BLOCK // step)]
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ block[None, :]) <= radius)
            i, j = home[i + at], others[j + to]
            if inside:
                once = i < j
                i, j = i[once], j[once]
            if not len(i):
                continue
            d = _bits(words[i] ^ words[j])
            maybe = (d <= wide) & (labels[i] != labels[j])
            if maybe.any():
                labels = ask(labels, i[maybe], j[maybe], d[maybe])
    return labels


def near_duplicate_groups(
    ws: Workspace, docs: DataFrame, id_col: str, text_col: str, params: NearDupParams
) -> tuple[DataFrame, DataFrame]:
    """((doc, place) of each document, (place, first) of each document that is not the first of its group)."""
    p, kind, docs = params, docs.schema[id_col].dataType.simpleString(), ws.settled(docs)
    # the documents' own columns are kept in a struct, so that no name of theirs can clash
    placed = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("place"))
    own = {c: F.col("doc").getField(c) for c in docs.columns}
    source = placed.select(own[id_col].alias("id"), "place", own[text_col].cast("binary").alias("text"))

    names, same = [f"w{k}" for k in range(WORDS)], ["n", "s0", "s1"]

    # ids stay in Arrow: pandas turns integers beside a null into floats, which cannot hold every id
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t, p.ngram) for t in batch.column("text").to_pylist()]
            words = np.array([f[0] for f in found], np.uint64).reshape(-1, WORDS).view(np.int64)
            sets = np.array([f[2] for f in found], np.uint64).reshape(-1, 2).view(np.int64)
            columns = [np.array([f[1] for f in found], np.int64), sets[:, 0], sets[:, 1], *words.T]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("place"), *(pa.array(np.ascontiguousarray(c)) for c in columns)],
                ["id", "place", *same, *names],
            )
        release()

    marked = ws.table(
        source.mapInArrow(run, f"id {kind}, place long, n long, s0 long, s1 long, " + ", ".join(f"{n} long" for n in names)), "sketches"
    )
    earliest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("first")
    classes = ws.table(
        marked.groupBy(*same, *names).agg(earliest).withColumn("node", F.monotonically_increasing_id()), "classes"
    )
    tile = F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(-math.log(p.similarity))).cast("long")
    coded = classes.select("node", tile.alias("tile"), *names)
    sizes = ws.table(coded.groupBy("tile").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks")), "tiles")
    chunks = sizes.select("tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    met = chunks.withColumn("other", F.explode(F.array("tile", F.col("tile") + 1))).join(
        chunks.select(F.col("tile").alias("other"), F.col("chunk").alias("with_chunk")), "other"
    )
    met = ws.table(met.where("other <> tile or with_chunk >= chunk"), "met")
    key = ["tile", "chunk", "other", "with_chunk"]

    dealt = coded.join(F.broadcast(sizes), "tile").withColumn(  # sizes: a row for each logarithm of a size
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    )
    home = dealt.join(met, ["tile", "chunk"]).select(*key, F.lit(False).alias("guest"), "node", *names)
    guests = dealt.withColumnRenamed("tile", "other").withColumnRenamed("chunk", "with_chunk").join(
        met.where("other <> tile or with_chunk <> chunk"), ["other", "with_chunk"]
    )
    pairs = home.unionByName(guests.select(*key, F.lit(True).alias("guest"), "node", *names))

    def unpacked(group: pd.DataFrame):
        group = group.sort_values(["guest", "node"])
        words = np.ascontiguousarray(group[names].to_numpy(np.int64)).view(np.uint64)
        return group, words, int((~group["guest"]).sum()), group["node"].to_numpy(np.int64)

    def released(kernel, group: pd.DataFrame) -> pd.DataFrame:
        out, rows = kernel(group), len(group)
        if rows > 1000:
            release()
        return out

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group, words, n_home, nodes = unpacked(group)
        asked = np.zeros(len(nodes), bool)

        def ask(labels, i, j, d):
            asked[i] = asked[j] = True
            return labels

        compare_tiles(words, n_home, n_home == len(nodes), *reach(int(group["tile"].iat[0]), p), ask)
        return group.loc[asked, [*key, "guest", "node"]]

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group, words, n_home, nodes = unpacked(group)
        texts, known = group.pop("text").tolist(), {}

        def shingles(k: int) -> np.ndarray:
            if k not in known:
                known[k], texts[k] = np.unique(shingle_hashes(texts[k], p.ngram)), None
            return known[k]

        def ask(labels, i, j, d):
            order = np.argsort(d, kind="stable")
            for at in range(0, len(order), 512):
                part = order[at : at + 512]
                for k in part[labels[i[part]] != labels[j[part]]].tolist():
                    a, b = labels[i[k]], labels[j[k]]
                    if a != b and similar(shingles(int(i[k])), shingles(int(j[k]))) >= p.similarity:
                        labels[labels == max(a, b)] = min(a, b)
            return labels

        labels = compare_tiles(words, n_home, n_home == len(nodes), *reach(int(group["tile"].iat[0]), p), ask)
        linked = np.nonzero(labels != np.arange(len(labels)))[0]
        return pd.DataFrame({"a": nodes[linked], "b": nodes[labels[linked]]})

    found = ws.table(
        pairs.groupBy(*key).applyInPandas(
            lambda g: released(compare, g), "tile long, chunk int, other long, with_chunk int, guest boolean, node long"
        ),
        "pairs",
    )
    # documents with a partner in reach meet it again with their texts, and only links leave the task
    texts = _texts(ws, placed, text_col, classes, found.select("node").distinct())
    verified = ws.table(
        found.join(classes.select("node", *names), "node").join(texts, "node").groupBy(*key)
        .applyInPandas(lambda g: released(verify, g), "a long, b long"),
        "verified",
    )
    comps = connected_components(ws, verified)
    grouped = classes.join(comps, "node", "left").select(
        *same, "first", F.coalesce("component", "node").alias("component")
    )
    firsts = grouped.groupBy("component").agg(F.min("first").alias("group_first"))
    named = grouped.join(firsts, "component").select(*same, F.col("group_first.place").alias("first"))
    place = ws.table(marked.join(named, same).select("place", "first").where("place <> first"), "later")
    return placed, place


def _texts(ws: Workspace, placed: DataFrame, text_col: str, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, text) of the asked nodes. Only their texts are shuffled."""
    nodes = ws.table(asked.join(classes.select("node", F.col("first.place").alias("place")), "node"), "asked")
    filter_ = ws.table(fixed_filter(nodes, "place"), "filter")
    text = F.col("doc").getField(text_col).cast("binary").alias("text")
    texts = maybe_in(placed.select("place", text), filter_, "place").where("maybe")
    return ws.table(texts.drop("maybe").join(nodes, "place").select("node", "text"), "texts")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearDupParams = NearDupParams()
) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that of the smallest id, null ids last.

    Null and empty texts have no shingles and are one group; texts of fewer words than a shingle are one shingle;
    equal rows are copies of each other; an empty table gives no rows; other columns stay.
    """
    ws = Workspace(docs.sparkSession, "neardup")
    placed, later = near_duplicate_groups(ws, docs, id_col, text_col, params)
    kept = placed.join(later.select("place"), "place", "left_anti")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
