"""Best-fit packing of documents into sequences with a grouping genetic algorithm.

Pieces are dealt into blocks of bounded size. For each block several islands evolve populations of packings, each
island as a task of its own. The first island begins with best fit by descending length, the others with best fit of
disturbed orders only. A crossover injects whole well-filled bins of one parent into the other, removes the bins that
hold an injected piece, and best-fits the displaced pieces, longest first. An island goes on as long as fewer or fuller
bins are possible. Between epochs each island sends its elite to the next. The bins
of a block's best packing that stay under ``FILLED`` are opened again and their pieces go to the next round, in a
sixteenth of the blocks or as many as they need, until one block is left or hardly any bin can be filled; so what
stays unfilled is a few bins in all, not in each block.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import default_tokenizer, text_encoder
from millrace.llm.workspace import Workspace, release


@dataclass(frozen=True)
class PackingParams:
    capacity: int = 4096
    end_id: int = 1
    block_pieces: int = 2000  # mean pieces of a block
    islands: int = 2
    epochs: int = 2
    population: int = 3
    generations: int = 4
    filled: float = 0.998  # bins under this share of the capacity are opened again in the next round
    seed: int = 7


def best_fit(lengths: np.ndarray, pieces: np.ndarray, bins: list[list[int]], loads: list[int], capacity: int) -> None:
    """Put each piece, longest first, into the fullest bin that has room, or into a new one. Changes bins and loads."""
    room = sorted((capacity - load, k) for k, load in enumerate(loads))
    for piece in pieces[np.argsort(-lengths[pieces], kind="stable")].tolist():
        need = int(lengths[piece])
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, len(bins)
            bins.append([])
            loads.append(0)
        bins[k].append(piece)
        loads[k] += need
        if left > need:
            insort(room, (left - need, k))


def fitness(loads: list[int], capacity: int) -> float:
    """Mean square fill: fewer and fuller bins score higher."""
    fill = np.asarray(loads) / capacity
    return float((fill * fill).mean()) if len(fill) else 1.0


def _bins_of(owner: np.ndarray) -> list[list[int]]:
    order = np.argsort(owner, kind="stable")
    return [part.tolist() for part in np.split(order, np.nonzero(np.diff(owner[order]))[0] + 1)] if len(owner) else []


def _owner_of(bins: list[list[int]], n: int) -> np.ndarray:
    owner = np.zeros(n, np.int32)
    for k, members in enumerate(bins):
        owner[members] = k
    return owner


def crossover(
    lengths: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng: np.random.Generator
) -> np.ndarray:
    """A child of two packings (the bin of each piece)."""
    father_loads = np.bincount(father, lengths)
    full = np.nonzero(father_loads >= 0.99 * capacity)[0]
    if not len(full):
        full = np.argsort(-father_loads)[: max(1, len(father_loads) // 10)]
    taken = rng.choice(full, max(1, len(full) // 2), replace=False)
    injected = np.isin(father, taken)
    hit = np.unique(mother[injected])
    displaced = np.nonzero(np.isin(mother, hit) & ~injected)[0]
    keep = ~np.isin(mother, hit) & ~injected
    bins = [members for members in _bins_of(np.where(keep, mother, -1)) if keep[members[0]]]
    bins += [np.nonzero(father == k)[0].tolist() for k in taken]
    # the emptiest bins are opened as well, so that their pieces can move
    loads = [int(lengths[m].sum()) for m in bins]
    weak = [k for k, load in enumerate(loads) if load < 0.97 * capacity]
    if weak:
        displaced = np.concatenate([displaced, *(np.array(bins[k]) for k in weak)])
        bins, loads = ([x for k, x in enumerate(y) if k not in set(weak)] for y in (bins, loads))
    displaced = displaced.astype(np.int64)
    if rng.random() < 0.5:  # longest first, or in an order that is disturbed a little
        best_fit(lengths, displaced, bins, loads, capacity)
    else:
        order = np.argsort(-(lengths[displaced] * rng.uniform(0.6, 1.4, len(displaced))), kind="stable")
        for part in np.array_split(displaced[order], 8):
            best_fit(lengths, part, bins, loads, capacity)
    return _owner_of(bins, len(lengths))


def first_population(
    lengths: np.ndarray, params: PackingParams, rng: np.random.Generator, island: int = 0
) -> list[np.ndarray]:
    """On the first island one packing by best fit of descending length; the others by lengths disturbed at random."""
    found = []
    for k in range(params.population):
        bins, loads = [], []
        if k == 0 and island == 0:
            best_fit(lengths, np.arange(len(lengths)), bins, loads, params.capacity)
        else:
            order = np.argsort(-(lengths * rng.uniform(0.7, 1.3, len(lengths))), kind="stable")
            for part in np.array_split(order, 4):
                best_fit(lengths, part, bins, loads, params.capacity)
        found.append(_owner_of(bins, len(lengths)))
    return found


def score(lengths: np.ndarray, owner: np.ndarray, capacity: int) -> float:
    loads = np.bincount(owner, lengths) if len(owner) else np.empty(0)
    return fitness(loads[loads > 0], capacity)


def best_score(lengths: np.ndarray, capacity: int) -> float:
    """No packing scores higher: all bins full but for the last."""
    total = int(lengths.sum())
    bins = -(-total // capacity)
    return (bins - 1 + ((total - (bins - 1) * capacity) / capacity) ** 2) / bins if bins else 1.0


def evolve(
    lengths: np.ndarray, population: list[np.ndarray], params: PackingParams, rng: np.random.Generator
) -> tuple[list[np.ndarray], int, int]:
    """(population after some generations on one island, crossovers, those whose child was the best so far).

    The best come first, and the best is never lost. A packing that another one equals in score goes, but for one.
    """
    goal = best_score(lengths, params.capacity) - 1e-12
    ranked = sorted(((-score(lengths, o, params.capacity), k, o) for k, o in enumerate(population)), key=lambda r: r[:2])
    crossovers = better = 0
    for turn in range(params.generations):
        if len(ranked) < 2 or -ranked[0][0] >= goal:
            break
        pair = rng.choice(len(ranked), 2, replace=False).tolist()
        child = crossover(lengths, ranked[pair[0]][2], ranked[pair[1]][2], params.capacity, rng)
        value = -score(lengths, child, params.capacity)
        crossovers += 1
        better += value < ranked[0][0] - 1e-12
        if any(abs(value - r[0]) < 1e-12 for r in ranked):
            continue
        ranked = sorted([*ranked, (value, len(population) + turn, child)], key=lambda r: r[:2])[: params.population]
    return [o for *_, o in ranked], crossovers, better


def _pack_round(
    ws: Workspace, pieces: DataFrame, n_blocks: int, round_: int, params: PackingParams, report: list | None = None
) -> DataFrame:
    """(key, length, block, bin, load, offset) of each piece after the islands of its block have evolved."""
    islands, seed = params.islands, params.seed

    def rng_of(block: int, island: int, epoch: int) -> np.random.Generator:
        return np.random.default_rng([seed, round_, int(block), int(island), epoch])

    def start(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        lengths = group["length"].to_numpy(np.int64)
        block, island = int(group["block"].iat[0]), int(group["island"].iat[0])
        rng = rng_of(block, island, 0)
        found = evolve(lengths, first_population(lengths, params, rng, island), params, rng)
        return pd.DataFrame([_state(block, island, group["key"].to_numpy(np.int64), lengths, found, params)])

    def again(epoch: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for r in batch.itertuples():
                    lengths = np.frombuffer(r.lengths, np.int64)
                    owners = [o.copy() for o in np.frombuffer(r.owners, np.int32).reshape(-1, len(lengths))]
                    if r.migrant is not None:
                        owners.append(np.frombuffer(r.migrant, np.int32).copy())
                    found = evolve(lengths, owners, params, rng_of(r.block, r.island, epoch))
                    keys = np.frombuffer(r.keys, np.int64)
                    rows.append(_state(r.block, r.island, keys, lengths, found, params, (r.crossovers, r.better)))
                yield pd.DataFrame(rows, columns=names)

        return run

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                keys, lengths = np.frombuffer(r.keys, np.int64), np.frombuffer(r.lengths, np.int64)
                owner = np.frombuffer(r.elite, np.int32)
                order = np.argsort(owner, kind="stable")
                ends = np.cumsum(lengths[order])
                loads = np.bincount(owner, lengths).astype(np.int64)
                before = np.concatenate(([0], np.cumsum(loads)))
                yield pd.DataFrame({
                    "key": keys[order], "length": lengths[order], "block": r.block, "bin": owner[order].astype(np.int64),
                    "load": loads[owner[order]], "offset": ends - lengths[order] - before[owner[order]],
                })

    names = ["block", "island", "keys", "lengths", "owners", "elite", "score", "crossovers", "better"]
    state = (
        "block long, island int, keys binary, lengths binary, owners binary, elite binary, score double, crossovers long, better long"
    )
    dealt = pieces.select(
        "key", "length", F.pmod(F.xxhash64("key", F.lit(round_)), F.lit(n_blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
    )
    states = ws.table(dealt.groupBy("block", "island").applyInPandas(start, state), "islands")
    for epoch in range(1, params.epochs):
        elites = states.select(
            "block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("migrant")
        )
        met = states.drop("elite", "score").join(elites, ["block", "island"], "left")
        states = ws.table(met.repartition("block", "island").mapInPandas(again(epoch), state), "islands", instead_of=states)
    if report is not None:
        report.append(states.agg(F.sum("crossovers"), F.sum("better")).first())  # two numbers
    best = states.groupBy("block").agg(F.max_by(F.struct("keys", "lengths", "elite"), "score").alias("b"))
    return best.select("block", "b.*").mapInPandas(
        unfold, "key long, length long, block long, bin long, load long, offset long"
    )


def _state(block, island, keys, lengths, found, params: PackingParams, before: tuple[int, int] = (0, 0)) -> dict:
    owners, crossovers, better = found
    return {
        "block": int(block), "island": int(island), "keys": keys.tobytes(), "lengths": lengths.tobytes(),
        "owners": np.concatenate(owners).astype(np.int32).tobytes(), "elite": owners[0].astype(np.int32).tobytes(),
        "score": score(lengths, owners[0], params.capacity), "crossovers": before[0] + crossovers, "better": before[1] + better,
    }


def pack_pieces(
    ws: Workspace, pieces: DataFrame, params: PackingParams = PackingParams(), report: list | None = None
) -> DataFrame:
    """(key, sequence_id, offset) for ``pieces(key long, length)``, keys different, lengths from 1 to the capacity.

    ``report`` gets (crossovers, those whose child was the best so far on its island) of each round.
    """
    whole = pieces.where(F.col("length") == params.capacity).select(
        "key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < params.capacity).select("key", F.col("length").cast("long"))
    placed, round_ = [whole], 0
    blocks = lambda df: -(-df.count() // params.block_pieces)
    n_blocks = blocks(rest)
    while n_blocks:
        packed = ws.table(_pack_round(ws, rest, n_blocks, round_, params, report), "packed")
        full = F.col("load") >= int(params.filled * params.capacity)
        # blocks keep their bound: where too little was filled to need far fewer of them, this round is the last
        following = max(-(-n_blocks // 16), blocks(packed.where(~full)))
        last = n_blocks == 1 or following > 0.75 * n_blocks
        number = F.lit(round_ << 56) + F.shiftleft("block", 20) + F.col("bin")
        placed.append(packed.where(F.lit(True) if last else full).select("key", number.alias("sequence_id"), "offset"))
        if last:
            break
        rest, n_blocks, round_ = packed.where(~full).select("key", "length"), following, round_ + 1
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return out


def cut_pieces(
    docs: DataFrame, id_col: str, text_col: str, tokenizer: str, params: PackingParams, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each piece; only documents over the capacity are cut."""
    size, end = params.capacity, np.array([params.end_id], "<u4").tobytes()

    # ids stay in Arrow: pandas turns integers beside a null into floats, which cannot hold every id
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        for batch in batches:
            rows, piece, start, length, crc, data = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = encoder.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        data.append(part)
            out = {
                "id": batch.column("id").take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(data, pa.binary())} if with_ids else {}))
        encoder.words.clear()  # idle workers keep nothing
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return source.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    params: PackingParams = PackingParams(), with_ids: bool = False,
) -> DataFrame:
    """Each piece of each document with its sequence and its place there, gapless from 0.

    Null and empty texts are a document of the end id alone; rows with a repeated or null id are documents of their
    own; an empty table gives no rows. Every document is placed, and no sequence exceeds the capacity.
    ``with_ids`` adds the ids themselves, for writing the sequences.
    """
    ws = Workspace(docs.sparkSession, "packing")
    cut = cut_pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), params, with_ids)
    pieces = ws.table(cut.withColumn("key", F.monotonically_increasing_id()), "pieces")
    placed = pack_pieces(ws, pieces.select("key", "length"), params)
    return pieces.join(placed, "key").drop("key").withColumnRenamed("id", id_col)
