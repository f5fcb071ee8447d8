"""Resharding by minimum-cost flow.

Rows are in old shards and, by the hash of their place, in a bounded number of blocks of each. From the bytes of the
old shards and the capacities of the new ones a minimum-cost flow gives the bytes to send from each old to each new
shard; bytes that stay cost nothing. Whole blocks are then dealt so that they follow the flow, and the last
differences are evened out with single blocks. Only sizes and counts of blocks reach the driver, whose number is a
parameter. The files of the shards that change are then written anew: rows are joined with the block table, which is
of fixed size, and go through one shuffle to parts of their new shard, where they are ranked, so no shard is ever one
task. Files of shards that keep their rows stay where they are.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.workspace import Workspace

#: Bytes of a part of a shard, which one task ranks and writes.
PART_BYTES = 64 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units from each source to each sink at the least total cost, by successive shortest paths with potentials.

    The capacities must hold the supply. Costs must not be negative.
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the new capacities do not hold the old shards")
    flow = [[0] * m for _ in range(n)]
    left, room, potential = list(supply), list(capacity), [0] * (n + m)
    while any(left):
        dist, via = [None] * (n + m), [None] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        for _, i in heap:
            dist[i] = 0
        done = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u < n:
                steps = ((n + j, cost[u][j]) for j in range(m))
            else:
                steps = ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in steps:
                nd = d + c + potential[u] - potential[v]
                if dist[v] is None or nd < dist[v]:
                    dist[v], via[v] = nd, u
                    heapq.heappush(heap, (nd, v))
        sink = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j] + potential[n + j])
        far = max(d for d in dist if d is not None)
        for v in range(n + m):
            potential[v] += far if dist[v] is None else min(dist[v], far)
        path, v = [], n + sink
        while via[v] is not None:
            path.append((via[v], v))
            v = via[v]
        amount = min([left[v], room[sink], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[v] -= amount
        room[sink] -= amount
    return flow


def deal_blocks(
    old: np.ndarray, sizes: np.ndarray, flow: list[list[int]], targets: list[int]
) -> np.ndarray:
    """The new shard of each block: along the flow, then single blocks from the fullest to the emptiest shard."""
    quota = {i: list(row) for i, row in enumerate(flow)}
    shard = np.zeros(len(sizes), np.int64)
    for b in np.argsort(-sizes, kind="stable").tolist():
        left = quota[int(old[b])]
        j = max(range(len(left)), key=lambda k: (left[k], k == old[b], -k))
        left[j] -= int(sizes[b])
        shard[b] = j
    over = np.bincount(shard, sizes, minlength=len(targets)).astype(np.int64) - np.array(targets, np.int64)
    members = [set(np.nonzero(shard == j)[0].tolist()) for j in range(len(targets))]
    for _ in range(4 * len(sizes)):
        a, b = int(over.argmax()), int(over.argmin())
        gap = int(over[a] - over[b])
        best = min(members[a], key=lambda k: (abs(gap - 2 * int(sizes[k])), k), default=None)
        if best is None or abs(gap - 2 * int(sizes[best])) >= gap:
            break
        members[a].discard(best)
        members[b].add(best)
        shard[best] = b
        over[a] -= sizes[best]
        over[b] += sizes[best]
    return shard


@dataclass(frozen=True)
class ReshardPlan:
    """Blocks with their old and new shard and first slot; the flow in bytes; the new shards whose rows change."""

    blocks: tuple[tuple[int, int, int, int], ...]  # old shard, block, new shard, first slot
    flow: tuple[tuple[int, ...], ...] = field(repr=False)
    moved_bytes: int
    affected: frozenset[int]


def plan_reshard(sized: DataFrame, n_old: int, capacities: list[int] | int) -> ReshardPlan:
    """Plan for ``sized(old, block, size)``; ``capacities`` are the new shards' weights, or their number if equal."""
    weights = [1] * capacities if isinstance(capacities, int) else list(capacities)
    rows = sized.groupBy("old", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r["old"], r["block"]))
    old, sizes = np.array([r["old"] for r in rows], np.int64), np.array([r["bytes"] for r in rows], np.int64)
    total, n_new = int(sizes.sum()), len(weights)
    targets = [total * sum(weights[: j + 1]) // sum(weights) - total * sum(weights[:j]) // sum(weights) for j in range(n_new)]
    supply = [int(sizes[old == i].sum()) for i in range(n_old)]
    cost = [[0 if i == j else 1 for j in range(n_new)] for i in range(n_old)]
    flow = min_cost_flow(supply, targets, cost)
    shard = deal_blocks(old, sizes, flow, targets)
    blocks, following = [], [0] * n_new
    for r, j in zip(rows, shard.tolist()):
        blocks.append((r["old"], r["block"], j, following[j]))
        following[j] += r["n"]
    moved = [k for k in range(len(rows)) if old[k] != shard[k]]
    affected = {int(shard[k]) for k in moved} | {int(old[k]) for k in moved if old[k] < n_new}
    return ReshardPlan(tuple(blocks), tuple(map(tuple, flow)), int(sizes[moved].sum()), frozenset(affected))


def with_blocks(df: DataFrame, place: Column, blocks_per_shard: int) -> DataFrame:
    """``df`` with the block of each row in its old shard."""
    return df.withColumn("block", F.pmod(F.xxhash64(place, F.lit("block")), F.lit(blocks_per_shard)).cast("int"))


def apply_plan(rows: DataFrame, plan: ReshardPlan, order: list[str]) -> DataFrame:
    """``rows(old, block, ...)`` with ``shard`` and ``slot``, gapless from 0 in each shard; blocks stay together.

    The block table has as many rows as the plan's parameters allow, so it is broadcast. Rows are shuffled once, by
    their new shard and a part of it, which is also how they are ranked and can be written.
    """
    schema = "old int, block int, shard int, first_slot long"
    table = F.broadcast(rows.sparkSession.createDataFrame(list(plan.blocks), schema))
    n_new = len(plan.flow[0]) if plan.flow else 1
    parts = max(1, -(-sum(map(sum, plan.flow)) // (n_new * PART_BYTES)))
    sent = rows.join(table, ["old", "block"]).withColumn("part", F.pmod("block", F.lit(parts)))
    sent = sent.repartition(n_new * parts, "shard", "part")
    rank = F.row_number().over(Window.partitionBy("shard", "part", "old", "block").orderBy(*order))
    return sent.withColumn("slot", F.col("first_slot") + rank.cast("long") - 1).drop("first_slot", "part")


def rewrite_shards(rows: DataFrame, plan: ReshardPlan, folder: str, order: list[str]) -> list[int]:
    """Write the affected shards of ``rows(old, block, ...)`` under ``folder``; returns their numbers.

    Files of other shards hold the rows they held before and are not written.
    """
    affected = sorted(plan.affected)
    changed = {(o, b) for o, b, s, _ in plan.blocks if s in plan.affected}
    moved = ReshardPlan(tuple(x for x in plan.blocks if (x[0], x[1]) in changed), plan.flow, plan.moved_bytes, plan.affected)
    apply_plan(rows, moved, order).drop("old", "block").write.mode("overwrite").option(
        "compression", "zstd"
    ).partitionBy("shard").parquet(folder)
    return affected


def reshard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_old: int = 16, n_new: int = 24,
    blocks_per_shard: int = 512, report: list | None = None,
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row, sizes of shards near equal, read back from
    the files of the new shards.

    The old layout is ``n_old`` shards by the hash of a row's place in the table, which are written first, with all
    columns of ``docs``; the shards that change are then written anew. A row's size is the UTF-8 bytes of its text,
    none for null, and 8. Equal and repeated rows are rows of their own, so a text or id that a third of the rows share
    spreads evenly; a single row larger than a shard's share makes that shard larger. An empty table gives no rows.
    ``report`` gets the bytes that move, and the numbers of the shards that are written.
    """
    ws = Workspace(docs.sparkSession, "sharding")
    # the documents' own columns are kept in a struct, so that no name of theirs can clash
    placed = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("place"))
    old = F.pmod(F.xxhash64("place", F.lit("old")), F.lit(n_old)).cast("int")
    before = ws.path("old")
    placed.withColumn("old", old).write.option("compression", "zstd").partitionBy("old").parquet(before)
    schema = placed.withColumn("old", old).schema
    stored = with_blocks(docs.sparkSession.read.schema(schema).parquet(before), F.col("place"), blocks_per_shard)
    size = lambda doc: (F.octet_length(_bytes(doc[text_col])) + 8).cast("long")
    plan = plan_reshard(stored.select("old", "block", size(F.col("doc")).alias("size")), n_old, n_new)
    after = ws.path("new")
    order = [F.col("doc").getField(id_col), F.col("place")]
    written = rewrite_shards(stored, plan, after, order) if plan.affected else []
    if report is not None:
        report += [plan.moved_bytes, written]
    fields = [f for f in schema.fields if f.name != "old"]
    kind = T.StructType([*fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    rows = docs.sparkSession.read.schema(kind).parquet(after) if written else docs.sparkSession.createDataFrame([], kind)
    rows = rows.select("doc", "shard", "slot")
    same = sorted(set(range(n_new)) - set(written))
    if same:  # shards whose files stay: their rows are ranked where they lie
        stay = ReshardPlan(tuple(x for x in plan.blocks if x[2] in same), plan.flow, 0, frozenset(same))
        rows = rows.unionByName(apply_plan(stored, stay, order).select("doc", "shard", "slot"))
    return rows.select(
        F.col("doc").getField(id_col).alias(id_col), size(F.col("doc")).alias("size"),
        F.crc32(_bytes(F.col("doc")[text_col])).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _bytes(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")
