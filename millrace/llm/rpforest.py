"""Embedding near-duplicates by a forest of random-projection trees.

Vectors of a label and dimension are a root. From a bounded sample of each root one task makes its plan:

- *Cores*: groups of near copies that hold a good share of the root. A core is what lies within half the threshold's
  angle of its centre, so by the triangle inequality all its vectors are linked with each other: representative and
  membership stand for all their pairs, which are counted without being compared. Other vectors are compared with a
  core's only if their angle to its centre does not rule links out.
- *Trees* over all other vectors: a node is split at the median of a random projection, or beside it where that is in
  a dense stretch, and vectors within ``spill`` of the cut go to both sides. The number of trees follows from the chance that a tree parts a pair that is just at
  the threshold, so that ``recall`` of such pairs meet in a leaf; nearer pairs meet more often.

Vectors are routed without being copied: what a round writes are numbers of nodes. Nodes that are still large after a
round are sampled and cut on in the next. A node where a cut would part too many linked pairs, as in a dense stretch, is
a leaf of any size and is compared whole, in blocks, so nothing is lost there. Only then vectors go to their leaves, once
for each, and are compared by cosine in double precision. A pair that meets in several leaves is counted in the one
with the smallest number, so links are counted exactly once without writing any pair; of the links of a leaf a spanning
forest is kept for the union.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from io import BytesIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components, union_labels
from millrace.llm.tokenfile import open_fs
from millrace.llm.workspace import Workspace


#: Where a projection is cut: at its median, or beside it where the median lies in a dense stretch.
QUANTILES = (0.5, 0.35, 0.65, 0.2, 0.8)


@dataclass(frozen=True)
class ForestParams:
    threshold: float = 0.93
    leaf_rows: int = 512  # nodes up to this size are leaves; also about the rows of a block where a larger one is compared
    spill: float = 0.25  # half the overlap, in standard deviations of the projected difference of a pair at the threshold
    most_parting: float = 0.1  # a node where a cut would part more of such pairs, as in a dense stretch, is compared whole
    recall: float = 0.98  # of the pairs at the threshold; the number of trees follows from it
    most_trees: int = 256
    sample: int = 8192  # vectors of a root or node that its cuts are made from
    sample_leaf: int = 16  # vectors of the sample that a node needs to be cut
    core_sample: int = 2048  # vectors of a root that its cores are looked for in
    core_rows: int = 16  # vectors of that sample that make a core
    max_depth: int = 60
    seed: int = 17

    @property
    def core_cosine(self) -> float:
        """To a core's centre: two vectors beyond it are linked with each other, whatever their directions."""
        return math.cos(math.acos(self.threshold) / 2 - 1e-7)

    @property
    def shell_cosine(self) -> float:
        """To a core's centre: a vector below it is linked with none of the core's."""
        return math.cos(math.acos(self.threshold) * 1.5 + 1e-7)


@lru_cache(maxsize=4096)
def direction(seed: int, tree: int, node: int, size: int) -> np.ndarray:
    v = np.random.default_rng([seed, int(tree), int(node), size]).standard_normal(size)
    return v / np.linalg.norm(v)


def unit(vectors) -> np.ndarray:
    rows = np.asarray(vectors, np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def half_width(dimension: int, p: ForestParams) -> float:
    return p.spill * math.sqrt(2 * (1 - p.threshold) / dimension)


def parting(density: float, dimension: int, p: ForestParams) -> float:
    """The chance that a cut parts a pair at the threshold, from the share of vectors in a unit of length at the median."""
    deviation, a = math.sqrt(2 * (1 - p.threshold) / dimension), 2 * p.spill
    beyond = math.exp(-a * a / 2) / math.sqrt(2 * math.pi) - a * 0.5 * math.erfc(a / math.sqrt(2))
    return min(1.0, density * deviation * 2 * beyond)


def find_cores(rows: np.ndarray, p: ForestParams) -> np.ndarray:
    """Centres of groups of near copies in a sample of unit vectors, the largest first."""
    left, centres = rows[: p.core_sample], []
    near = (left @ left.T >= p.threshold).astype(np.float32)
    alive = np.ones(len(left), bool)
    while True:
        counts = (near @ alive.astype(np.float32)) * alive
        best = int(counts.argmax()) if len(counts) else 0
        if not len(counts) or counts[best] < p.core_rows:
            return np.array(centres).reshape(-1, rows.shape[1])
        group = (near[best] > 0) & alive
        centre = left[group].mean(0)
        centre /= np.linalg.norm(centre)
        inside = (left @ centre >= p.core_cosine) & alive
        if inside.sum() >= p.core_rows:
            centres.append(centre)
            alive &= ~inside
            alive[best] = False
        else:  # too wide for a core; trees and blocks see to it
            alive &= ~group


def core_of(rows: np.ndarray, centres: np.ndarray, p: ForestParams) -> tuple[np.ndarray, np.ndarray]:
    """(the first core that holds each vector, or -1; whether a vector has to be compared with each core's).

    Vectors of two cores meet in the first of these.
    """
    if not len(centres):
        return np.full(len(rows), -1), np.zeros((len(rows), 0), bool)
    cosine = rows @ centres.T
    inside = cosine >= p.core_cosine
    own = np.where(inside.any(1), inside.argmax(1), -1)
    before = np.where(own < 0, len(centres), own)
    return own, (cosine >= p.shell_cosine) & (np.arange(len(centres)) < before[:, None])


def cut_node(
    rows: np.ndarray, tree: int, node: int, count: float, p: ForestParams
) -> tuple[list[tuple[int, float, float]], list[tuple[float, float]]]:
    """The splits (node, low, high) below ``node`` that ``count`` vectors, sampled as ``rows``, call for; and of each
    node at the end of them (the chance that a pair at the threshold comes to leaves together, vectors)."""
    cuts, ends, todo = [], [], [(node, rows, float(count), 1.0, 0.0, 0.0)]
    while todo:
        at, part, size, together, share, parted = todo.pop()
        if size <= p.leaf_rows:
            ends.append((together, size))
            continue
        if len(part) < p.sample_leaf:  # cut on in a later round, much as above
            more = math.log(size / p.leaf_rows) / math.log(2 / (1 + share))
            ends.append((together * (1 - parted) ** more, size))
            continue
        x = part @ direction(p.seed, tree, at, part.shape[1])
        width = half_width(part.shape[1], p)
        for middle in np.quantile(x, QUANTILES).tolist():
            low, high = middle - width, middle + width
            left, right = x <= high, x >= low
            share = float(left.mean() + right.mean() - 1)
            parted = parting(share / (2 * width), part.shape[1], p)
            if parted <= p.most_parting:
                break
        else:
            ends.append((together, size))
            continue
        cuts.append((at, low, high))
        together *= 1 - parted
        todo += [(2 * at, part[left], size * left.mean(), together, share, parted)]
        todo += [(2 * at + 1, part[right], size * right.mean(), together, share, parted)]
    return cuts, ends


def route(rows: np.ndarray, tree: int, node: int, cuts: dict[int, tuple[float, float]], p: ForestParams):
    """(rows, nodes) after following the cuts; a row in an overlap goes both ways."""
    done_rows, done_nodes, todo = [], [], [(node, np.arange(len(rows)))]
    while todo:
        at, members = todo.pop()
        if at not in cuts or not len(members):
            done_rows.append(members)
            done_nodes.append(np.full(len(members), at, np.int64))
            continue
        low, high = cuts[at]
        x = rows[members] @ direction(p.seed, tree, at, rows.shape[1])
        todo += [(2 * at, members[x <= high]), (2 * at + 1, members[x >= low])]
    return np.concatenate(done_rows), np.concatenate(done_nodes)


def count_trees(ends: list[tuple[float, float]], p: ForestParams) -> int:
    """Trees that give ``recall`` for pairs at the threshold in all but the worst twentieth of a root."""
    chances, sizes = (np.array(x) for x in zip(*sorted(ends)))
    together = float(chances[np.searchsorted(np.cumsum(sizes), 0.05 * sizes.sum())])
    if together >= p.recall:
        return 1
    return min(p.most_trees, math.ceil(math.log(1 - p.recall) / math.log(1 - max(together, 1e-6))))


def make_plan(rows: np.ndarray, count: int, p: ForestParams) -> tuple[np.ndarray, list[tuple[int, int, float, float]], int]:
    """(centres of cores, (tree, node, low, high) of all cuts, number of trees) of a root, from a sample of it."""
    centres = find_cores(rows, p)
    rest = rows[core_of(rows, centres, p)[0] < 0]
    left = count * len(rest) / len(rows)
    if not len(rest):
        return centres, [], 1
    first, ends = cut_node(rest, 0, 1, left, p)
    trees = count_trees(ends, p)
    cuts = [(0, *c) for c in first]
    return centres, cuts + [(t, *c) for t in range(1, trees) for c in cut_node(rest, t, 1, left, p)[0]], trees


def leaf_links(
    vectors: np.ndarray, copies: np.ndarray, others: list[np.ndarray], leaf: int, threshold: float, n_home: int | None = None
):
    """(links counted here, smallest linked position) of each vector of a leaf.

    The first ``n_home`` vectors are compared with the others only, or all with each other where it is None. ``others``
    are the numbers of all leaves of each vector: a pair that also meets in a leaf with a smaller number is counted there.
    """
    n = len(vectors)
    home, shift = (n, 0) if n_home is None else (n_home, n_home)
    links, labels = np.zeros(n, np.int64), np.arange(n)
    smaller = [o[o < leaf] for o in others]
    flat = np.concatenate(smaller) if n else np.empty(0, np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in smaller])
    names, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    again = times[place] > 1
    column = np.cumsum(times > 1)[place] - 1
    meets = np.zeros((n, int((times > 1).sum())), np.float32)
    meets[owner[again], column[again]] = 1
    for at in range(0, home, 256):
        to = min(at + 256, home)
        near = vectors[at:to] @ vectors[shift:].T >= threshold
        if n_home is None:
            near[np.arange(to - at), np.arange(at, to)] = False
        i, j = np.nonzero(near)
        if not len(i):
            continue
        labels = union_labels(labels, i + at, j + shift)
        if meets.shape[1]:
            near &= meets[at:to] @ meets[shift:].T == 0
        links[at:to] += near @ copies[shift:]
        if n_home is not None:
            links[shift:] += copies[at:to] @ near
    return links, labels


def _vectors(column, width: int) -> np.ndarray:
    """Unit vectors of a column of bytes, all of one dimension."""
    data = b"".join(column)
    return unit(np.frombuffer(data, f"<f{width}").reshape(len(column), -1))


def _as_bytes(lists: pa.ListArray, width: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(little-endian components, dimension, whether it can be compared) of each vector."""
    lists = lists.cast(pa.list_(pa.float32() if width == 4 else pa.float64()))
    offsets = np.asarray(lists.offsets, np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype(f"<f{width}")  # a null among them is a NaN
    sizes = np.diff(offsets)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    some = np.concatenate(([0], np.cumsum(values != 0)))
    good = (sizes > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (some[offsets[1:]] > some[offsets[:-1]])
    good &= ~np.asarray(lists.is_null())
    data = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lists), [None, pa.py_buffer(offsets * width), pa.py_buffer(values.tobytes())]
    )
    return data.cast(pa.binary()), sizes, good


def _rows(ws: Workspace, embeddings: DataFrame, id_col: str, label_col: str, vector_col: str, width: int) -> DataFrame:
    """(id, root, vec, good, k0, k1) of each row; ``k0`` and ``k1`` are 128 bits that name its label and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, sizes, good = _as_bytes(batch.column("vec"), width)
            columns = [batch.column("id"), batch.column("label"), data, pa.array(sizes.astype(np.int32)), pa.array(good)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "vec", "size", "good"])

    kind = embeddings.schema[id_col].dataType.simpleString()
    source = embeddings.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vec"))
    rows = source.mapInArrow(run, f"id {kind}, label string, vec binary, size int, good boolean")
    root = F.concat_ws(":", "size", "label")
    keys = [F.xxhash64(F.lit(k), root, "vec").alias(f"k{k}") for k in (0, 1)]
    return ws.table(rows.select("id", root.alias("root"), "vec", (F.col("good") & F.col("label").isNotNull()).alias("good"), *keys), "rows")


def _sampled(rows: DataFrame, sizes: DataFrame, key: list[str], p: ForestParams) -> DataFrame:
    """``rows`` with ``n`` of their root or node: all of a small one, and about ``sample`` of a larger."""
    draw = F.pmod(F.xxhash64("node", *key[1:], F.lit(p.seed)), F.lit(1 << 30)) < F.lit(p.sample) / F.col("n") * (1 << 30)
    return rows.join(sizes, key).where((F.col("n") <= p.sample) | draw)


def _put(folder: str, **arrays: np.ndarray) -> str:
    """Write arrays as a file of their own in the shared folder; its path."""
    path, data = f"{folder}/plan-{uuid.uuid4().hex}.npz", BytesIO()  # a name for each attempt
    np.savez(data, **arrays)
    fs, inner = open_fs(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inner) as out:
        out.write(data.getvalue())
    return path


@lru_cache(maxsize=16)
def _get(path: str) -> dict[str, np.ndarray]:
    """Arrays of a file; a plan is bounded by the sample that it is made from."""
    fs, inner = open_fs(path)
    with fs.open_input_stream(inner) as source:
        found = np.load(BytesIO(source.read()))
        return {k: found[k] for k in found.files}


def _put_cuts(folder: str, cuts: list[tuple[int, int, float, float]], **more: np.ndarray) -> str:
    return _put(
        folder, tree=np.array([c[0] for c in cuts], np.int32), at=np.array([c[1] for c in cuts], np.int64),
        bounds=np.array([c[2:] for c in cuts], np.float64).reshape(-1, 2), **more,
    )


@lru_cache(maxsize=16)
def _cuts(path: str) -> dict[int, dict[int, tuple[float, float]]]:
    out: dict[int, dict[int, tuple[float, float]]] = {}
    found = _get(path)
    for tree, at, bounds in zip(found["tree"].tolist(), found["at"].tolist(), found["bounds"].tolist()):
        out.setdefault(tree, {})[at] = tuple(bounds)
    return out


def _gathered(rows: DataFrame, key: list[str], salts: int = 256) -> DataFrame:
    """``rows`` with those of a root or node together, in ``salts`` places where they are many, so that few batches of a
    task need another plan."""
    return rows.repartition(*key, F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(salts))).sortWithinPartitions(*key)


def _plans(ws: Workspace, classes: DataFrame, p: ForestParams, width: int) -> DataFrame:
    """(root, path) of the plan of each root that has more vectors than a leaf."""
    folder = ws.root

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("draw")
        centres, cuts, trees = make_plan(_vectors(group["vec"], width), int(group["n"].iat[0]), p)
        path = _put_cuts(folder, cuts, centres=centres, trees=np.array([trees]))
        return pd.DataFrame({"root": [group["root"].iat[0]], "path": [path]})

    sizes = classes.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > p.leaf_rows)
    sampled = _sampled(classes.select("node", "root", "vec"), sizes, ["root"], p)
    found = sampled.withColumn("draw", F.xxhash64("node", F.lit("draw"))).groupBy("root").applyInPandas(
        plan, "root string, path string"
    )
    return ws.table(found, "plans")


def _routed(ws: Workspace, classes: DataFrame, plans: DataFrame, p: ForestParams, width: int) -> DataFrame:
    """(node, root, core, shells, trees, ats): the core of each vector, those to compare it with, and its nodes."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (root, path), group in batch.groupby(["root", "path"], sort=False):
                rows, plan = _vectors(group["vec"], width), _get(path)
                own, near = core_of(rows, plan["centres"].reshape(-1, rows.shape[1]), p)
                free = np.nonzero(own < 0)[0]
                trees, ats = ([[] for _ in range(len(rows))] for _ in range(2))
                for tree in range(int(plan["trees"][0])):
                    who, nodes = route(rows[free], tree, 1, _cuts(path).get(tree, {}), p)
                    for r, a in zip(free[who].tolist(), nodes.tolist()):
                        trees[r].append(tree)
                        ats[r].append(a)
                yield pd.DataFrame({
                    "node": group["node"].to_numpy(), "root": root, "core": own.astype(np.int32),
                    "shells": [np.nonzero(x)[0].tolist() for x in near], "trees": trees, "ats": ats,
                })

    kind = "node long, root string, core int, shells array<int>, trees array<int>, ats array<long>"
    narrow = classes.select("node", "root", "vec")
    planned = _gathered(narrow.join(plans, "root"), ["root"]).mapInPandas(send, kind)
    small = narrow.join(plans, "root", "left_anti").select(
        "node", "root", F.lit(-1).alias("core"), F.array().cast("array<int>").alias("shells"),
        F.array(F.lit(0)).alias("trees"), F.array(F.lit(1).cast("long")).alias("ats"),
    )
    return ws.table(planned.unionByName(small), "routed")


def _leaves(ws: Workspace, classes: DataFrame, routed: DataFrame, p: ForestParams, width: int) -> DataFrame:
    """(node, leaf) of each vector and leaf that it falls into; large nodes are sampled and cut on, round by round."""
    key, folder = ["root", "tree", "at"], ws.root

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        tree, at = int(group["tree"].iat[0]), int(group["at"].iat[0])
        found, _ = cut_node(_vectors(group["vec"], width), tree, at, int(group["n"].iat[0]), p)
        path = _put_cuts(folder, [(tree, *c) for c in found]) if found else None
        return pd.DataFrame({"root": [group["root"].iat[0]], "tree": [tree], "at": [at], "path": [path]})

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (root, tree, at, path), group in batch.groupby([*key, "path"], sort=False):
                rows, nodes = route(_vectors(group["vec"], width), int(tree), int(at), _cuts(path)[int(tree)], p)
                yield pd.DataFrame({"node": group["node"].to_numpy()[rows], "root": root, "tree": tree, "at": nodes})

    each = F.explode(F.arrays_zip("trees", "ats"))
    active = routed.select("node", "root", each.alias("x")).select("node", "root", F.col("x.trees").alias("tree"), F.col("x.ats").alias("at"))
    done = []
    while True:
        sizes = ws.table(active.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > p.leaf_rows), "sizes")
        large = sizes.where(F.col("at") < 1 << p.max_depth)
        if large.isEmpty():
            break
        with_vec = active.join(large.select(*key), key, "left_semi").join(classes.select("node", "vec"), "node")
        cuts = ws.table(
            _sampled(with_vec, large, key, p).groupBy(*key)
            .applyInPandas(fit, "root string, tree int, at long, path string").where("path is not null"),
            "cuts",
        )
        if cuts.isEmpty():
            break
        done.append(active.join(cuts.select(*key), key, "left_anti"))
        on = _gathered(with_vec.join(cuts, key), key).mapInPandas(send, "node long, root string, tree int, at long")
        active = ws.table(on, "nodes")
    out = active
    for part in done:
        out = out.unionByName(part)
    return ws.table(out.select("node", F.xxhash64(*key).alias("leaf")), "leaves")


def _tree_links(ws: Workspace, classes: DataFrame, leaves: DataFrame, p: ForestParams, width: int) -> DataFrame:
    """(node, links, root) of vectors that are linked within leaves."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["guest", "node"])
        n_home = None if group["block"].iat[0] == group["with_block"].iat[0] else int((~group["guest"]).sum())
        others = [np.asarray(o, np.int64) for o in group["others"]]
        copies = group["copies"].to_numpy(np.int64)
        links, labels = leaf_links(_vectors(group["vec"], width), copies, others, int(group["leaf"].iat[0]), p.threshold, n_home)
        return _found(group["node"].to_numpy(np.int64), links, labels)

    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    blocks = sizes.select("leaf", F.ceil(F.col("n") / p.leaf_rows).cast("int").alias("blocks"))
    own, met = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    of_node = leaves.groupBy("node").agg(F.sort_array(F.collect_list("leaf")).alias("others"))
    carried = classes.select("node", "vec", "copies").join(of_node, "node")
    gathered = (
        carried.withColumn("leaf", F.explode("others")).join(blocks, "leaf").withColumn("own", own)
        .withColumn("met", F.explode(met))
        .select(
            "node", "vec", "leaf", "others", "copies", F.least("own", "met").alias("block"),
            F.greatest("own", "met").alias("with_block"), (F.col("own") > F.col("met")).alias("guest"),
        )
    )
    return gathered.groupBy("leaf", "block", "with_block").applyInPandas(compare, "node long, links long, root long")


def _found(nodes: np.ndarray, links: np.ndarray, labels: np.ndarray) -> pd.DataFrame:
    some = (links > 0) | (labels != np.arange(len(labels)))
    return pd.DataFrame({"node": nodes[some], "links": links[some], "root": nodes[labels[some]]})


def _core_links(ws: Workspace, classes: DataFrame, routed: DataFrame, p: ForestParams, width: int) -> DataFrame:
    """(node, links, root) of the vectors of cores, linked with each other, and of those around cores with these."""
    members = routed.where("core >= 0").select("node", "root", "core").join(classes.select("node", "copies"), "node")
    totals = ws.table(
        members.groupBy("root", "core").agg(F.sum("copies").alias("total"), F.min("node").alias("first"), F.count("*").alias("n")),
        "cores",
    )
    inside = members.join(totals, ["root", "core"]).select(
        "node", (F.col("total") - F.col("copies")).alias("links"), F.col("first").alias("root")
    )
    around = ws.table(routed.select("node", "root", F.explode("shells").alias("core")), "around")
    if around.isEmpty():
        return inside

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["guest", "node"])
        none = [np.empty(0, np.int64)] * len(group)
        links, labels = leaf_links(
            _vectors(group["vec"], width), group["copies"].to_numpy(np.int64), none, 0, p.threshold, int((~group["guest"]).sum())
        )
        return _found(group["node"].to_numpy(np.int64), links, labels)

    # every block of a core meets every block of what is around it
    key = ["root", "core"]
    guests = around.groupBy(*key).agg(F.count("*").alias("m"))
    blocks = totals.join(guests, key).select(
        *key, F.ceil(F.col("n") / p.leaf_rows).cast("int").alias("n"), F.ceil(F.col("m") / p.leaf_rows).cast("int").alias("m")
    )
    dealt = lambda df, own, met, guest: df.join(blocks, key).select(
        *key, "node", F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(own + "_block"),
        F.explode(F.sequence(F.lit(0), F.col(met) - 1)).alias(met + "_block"), F.lit(guest).alias("guest"),
    )
    both = dealt(members.select(*key, "node"), "n", "m", False).unionByName(dealt(around.select(*key, "node"), "m", "n", True))
    compared = both.join(classes.select("node", "vec", "copies"), "node").groupBy(*key, "n_block", "m_block").applyInPandas(
        compare, "node long, links long, root long"
    )
    return inside.unionByName(compared)


def embedding_components(
    embeddings: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    params: ForestParams = ForestParams(),
) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    Vectors are compared when their labels and dimensions are equal. Null labels and vectors that are null, empty,
    zero, or hold a null, NaN or infinite component link with nothing and are a component each. Rows with equal
    label and vector are one class, compared once, and linked with each other; a cosine equal to the threshold is a
    link; a repeated id gives a row each, and a null id keeps its row, unkept. An empty table gives an empty result.
    Columns besides the three named ones are not read.
    """
    ws, p = Workspace(embeddings.sparkSession, "rpforest"), params
    width = 4 if embeddings.schema[vector_col].dataType.simpleString() == "array<float>" else 8
    rows = _rows(ws, embeddings, id_col, label_col, vector_col, width)
    good = rows.where("good")
    classes = good.groupBy("k0", "k1").agg(
        F.first("root").alias("root"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("id").alias("first")
    )
    classes = ws.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    routed = _routed(ws, classes, _plans(ws, classes, p, width), p, width)
    leaves = _leaves(ws, classes, routed, p, width)
    found = ws.table(
        _tree_links(ws, classes, leaves, p, width).unionByName(_core_links(ws, classes, routed, p, width)), "links"
    )
    comps = connected_components(ws, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = ws.table(
        classes.select("node", "k0", "k1", "copies", "first").join(counted, "node", "left").join(comps, "node", "left")
        .select(
            "k0", "k1", "first", F.coalesce("component", "node").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "named",
    )
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    final = named.join(firsts, "component").select("k0", "k1", "n_links", "component_id")
    linked = good.select("id", "k0", "k1").join(final, ["k0", "k1"]).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
firsts AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, least(vec_id, coalesce(b, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN firsts ON firsts.a = vec_id
"""
