"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is a set of digests: each paragraph's hash, with the number of equal paragraphs before it. A sketch adds every
digest to three of its cells. The sketches of two versions subtract cell by cell, so what they share is gone, and peeling
(a cell with a single digest names it; taking it out of its other cells bares more) recovers the digests of which side
only. Where cells are too few for the difference, peeling comes to a stop, and that pair is tried again with more cells
and other hashes, as many as the squares of the counts let expect; so every difference is recovered in the end, and
likeness is exact but for collisions of 64 bits.

Paragraphs are lines, cut after ends of sentences and after ``max_words`` words, so that texts of one line differ by
degrees too. Sketches of many texts are one array of numpy, so a whole batch is hashed, subtracted and peeled at once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.workspace import Workspace, release

#: Cells of a fingerprint, a multiple of ``HASHES``; enough for most differences of up to about 8 digests.
CELLS = 18
HASHES = 3
MAX_ROUNDS = 200
MAX_WORDS = 8
#: Cells that are peeled at once, about 32 bytes each.
GROUP_CELLS = 1 << 21
ODD = 0x9E3779B97F4A7C15


def paragraph_pattern(max_words: int = MAX_WORDS) -> re.Pattern:
    return re.compile(rf"(?:[^\s.!?]+[^\S\n]*){{1,{max_words}}}[.!?]*|[.!?]+")


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Another 64 bits for each value."""
    x = x + np.uint64(salt * ODD % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Digests:
    """The digests of many texts, one after the other; text ``i`` has those from ``bounds[i]`` to ``bounds[i + 1]``."""

    def __init__(self, texts: Iterable[str | None], pattern: re.Pattern):
        found, bounds, digest = [], [0], xxhash.xxh3_64_intdigest
        for text in texts:
            found += [digest(p.strip()) for p in pattern.findall(text or "")]
            bounds.append(len(found))
        self.bounds = np.array(bounds)
        plain = np.array(found, np.uint64)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(self.bounds))
        order = np.lexsort((plain, owner))
        first = np.ones(len(plain), bool)
        first[1:] = (plain[order][1:] != plain[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        at = np.arange(len(plain))
        nth = np.empty(len(plain), np.uint64)
        nth[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        self.values = _mixed(plain + nth * np.uint64(0xD6E8FEB86659FD93), 1)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


class Sketches:
    """Sketches of ``n`` texts, each of ``cells`` cells: counts, and exclusive-or sums of digests and of their checks."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int32)
        self.key = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint32)

    def places(self, owner: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
        """The cells of each digest: one in each third of its text's cells. Other sizes have other hashes."""
        third = self.cells // HASHES
        return [
            owner * self.cells + k * third + (_mixed(values, 97 * self.cells + k) % np.uint64(third)).astype(np.int64)
            for k in range(HASHES)
        ]

    def add(self, owner: np.ndarray, values: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check = checks(values)
        for at in self.places(owner, values):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, values)
            np.bitwise_xor.at(self.check, at, check)

    @classmethod
    def of(cls, digests: Digests, which: np.ndarray, cells: int) -> Sketches:
        out = cls(len(which), cells)
        sizes = digests.counts()[which]
        owner = np.repeat(np.arange(len(which)), sizes)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out.add(owner, digests.values[np.repeat(digests.bounds[:-1][which], sizes) + inner])
        return out

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empties the cells; (owner, digest, side) of what came out, side 1 or -1, and which sketches are empty now.

        A cell is taken for a single digest if its check is that of its digest, and the digest belongs into it. Rounds
        are bounded, since a cell that passes by chance could be put back and taken out for ever.
        """
        owners, values, sides = [], [], []
        look = np.arange(self.n * self.cells)
        for _ in range(MAX_ROUNDS):
            look = look[np.abs(self.count[look]) == 1]
            look = look[checks(self.key[look]) == self.check[look]]
            owner, value = look // self.cells, self.key[look]
            own = np.zeros(len(look), bool)
            for at in self.places(owner, value):
                own |= at == look
            owner, value, side = owner[own], value[own], self.count[look[own]]
            if not len(owner):
                break
            order = np.lexsort((value, owner))  # several cells may show the same digest
            owner, value, side = owner[order], value[order], side[order]
            first = np.ones(len(owner), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
            owner, value, side = owner[first], value[first], side[first]
            owners.append(owner), values.append(value), sides.append(side)
            self.add(owner, value, -side)
            look = np.unique(np.concatenate(self.places(owner, value)))
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        empty = ~left.reshape(self.n, self.cells).any(axis=1) if self.n else np.zeros(0, bool)
        joined = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((owners, np.int64), (values, np.uint64), (sides, np.int64))]
        return (*joined, empty)

    def likely(self) -> np.ndarray:
        """About how many digests each difference has: every one adds a 1 or -1 to three cells, so the squares of the
        counts of a third add up to them, and to what one side has more of, evenly spread."""
        counts = self.count.reshape(self.n, HASHES, -1).astype(np.float64)
        more = counts.sum(axis=(1, 2)) / HASHES
        return np.maximum((counts**2).sum(axis=(1, 2)) / HASHES - more**2 / counts.shape[2], np.abs(more))

    def bytes(self) -> list[bytes]:
        """The cells of each sketch; counts modulo 2^16, which is enough to subtract them."""
        parts = (self.count.astype("<i2"), self.key.astype("<u8"), self.check.astype("<u4"))
        rows = np.concatenate([x.reshape(self.n, self.cells).view(np.uint8) for x in parts], axis=1)
        return [row.tobytes() for row in rows]


def checks(values: np.ndarray) -> np.ndarray:
    return (_mixed(values, 5) >> np.uint64(32)).astype(np.uint32)


def as_text(n: int, cells: bytes) -> str:
    """A fingerprint: the number of digests, and the cells in base 64."""
    return f"{n:x}." + base64.b64encode(cells).decode()


def parse(fingerprint: str) -> tuple[int, Sketches]:
    """The number of digests of a fingerprint, and its sketch."""
    n, _, cells = fingerprint.partition(".")
    raw = base64.b64decode(cells)
    m = len(raw) // 14
    out = Sketches(1, m)
    out.count = np.frombuffer(raw, "<i2", m).astype(np.int32)
    out.key = np.frombuffer(raw, "<u8", m, 2 * m).astype(np.uint64)
    out.check = np.frombuffer(raw, "<u4", m, 10 * m).astype(np.uint32)
    return int(n, 16), out


def difference(left: str, right: str) -> tuple[list[int], list[int]] | None:
    """The digests of one fingerprint only, and of the other; None if the two differ in more than their cells can tell."""
    (_, a), (_, b) = parse(left), parse(right)
    rest = a.minus(b)
    rest.count = rest.count.astype(np.int16).astype(np.int32)
    _, values, sides, empty = rest.peel()
    return (sorted(values[sides > 0].tolist()), sorted(values[sides < 0].tolist())) if empty[0] else None


def compare(
    a: Digests, left: np.ndarray, b: Digests, right: np.ndarray, cells: int = CELLS,
    made: tuple[Sketches, Sketches] | None = None,
) -> dict[str, np.ndarray]:
    """For each pair of texts: digests of the left only, of the right only, the cells that told them, and the likeness,
    the share of all digests that both have (1 for two texts without any).

    All pairs are peeled at ``cells``, from the sketches in ``made`` if they are there; those whose peeling stops, again
    at twice as many or more. Pairs of many digests are taken in groups of at most about ``GROUP_CELLS`` cells.
    """
    n = len(left)
    out = {k: np.zeros(n, np.int64) for k in ("only_left", "only_right")} | {"cells": np.full(n, cells)}
    todo = np.arange(n)
    while len(todo):
        size = int(out["cells"][todo].min())
        now = todo[out["cells"][todo] == size]
        failed, step = [todo[out["cells"][todo] > size]], max(1, GROUP_CELLS // size)
        for group in (now[k : k + step] for k in range(0, len(now), step)):
            if made is not None and size == cells and len(group) == n:
                rest = made[0].minus(made[1])
            else:
                rest = Sketches.of(a, left[group], size).minus(Sketches.of(b, right[group], size))
            likely = rest.likely()
            owner, _, side, empty = rest.peel()
            for name, sign in (("only_left", 1), ("only_right", -1)):
                out[name][group] = np.bincount(owner[side == sign], minlength=len(group))
            doublings = np.maximum(1, np.ceil(np.log2(np.maximum(1.3 * likely, 1) / size)))
            again = group[~empty]
            out["cells"][again] = size * 2 ** doublings[~empty].astype(np.int64)
            failed.append(again)
        todo = np.concatenate(failed)
    both = a.counts()[left] + b.counts()[right]
    out["likeness"] = np.where(both > 0, 1 - (out["only_left"] + out["only_right"]) / np.maximum(both, 1), 1.0)
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first as many code points of the following text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


#: What is found of a document; digests, sketches and hashes in bytes.
FOUND = (
    "doc_id long, n_chars long, edited_hash binary, n_old long, sketch binary, n_new long, edited_sketch binary, "
    "near_edited double, near_next double, only_old long, only_new long, cells long"
)


def _described(ids: list[int | None], texts: list[str], following: str, pattern: re.Pattern) -> dict[str, list]:
    """The columns of FOUND for texts that follow each other, the last of them before ``following``."""
    n = len(texts)
    after = [*texts[1:], following]
    changed = [edited(t, f) for t, f in zip(texts, after)]
    own, new = Digests([*texts, following], pattern), Digests(changed, pattern)
    rows = np.arange(n)
    old_cells, new_cells, next_cells = (Sketches.of(d, at, CELLS) for d, at in ((own, rows), (new, rows), (own, rows + 1)))
    to_new = compare(own, rows, new, rows, made=(old_cells, new_cells))
    to_next = compare(own, rows, own, rows + 1, made=(old_cells, next_cells))
    return {
        "doc_id": ids, "n_chars": list(map(len, texts)), "edited_hash": [hashlib.sha256(t.encode()).digest() for t in changed],
        "n_old": own.counts()[:n].tolist(), "sketch": old_cells.bytes(), "n_new": new.counts().tolist(),
        "edited_sketch": new_cells.bytes(), "near_edited": to_new["likeness"].tolist(), "near_next": to_next["likeness"].tolist(),
        "only_old": to_new["only_left"].tolist(), "only_new": to_new["only_right"].tolist(), "cells": to_new["cells"].tolist(),
    }


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """Fingerprints of whole texts and of the same texts with their last quarter replaced by the start of the next one's.

    The next text is that of the next greater id, and after the last the first; null ids come first, rows of equal ids
    follow each other as they stand in the input. Null texts are empty. An empty table gives no rows; other columns are
    not looked at, and an id that is no whole number is taken as null. Beside the likenesses come the numbers of paragraphs that only the old and only the edited text has,
    and the cells at which the two could be told apart.

    Texts are dealt once, by ranges of the id, and each task goes through its range a batch at a time. The last text of a
    range waits in the result's table, with the first of the next range, and those pairs are done after the others.
    """
    ws = Workspace(docs.sparkSession, "fingerprints")
    pattern = paragraph_pattern(max_words)
    columns = [c.split()[0] for c in FOUND.split(", ")]
    schema = FOUND + ", part int, head string, tail string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            ids = batch.column("id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if not ids:
                continue
            if held is None:
                yield _row(part, head=texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = (ids[-1], texts[-1])
            if len(ids) > 1:
                yield _table(_described(ids[:-1], texts[:-1], texts[-1], pattern))
        if held is not None:
            yield _row(part, doc_id=held[0], tail=held[1])
        release()

    names = [*columns, "part", "head", "tail"]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def _table(found: dict[str, list]) -> pa.RecordBatch:
        n = len(found["doc_id"])
        return pa.RecordBatch.from_arrays([pa.array(found.get(c, [None] * n), arrow.field(c).type) for c in names], schema=arrow)

    def _row(part: int, **values) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"part": part} | values], arrow)

    placed = ws.settled(docs).select(
        F.col(id_col).try_cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("place"),
    )
    ordered = placed.repartitionByRange("id", "place").sortWithinPartitions("id", "place").select("id", "text")
    found = ws.table(ordered.mapInArrow(run, schema), "ranges")

    # a row for each range from here on; only numbers of ranges meet in one task
    heads = found.where("head is not null").select("part", "head")
    tails = found.where("tail is not null").select("part", "doc_id", "tail")
    in_order = Window.orderBy("part")
    follows = heads.select("part", F.coalesce(F.lead("part").over(in_order), F.min("part").over(Window.partitionBy())).alias("next"))
    pairs = tails.join(follows, "part").join(heads.withColumnsRenamed({"part": "next", "head": "following"}), "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tail", "following"))):
                yield _table(_described([doc_id], [text], following, pattern)).select(columns)

    last = pairs.select("doc_id", "tail", "following").mapInArrow(finish, FOUND)
    told = lambda n, cells: F.concat(F.lower(F.hex(n)), F.lit("."), F.translate(F.base64(cells), "\r\n", ""))
    return found.where("part is null").select(*columns).unionByName(last).select(
        "doc_id", "n_chars", F.lower(F.hex("edited_hash")).alias("edited_sha256"), told("n_old", "sketch").alias("fingerprint"),
        told("n_new", "edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next", "only_old", "only_new", "cells",
    )
