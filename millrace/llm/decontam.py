"""Benchmark decontamination with a generalised suffix automaton of the items' words.

Items are dealt into parts of about ``part_words`` words. Each part's automaton is built in a task of its own and kept
as a file in the shared folder, so neither the driver nor a worker holds more than one part, however large the
benchmark is. With several parts, a worker gathers texts up to ``HELD_BYTES`` before it goes through the parts, so a
part is loaded once for so many bytes of text. Document words are streamed through each part: the automaton's state gives the longest suffix that occurs in an
item, and with it the windows that end at the word. Stretches whose neighbouring word pairs do not all occur in the
benchmark cannot hold a window of two words or more and are skipped before that.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokenfile import open_fs
from millrace.llm.workspace import Workspace, release

#: Bytes of words: digits, letters A-Z as a-z, and all of non-ASCII characters; others part words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PAIR_SLOTS = 1 << 22
#: Bytes of texts that a worker gathers before it goes through several parts.
HELD_BYTES = 32 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class SuffixAutomaton:
    """All substrings of several word sequences, with the windows that mark an item.

    A window is ``window`` consecutive words of an item; the whole item if it has fewer words, but not none.
    """

    def __init__(self, window: int):
        self.window = window
        self.link, self.length, self.step = [-1], [0], {}
        self.vocabulary: dict[bytes, int] = {}
        self.out: list[list[int]] = [[]]  # words that lead out of a state
        self.items: list = []
        self.marks: dict[int, dict[int, set[int]]] = {}  # state: window length: places in items

    def _key(self, state: int, word: int) -> int:
        return state << 32 | word

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.out.append([])
        return len(self.length) - 1

    def _set(self, state: int, word: int, target: int) -> None:
        key = self._key(state, word)
        if key not in self.step:
            self.out[state].append(word)
        self.step[key] = target

    def _split(self, state: int, word: int, target: int) -> int:
        """The part of ``target`` that holds the strings of ``state`` and one more word, as a state of its own."""
        clone = self._state(self.length[state] + 1, self.link[target])
        for w in self.out[target]:
            self._set(clone, w, self.step[self._key(target, w)])
        self.link[target] = clone
        while state >= 0 and self.step.get(self._key(state, word)) == target:
            self.step[self._key(state, word)] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        target = self.step.get(self._key(last, word))
        if target is not None:
            exact = self.length[target] == self.length[last] + 1
            return target if exact else self._split(last, word, target)
        new, state = self._state(self.length[last] + 1, 0), last
        while state >= 0 and self._key(state, word) not in self.step:
            self._set(state, word, new)
            state = self.link[state]
        if state >= 0:
            target = self.step[self._key(state, word)]
            exact = self.length[target] == self.length[state] + 1
            self.link[new] = target if exact else self._split(state, word, target)
        return new

    def add(self, item_id, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
        self.items.append((item_id, words))

    def finish(self) -> SuffixAutomaton:
        """Mark the windows, once all items are in."""
        v, lengths = self.vocabulary, set()
        self.pairs, self.single = np.zeros(PAIR_SLOTS, bool), np.zeros(len(v) + 1, bool)
        for place, (_, words) in enumerate(self.items):
            size = min(self.window, len(words))
            if not size:
                continue
            lengths.add(size)
            ids = np.array([v[w] for w in words], np.int64)
            self.pairs[self._slots(ids)] = True
            if size == 1:
                self.single[ids] = True
            for _, state, matched in self._walk(ids.tolist(), 0):
                if matched >= size:
                    while self.length[self.link[state]] >= size:
                        state = self.link[state]
                    self.marks.setdefault(state, {}).setdefault(size, set()).add(place)
        self.shortest = min(lengths, default=0)
        self.ids = [item_id for item_id, _ in self.items]
        del self.items, self.out
        return self

    @staticmethod
    def _slots(ids: np.ndarray) -> np.ndarray:
        return (ids[:-1] * 2_654_435_761 + ids[1:] * 40_503) & (PAIR_SLOTS - 1)

    def _walk(self, ids: list[int], at: int) -> Iterator[tuple[int, int, int]]:
        """(place, state, longest matching length) after each word."""
        state = matched = 0
        step, link, length = self.step, self.link, self.length
        for at, word in enumerate(ids, at):
            while (target := step.get(state << 32 | word)) is None and state:
                state = link[state]
                matched = length[state]
            if target is None:
                matched = 0
            else:
                state, matched = target, matched + 1
            yield at, state, matched

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Begin and end of the runs of words that can hold a window."""
        if not self.shortest or len(ids) < self.shortest:
            return
        known = ids >= 0
        if self.shortest == 1:
            good = known
            pad = np.concatenate(([False], good, [False]))
            edges = np.nonzero(pad[1:] != pad[:-1])[0]
            yield from zip(edges[::2].tolist(), edges[1::2].tolist())
            return
        good = known[:-1] & known[1:]
        good &= self.pairs[self._slots(ids)]
        pad = np.concatenate(([False], good, [False]))
        edges = np.nonzero(pad[1:] != pad[:-1])[0]
        begin, end = edges[::2], edges[1::2] + 1
        long = end - begin >= self.shortest
        yield from zip(begin[long].tolist(), end[long].tolist())

    def windows(self, words: list[bytes]) -> Iterator[tuple[int, int, set[int]]]:
        """(begin, end, places of items) of every occurrence of a window."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        for begin, end in self.stretches(ids):
            for at, state, matched in self._walk(ids[begin:end].tolist(), begin):
                if matched >= self.shortest:
                    while state:
                        for size, places in self.marks.get(state, {}).items():
                            if size <= matched:
                                yield at + 1 - size, at + 1, places
                        state = self.link[state]


@dataclass(frozen=True)
class Parts:
    """Files of automata, in the shared folder."""

    paths: tuple[str, ...]


def build_automata(
    ws: Workspace, benchmark: DataFrame, id_col: str, text_col: str, window: int, part_words: int
) -> Parts:
    """One automaton for about every ``part_words`` words of the benchmark, each built and written by a task.

    Only the number of words and the paths of the files, one for each part, reach the driver.
    """
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).distinct()

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t)) for t in texts], dtype="int64")

    counted = rows.select("id", "text", F.pandas_udf(count, "long")("text").alias("words"))
    total = counted.agg(F.sum("words")).first()[0] or 0
    part = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, -(-total // part_words)))).alias("part")

    root = ws.root

    def build(group: pa.Table) -> pa.Table:
        automaton = SuffixAutomaton(window)
        pairs = zip(group.column("id").to_pylist(), group.column("text").to_pylist())
        for item_id, text in sorted(pairs, key=lambda p: (str(p[0]), p[1] or b"")):
            automaton.add(item_id, words_of(text))
        path = f"{root}/automaton-{uuid.uuid4().hex}.bin"  # a name for each attempt
        fs, inner = open_fs(path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(inner) as out:
            out.write(pickle.dumps(automaton.finish()))
        release()
        return pa.table({"path": [path]})

    built = rows.select("id", "text", part).groupBy("part").applyInArrow(build, "path string").collect()
    return Parts(tuple(sorted(r["path"] for r in built)))


def _load(path: str) -> SuffixAutomaton:
    fs, inner = open_fs(path)
    with fs.open_input_stream(inner) as source:
        return pickle.loads(source.read())


@lru_cache(maxsize=1)
def _kept(path: str) -> SuffixAutomaton:
    return _load(path)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


FINDINGS = "n_words long, n_hit long, items array<string>, begins array<int>, ends array<int>"


def findings(parts: Parts, texts: pd.Series) -> dict[str, list]:
    """Of each binary text its words, hit words, items, and hit runs as word numbers [begin, end)."""
    split = [words_of(t) for t in texts]
    spans: list[list[tuple[int, int]]] = [[] for _ in split]
    items: list[set[str]] = [set() for _ in split]
    for path in parts.paths:
        automaton = _kept(path) if len(parts.paths) == 1 else _load(path)
        for k, words in enumerate(split):
            for begin, end, places in automaton.windows(words):
                spans[k].append((begin, end))
                items[k].update(str(automaton.ids[p]) for p in places if automaton.ids[p] is not None)
    runs = [merged(s) for s in spans]
    return {
        "n_words": [len(w) for w in split], "n_hit": [sum(e - b for b, e in r) for r in runs],
        "items": [sorted(i) for i in items], "begins": [[b for b, _ in r] for r in runs],
        "ends": [[e for _, e in r] for r in runs],
    }


def _without_spans(text: str, runs: list[tuple[int, int]]) -> str:
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for begin, end in runs:
        kept.append(text[at : places[begin][0]])
        at = places[end - 1][1]
    return "".join([*kept, text[at:]])


def all_findings(parts: Parts, batches: Iterator[pd.Series]) -> Iterator[tuple[pd.Series, dict[str, list]]]:
    """Each batch of binary texts with its findings; with several parts, batches are gathered up to HELD_BYTES."""

    def done(held: list[pd.Series]) -> Iterator[tuple[pd.Series, dict[str, list]]]:
        found, at = findings(parts, pd.concat(held, ignore_index=True)), 0
        for texts in held:
            yield texts, {k: v[at : at + len(texts)] for k, v in found.items()}
            at += len(texts)

    held, size = [], 0
    for texts in batches:
        held.append(texts)
        size += sum(len(t) for t in texts if t is not None)
        if len(parts.paths) < 2 or size >= HELD_BYTES:
            yield from done(held)
            held, size = [], 0
    if held:
        yield from done(held)
    release()


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", part_words: int = 200_000, as_col: str = "found",
) -> DataFrame:
    """``docs`` with a struct of findings: n_words, n_hit, items (sorted ids as strings), begins and ends of hit runs.

    Null and empty texts have no words; equal and repeated rows are scanned each; a benchmark without words, or an
    empty table, gives no findings; an item whose id is null marks words but is not listed; whole texts are scanned.
    Columns of ``docs`` stay; one named as ``as_col`` is refused.
    """
    ws = Workspace(docs.sparkSession, "decontam")
    parts = build_automata(ws, benchmark, item_id_col, item_text_col, window, part_words)

    @F.pandas_udf(FINDINGS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for _, found in all_findings(parts, batches):
            yield pd.DataFrame(found)

    if as_col in docs.columns:
        raise ValueError(f"there is a column {as_col} already; name another one")
    return docs.withColumn(as_col, find(F.col(text_col).cast("binary")))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", part_words: int = 200_000,
) -> DataFrame:
    """``docs`` without what it shares with the benchmark: hit runs are cut out of their texts, and a document of
    whose words more than ``max_coverage`` are hit is removed. Other rows, null and empty texts among them, and
    all other columns stay as they are."""
    ws = Workspace(docs.sparkSession, "decontam")
    parts = build_automata(ws, benchmark, item_id_col, item_text_col, window, part_words)

    @F.pandas_udf("n_words long, n_hit long, text string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts, found in all_findings(parts, batches):
            cut = [
                _without_spans(t.decode("utf-8", "replace"), list(zip(b, e))) if b else None
                for t, b, e in zip(texts, found["begins"], found["ends"])
            ]
            yield pd.DataFrame({"n_words": found["n_words"], "n_hit": found["n_hit"], "text": cut})

    own = {c: F.col("doc").getField(c) for c in docs.columns}
    # called not deterministic, so that the filter on its result does not run it a second time
    clean = clean.asNondeterministic()
    rows = docs.select(F.struct("*").alias("doc"), clean(F.col(text_col).cast("binary")).alias("found"))
    stay = rows.where(F.col("found.n_hit") <= max_coverage * F.col("found.n_words"))
    text = F.when(F.col("found.n_hit") > 0, F.col("found.text")).otherwise(own[text_col])
    return stay.select(*[(text if c == text_col else own[c]).alias(c) for c in docs.columns])


def document_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    found = scan_documents(docs.select("doc_id", "text"), benchmark, window)
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), F.col("found.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


UPPER, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS_SQL = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER_LETTERS}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS s
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0
),
placed AS (
  SELECT rid, p, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS s
  FROM d, (SELECT DISTINCT m FROM win) AS sizes, unnest(range(1, len(w) - m + 2)) AS t(p)
),
occ AS (SELECT rid, p, m, item_id FROM placed JOIN win USING (m, s)),
hits AS (
  SELECT rid, count(DISTINCT q) AS n_hit
  FROM (SELECT DISTINCT rid, p, m FROM occ) AS o, unnest(range(p, p + m)) AS t(q) GROUP BY rid
),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM occ) AS o GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""
