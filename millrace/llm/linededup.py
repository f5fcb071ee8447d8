"""Line dedup within an edit bound, by a deletion-neighbourhood join.

Two lines are within one edit when they are equal after deleting the same character of both, or when one is the other
less a character. Lines are first counted by hash, so equal lines are one. Of two lines within the bound, the first or
the last halves are equal, so only lines that share a half with another line go on. These emit all their deletion
variants as hashed keys, equal variants meet, the earliest line of each meeting is the candidate of the others, and
candidates are verified by edit distance. No pairs within a group are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.workspace import Workspace

#: Rolling hash of code points: base and two prime moduli below 2^31, so that products fit in 64 bits.
BASE, MODULI = 1_000_003, (2_147_483_647, 2_147_483_629)
#: A fixed-size membership filter: buckets of 32768 bits, 4 MB in all.
BUCKETS, BITS = 1024, 32768


def _powers(n: int, p: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    found = cache.get(p, np.ones(1, np.uint64))
    while len(found) < n:
        found = np.concatenate([found, found * np.uint64(pow(BASE, len(found), p)) % np.uint64(p)])
    cache[p] = found if len(found) <= 1 << 20 else found[: 1 << 20]
    return found[:n]


def deletion_hashes(line: str) -> tuple[int, np.ndarray]:
    """Hash of the line, and of the line less each of its characters, in time linear in the line."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    whole, parts = 0, np.zeros(len(codes), np.uint64)
    for p in MODULI:
        m = np.uint64(p)
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(len(codes), p) % m) % m])
        after = (before[-1] + m - before[1:]) % m * np.uint64(pow(BASE, -1, p)) % m
        whole = whole << 31 | int(before[-1])
        parts = parts << np.uint64(31) | (before[:-1] + after) % m
    return whole, parts.view(np.int64)


def fixed_filter(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the hashes of ``key``: at most 1024 rows of 4 KB, whatever the number of keys."""
    h = F.xxhash64(key, F.lit("filter"))
    return (
        keys.select(F.pmod(h, F.lit(BUCKETS)).alias("bucket"), F.pmod(F.shiftright(h, 20), F.lit(BITS)).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )


def maybe_in(df: DataFrame, filter_: DataFrame, key: str) -> DataFrame:
    """``df`` with ``maybe``: false only where the key is not among the filter's keys."""
    h = F.xxhash64(key, F.lit("filter"))
    bit = F.pmod(F.shiftright(h, 20), F.lit(BITS))
    marked = df.withColumn("__bucket", F.pmod(h, F.lit(BUCKETS))).withColumn("__bit", bit)
    joined = marked.join(F.broadcast(filter_.withColumnRenamed("bucket", "__bucket")), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (F.col("__bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("__bucket", "__bit", "bits")


def hot_join(
    ws: Workspace, many: DataFrame, counted: DataFrame, key: str, row: list[str], hot_rows: int = 512, salts: int = 64
) -> DataFrame:
    """Inner join of ``many`` with ``counted``, which has each key once, with the number ``n`` of its rows in ``many``.

    ``row`` names the columns that tell rows of a key apart. Rows of keys with over ``hot_rows`` rows are dealt over ``salts`` tasks, and these keys go to all of them. Which
    keys those are is told by a filter of fixed size, on both sides alike, so no row is lost if it says too many.
    """
    filter_ = ws.table(fixed_filter(counted.where(F.col("n") > hot_rows), key), "hot")
    left, right = maybe_in(many, filter_, key), maybe_in(counted.drop("n"), filter_, key)
    salt = F.when(F.col("maybe"), F.pmod(F.xxhash64(*row), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    every = F.when(F.col("maybe"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = left.withColumn("__salt", salt).drop("maybe")
    right = right.withColumn("__salt", F.explode(every)).drop("maybe")
    return left.join(right.hint("merge"), [key, "__salt"]).drop("__salt")


def _lines(placed: DataFrame, min_words: int) -> DataFrame:
    """(id, place, pos, line, h) of the lines that take part: those of ``min_words`` words, without outer white space."""
    each = placed.select("id", "place", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    line = F.btrim("raw", F.lit(" \t\r\f\x0b"))
    enough = rf"^\S+(?:\s+\S+){{{min_words - 1}}}" if min_words > 0 else ""
    return each.select("id", "place", "pos", line.alias("line")).where(F.col("line").rlike(enough)).withColumn(
        "h", F.unhex(F.md5("line"))
    )


def _half_keys(line: Column) -> Column:
    """Hashes of the halves that a line shares with any other line within one edit."""
    n = F.length(line)
    keys = []
    for m in (n, n - 1):  # the length of the shorter of the two lines
        first = F.floor(m / 2).cast("int")
        keys.append(F.xxhash64(F.lit("first"), first, F.substring(line, F.lit(1), first)))
        keys.append(F.xxhash64(F.lit("last"), m - first, F.substring(line, n - (m - first) + 1, m - first)))
    return F.array_distinct(F.array(*keys))


def _near(ws: Workspace, placed: DataFrame, distinct: DataFrame, min_words: int) -> DataFrame:
    """(h) of each line that has an earlier line within one edit."""
    keyed = distinct.select("h", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    meeting = ws.table(keyed.join(shared, "key", "left_semi").select("h").distinct(), "meeting")
    maybe = maybe_in(_lines(placed, min_words), ws.table(fixed_filter(meeting, "h"), "filter"), "h").where("maybe")
    first = maybe.join(meeting, "h", "left_semi").groupBy("h").agg(
        F.min(F.struct("id", "place", "pos")).alias("ord"), F.first("line").alias("line")
    )
    # numbers that follow the order of first occurrence, so that eight bytes of it travel with each variant
    ranged = first.repartitionByRange("ord").sortWithinPartitions("ord")
    texts = ws.table(ranged.select("h", "line", F.monotonically_increasing_id().alias("who")), "texts")

    def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, places, owners, held = [], [], [], 0
            for who, line in zip(batch["who"], batch["line"]):
                whole, parts = deletion_hashes(line)
                hashes.append(np.concatenate([[whole], parts]).astype(np.int64))
                places.append(np.arange(-1, len(parts), dtype=np.int32))
                owners.append(np.full(len(parts) + 1, who))
                held += len(parts)
                if held > 200_000:
                    yield frame(hashes, places, owners)
                    hashes, places, owners, held = [], [], [], 0
            if owners:
                yield frame(hashes, places, owners)

    def frame(hashes, places, owners) -> pd.DataFrame:
        return pd.DataFrame(
            {"vh": np.concatenate(hashes), "at": np.concatenate(places), "who": np.concatenate(owners)}
        )

    emitted = texts.select("who", "line").mapInPandas(variants, "vh long, at int, who long")
    deleted, entire = F.when(F.col("at") >= 0, F.col("who")), F.when(F.col("at") < 0, F.col("who"))
    met = emitted.select(
        "vh", "at", "who",
        F.min(deleted).over(Window.partitionBy("vh", "at")).alias("same_place"),
        F.min(deleted).over(Window.partitionBy("vh")).alias("longer"),
        F.min(entire).over(Window.partitionBy("vh")).alias("shorter"),
    )
    partner = F.when(F.col("at") < 0, F.col("longer")).otherwise(F.least("same_place", "shorter"))
    earlier = (
        met.select("who", partner.alias("other")).where("other < who").groupBy("who").agg(F.min("other").alias("other"))
    )
    verified = earlier.join(texts, "who").join(
        texts.select(F.col("who").alias("other"), F.col("line").alias("other_line")), "other"
    )
    return verified.where(F.levenshtein("line", "other_line", 1).between(0, 1)).select("h")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, edit_bound: int = 1,
    count_cols: bool = False, drop_emptied: bool = False,
) -> DataFrame:
    """``docs`` without the lines that have an earlier line within ``edit_bound`` (0 or 1) character edits.

    Lines are parted by line feeds and compared without outer white space; those of fewer than ``min_words`` words
    stay. Order is by id, then place in the table, then place in the text; null ids come first. Every later
    occurrence of a line goes, within a document too. Null and empty texts stay as they are; rows with repeated ids
    are rows of their own, so the lines of the later ones go; an empty table gives no rows; other columns stay.
    ``count_cols`` adds n_lines and n_removed; ``drop_emptied`` drops documents of which no text is left.
    """
    if edit_bound not in (0, 1):
        raise ValueError("edit_bound is 0 or 1")
    ws = Workspace(docs.sparkSession, "linededup")
    docs = ws.settled(docs)
    # the documents' own columns are kept in a struct, so that no name of theirs can clash
    rows = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("place"))
    own = {c: F.col("doc").getField(c) for c in docs.columns}
    placed = rows.select(own[id_col].alias("id"), "place", own[text_col].cast("string").alias("text"))
    lines = ws.table(
        _lines(placed, min_words).select("id", "place", "pos", "h", _half_keys(F.col("line")).alias("keys")), "lines"
    )
    distinct = lines.groupBy("h").agg(
        F.min(F.struct("id", "place", "pos")).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")
    )
    distinct = ws.table(distinct, "distinct")
    repeated = distinct.where("n > 1").select("h", "first", "n")
    if edit_bound:
        near = _near(ws, placed, distinct.select("h", "keys"), min_words).distinct()
        repeated = repeated.join(near.withColumn("near", F.lit(True)), "h", "full")
    else:
        repeated = repeated.withColumn("near", F.lit(False))
    repeated = ws.table(repeated.withColumn("n", F.coalesce("n", F.lit(1).cast("long"))), "repeated")
    later = F.coalesce(F.col("near"), F.lit(False)) | (F.struct("id", "place", "pos") > F.col("first"))
    # these tables grow with the documents, so they are joined by shuffles at every size
    gone = hot_join(ws, lines.select("id", "place", "pos", "h"), repeated, "h", ["place", "pos"]).where(later)
    removed = ws.table(gone.groupBy("place").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "removed")

    filter_ = ws.table(fixed_filter(removed, "place"), "filter")
    marked = maybe_in(rows, filter_, "place")
    hit = marked.where("maybe").join(removed.hint("merge"), "place", "left")
    out = hit.unionByName(marked.where("not maybe").withColumn("gone", F.lit(None).cast("array<int>")))
    parts = F.split(own[text_col].cast("string"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))  # by a hash set of the places
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    out = out.withColumn("new", F.when(F.col("gone").isNotNull(), kept).otherwise(own[text_col]))
    if drop_emptied:
        out = out.where(F.col("gone").isNull() | F.col("new").rlike(r"\S"))
    n_lines = F.when(own[text_col].isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed")
    return out.select(
        *[(F.col("new") if c == text_col else own[c]).alias(c) for c in docs.columns],
        *([n_lines, n_removed] if count_cols else []),
    )


_TRIMMED = r"regexp_replace(raw, '^[ \t\r\f\x0b]+|[ \t\r\f\x0b]+$', '', 'g')"
ORACLE_SQL = rf"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
e AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM s),
a AS (SELECT doc_id, pos, raw, {_TRIMMED} AS line FROM e),
l AS (SELECT *, len(regexp_split_to_array(line, '\s+')) >= 5 AS counts FROM a),
u AS (SELECT line, min((doc_id, pos)) AS ord FROM l WHERE counts GROUP BY line),
v AS (
  SELECT line, ord, i, hash(left(line, i - 1) || substr(line, i + 1)) AS vh
  FROM u, unnest(range(1, length(line) + 1)) AS t(i)
),
w AS (SELECT line, ord, hash(line) AS vh FROM u),
same AS (SELECT vh, i, min(ord) AS ord FROM v GROUP BY vh, i HAVING count(*) > 1),
near AS (
  SELECT v.line FROM v JOIN same USING (vh, i) WHERE same.ord < v.ord
  UNION SELECT v.line FROM v JOIN w USING (vh) WHERE w.ord < v.ord
  UNION SELECT w.line FROM v JOIN w USING (vh) WHERE v.ord < w.ord
),
g AS (
  SELECT l.doc_id, l.pos, l.raw, coalesce(
    l.counts AND (u.ord < (l.doc_id, l.pos) OR l.line IN (SELECT line FROM near)), false) AS gone
  FROM l LEFT JOIN u ON l.line = u.line
),
r AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id
)
SELECT s.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN coalesce(n_removed, 0) = 0 THEN s.text ELSE coalesce(kept, '') END AS text
FROM s LEFT JOIN r ON s.doc_id = r.doc_id
"""
