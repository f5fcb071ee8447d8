"""Penalised change points of many daily series: segment-neighbourhood dynamic programming, a batch of series at a time.

The best cost of every number of segments and every end day is found exactly; the penalties are added to those of the
last day, the least total wins (ties: fewest segments), and the starts are traced back, the earliest where several do.

Rows are summed by series and day, map side first, so a series that holds a third of all rows comes to its days. A task
gets series as arrays of their days; its memory is bounded by ``CELLS`` states, or by one series where that has more.
A series of ``d`` days takes about d^3 / (2 * min_days) steps and 12 * d^2 / min_days bytes, whatever its number of rows:
0.2 MB for a year, 30 MB for ten.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.workspace import prepared

#: States (series, number of segments, end day) that a task holds at once; 8 bytes each.
CELLS = 1 << 19
NONE = np.iinfo(np.int64).max // 4


@dataclass(frozen=True)
class SegmentParams:
    """``min_days`` of a segment, ``penalty`` of each cut, and the factor of the logarithm in a day's cost."""

    min_days: int = 5
    penalty: int = 10_000
    scale: int = 1_000

    def __post_init__(self):
        if self.min_days < 1 or self.penalty < 0 or self.scale < 1:
            raise ValueError("min_days and scale must be at least 1, and penalty not negative")


def daily_totals(rows: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """(key, days, totals): the different days of each key, in order, and the sum of ``value`` on each."""
    summed = rows.groupBy(key, day).agg(F.sum(F.col(value).cast("long")).alias("total"))
    each = F.array_sort(F.collect_list(F.struct(F.col(day).cast("long").alias("day"), "total")))
    return summed.groupBy(key).agg(each.alias("s")).select(key, F.col("s.day").alias("days"), F.col("s.total").alias("totals"))


def spread_of(n, total, squares):
    """V of segments of ``n`` days: one more than the variance, as an exact integer."""
    return 1 + (n * squares - total * total) // (n * n)


def cost_of(n, spread, scale: int) -> np.ndarray:
    return n * np.floor(scale * np.log(np.asarray(spread, np.float64))).astype(np.int64)


def _sums(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values and of their squares, a row for each series; Python's integers where 64 bits are too few."""
    width = max(map(len, series))
    most = max((int(np.abs(s).max()) for s in series if len(s)), default=0)
    kind = np.int64 if width * width * most * most < 2**62 else object
    padded = np.zeros((len(series), width + 1), kind)
    for row, s in zip(padded, series):
        row[1 : len(s) + 1] = s
    return padded.cumsum(axis=1), (padded * padded).cumsum(axis=1)


def segment(series: list[np.ndarray], params: SegmentParams) -> list[tuple[list[int], int]]:
    """(starts, best cost with penalties) of each series of whole numbers, one value for each day."""
    least = params.min_days
    total, squares = _sums(series)
    count, width = total.shape[0], total.shape[1] - 1
    most = max(1, width // least)
    lengths = np.array([len(s) for s in series])
    best = np.full((count, most, width + 1), NONE, np.int64)  # of k + 1 segments that end before a day
    came = np.zeros((count, most, width + 1), np.int32)  # where the last of them starts

    def costs(ends: int, starts: np.ndarray) -> np.ndarray:
        n = ends - starts
        sums = total[:, ends, None] - total[:, starts]
        return cost_of(n, spread_of(n, sums, squares[:, ends, None] - squares[:, starts]), params.scale)

    for end in range(1, width + 1):
        if end < least:  # only a whole series may be as short as this
            best[:, 0, end] = np.where(lengths == end, costs(end, np.zeros(1, np.int64))[:, 0], NONE)
            continue
        starts = np.arange(0, end - least + 1)
        cost = costs(end, starts)
        best[:, 0, end] = cost[:, 0]
        known = min(most, end // least) - 1
        if known > 0:
            # the first of the least is the earliest start; states that cannot be have a cost beyond all others
            sums = best[:, :known, : end - least + 1] + cost[:, None, :]
            at = sums.argmin(axis=2)
            came[:, 1 : known + 1, end] = at
            best[:, 1 : known + 1, end] = np.minimum(np.take_along_axis(sums, at[:, :, None], 2)[:, :, 0], NONE)
    out = []
    for i, n in enumerate(lengths.tolist()):
        totals = best[i, :, n] + params.penalty * np.arange(most)
        k = int(totals.argmin())  # the first of the least has the fewest segments
        cost, starts, end = int(totals[k]), [], n
        for left in range(k, -1, -1):
            end = int(came[i, left, end]) if left else 0
            starts.append(end)
        out.append((starts[::-1], cost))
    return out


def _batches(lengths: list[int], params: SegmentParams) -> Iterator[list[int]]:
    """Places of series that are worked on together: of about the same length, and as many as ``CELLS`` lets in."""
    held: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        states = (lengths[held[0]] if held else lengths[i]) ** 2 // params.min_days + 1
        if held and (len(held) + 1) * states > CELLS:
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def change_points(rows: DataFrame, key: str, day: str, value: str, params: SegmentParams | None = None) -> DataFrame:
    """One row for each segment of each key's series of daily sums of ``value``; ``day`` is a whole number of days.

    A series runs from its first to its last day with rows; days between without any have the sum 0. Segments have at
    least ``min_days`` days, a shorter series is one segment. Cost of a segment of ``n`` days: n * floor(scale * ln(V)),
    V = 1 + floor((n * Q - S * S) / (n * n)) with the sum S and the sum of squares Q. Rows with a null day or value count
    for nothing; rows with a null key are the series of null. An empty table gives no rows.
    """
    params = params or SegmentParams()
    prepared(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    taken = rows.select(F.col(key).alias("key"), F.col(day).alias("day"), F.col(value).alias("value"))
    series = daily_totals(taken.where("day is not null and value is not null"), "key", "day", "value")
    names = ("segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost")
    kinds = ("int", *["long"] * 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense, firsts = [], []
            for days, totals in zip(batch.column("days"), batch.column("totals")):
                days, totals = days.values.to_numpy(), totals.values.to_numpy()
                values = np.zeros(int(days[-1] - days[0]) + 1, np.int64)
                values[days - days[0]] = totals
                dense.append(values)
                firsts.append(int(days[0]))
            for places in _batches([len(v) for v in dense], params):
                found = segment([dense[i] for i in places], params)
                source, rows_ = [], []
                for i, (starts, best_cost) in zip(places, found):
                    values = dense[i].tolist()
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(values)])):
                        n, s, q = b - a, sum(values[a:b]), sum(v * v for v in values[a:b])
                        v = spread_of(n, s, q)
                        cost = int(cost_of(n, v, params.scale))
                        rows_.append((k + 1, firsts[i] + a, n, s, v, cost, len(starts), best_cost))
                        source.append(i)
                keys = batch.column("key").take(pa.array(source, pa.int64()))
                columns = [pa.array(c, pa.int32() if t == "int" else pa.int64()) for c, t in zip(zip(*rows_), kinds)]
                yield pa.RecordBatch.from_arrays([keys, *columns], ["key", *names])

    schema = f"key {kind}, " + ", ".join(f"{n} {t}" for n, t in zip(names, kinds))
    return series.mapInArrow(run, schema).withColumnRenamed("key", key)


def vendor_segments(sale_lines: DataFrame, params: SegmentParams | None = None) -> DataFrame:
    """Segments of the quantity that each vendor shipped by day, of the lines that were kept or swapped."""
    lines = sale_lines.where(F.col("flag").isin("kept", "swapped")).select(
        "vendor_id", F.unix_date(F.col("shipped_at").cast("date")).alias("day"), "quantity"
    )
    return change_points(lines, "vendor_id", "day", "quantity", params)


ORACLE_SQL = """
WITH RECURSIVE t AS (
  SELECT vendor_id, date_diff('day', DATE '1970-01-01', shipped_at::DATE)::BIGINT AS day, sum(quantity)::BIGINT AS q
  FROM sale_lines WHERE flag IN ('kept', 'swapped') AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL),
r AS (SELECT vendor_id, min(day) AS d0, max(day) - min(day) + 1 AS n FROM t GROUP BY ALL),
g AS (SELECT vendor_id, d0, n, unnest(range(n)) AS i FROM r),
v AS (SELECT g.vendor_id, g.n, g.i, coalesce(t.q, 0) AS q
      FROM g LEFT JOIN t ON t.vendor_id IS NOT DISTINCT FROM g.vendor_id AND t.day = g.d0 + g.i),
p AS (SELECT vendor_id, n, i + 1 AS i, sum(q) OVER w AS s, sum(q * q) OVER w AS q FROM v
      WINDOW w AS (PARTITION BY vendor_id ORDER BY i)
      UNION ALL SELECT vendor_id, n, 0, 0, 0 FROM r),
c AS (SELECT a.vendor_id, a.n, a.i AS a, b.i AS b, (b.s - a.s)::BIGINT AS total,
      (1 + ((b.i - a.i) * (b.q - a.q) - (b.s - a.s) * (b.s - a.s)) // ((b.i - a.i) * (b.i - a.i)))::BIGINT AS spread
      FROM p a JOIN p b ON a.vendor_id IS NOT DISTINCT FROM b.vendor_id AND a.i < b.i
      AND (b.i - a.i >= 5 OR (a.i = 0 AND b.i = b.n))),
k AS (SELECT *, ((b - a) * floor(1000 * ln(spread::DOUBLE)))::BIGINT AS cost FROM c),
best AS (SELECT vendor_id, n, 1 AS m, b, cost FROM k WHERE a = 0
         UNION ALL
         SELECT h.vendor_id, h.n, h.m + 1, k.b, min(h.cost + k.cost)
         FROM best h JOIN k ON k.vendor_id IS NOT DISTINCT FROM h.vendor_id AND k.a = h.b GROUP BY ALL),
o AS (SELECT vendor_id, n, arg_min(m, [cost + 10000 * (m - 1), m]) AS m, min(cost + 10000 * (m - 1)) AS best_cost
      FROM best WHERE b = n GROUP BY ALL),
back AS (SELECT vendor_id, m AS no, n AS b, (SELECT min(k.a) FROM k LEFT JOIN best h ON h.vendor_id IS NOT DISTINCT FROM k.vendor_id
           AND h.b = k.a AND h.m = o.m - 1 WHERE k.vendor_id IS NOT DISTINCT FROM o.vendor_id AND k.b = o.n
           AND (CASE WHEN o.m = 1 THEN k.a = 0 ELSE h.cost + k.cost + 10000 * (o.m - 1) = o.best_cost END)) AS a,
           m AS n_segments, best_cost FROM o
         UNION ALL
         SELECT z.vendor_id, z.no - 1, z.a, min(k.a), z.n_segments, z.best_cost
         FROM back z JOIN k ON k.vendor_id IS NOT DISTINCT FROM z.vendor_id AND k.b = z.a
         JOIN best e ON e.vendor_id IS NOT DISTINCT FROM z.vendor_id AND e.b = z.a AND e.m = z.no - 1
         LEFT JOIN best h ON h.vendor_id IS NOT DISTINCT FROM z.vendor_id AND h.b = k.a AND h.m = z.no - 2
         WHERE z.no > 1 AND (CASE WHEN z.no = 2 THEN k.a = 0 ELSE h.cost + k.cost = e.cost END)
         GROUP BY z.vendor_id, z.no, z.a, z.n_segments, z.best_cost)
SELECT z.vendor_id, z.no::INT AS segment_no, (r.d0 + z.a)::BIGINT AS first_day, (z.b - z.a)::BIGINT AS n_days, k.total, k.spread,
  k.cost, z.n_segments::BIGINT AS n_segments, z.best_cost::BIGINT AS best_cost
FROM back z JOIN r ON r.vendor_id IS NOT DISTINCT FROM z.vendor_id
JOIN k ON k.vendor_id IS NOT DISTINCT FROM z.vendor_id AND k.a = z.a AND k.b = z.b
"""
