"""How filters that run one after the other interact, for every order of them, by Walsh-Hadamard transform.

A row fails any of ``n`` filters; which ones is its mask. The table is aggregated once into 2^n signed parity sums for
each part and kind of label: the sum for a set of filters adds up every row with the sign of how many filters of the set
it fails. The transform is its own inverse up to 2^n, so the sums give the number of rows of every mask exactly, and from
these follow what each filter removes at each place of each of the n! orders. What is shuffled are parity sums; nothing
is run again for an order.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.workspace import prepared
from millrace.plans import computed

#: White space between words beside the space, and the characters of which one is enough to fail filter D; fixed values.
OTHER_BLANKS = r"[\x09-\x0D]"
MARKS = "[#$%&*|]"


def mask_of(fails: dict[str, Column]) -> Column:
    """Bit k is 1 where the k-th condition holds; a condition that is null does not hold."""
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(fails.values())]
    return reduce(Column.bitwiseOR, bits)


def parity_sums(rows: DataFrame, n: int, by: list[str], mask: str = "mask", weight: str = "n") -> DataFrame:
    """A row for each group of ``by``, with ``sums``: the 2^n signed sums of ``weight``, by set of filters."""
    odd = lambda s: F.bit_count(F.col(mask).bitwiseAND(F.lit(s))) % 2
    signed = [F.sum(F.col(weight) * (1 - 2 * odd(s))) for s in range(1 << n)]
    return rows.groupBy(*by).agg(F.array(*signed).alias("sums"))


def cells_of(sums: Column, n: int) -> Column:
    """The number of rows of each mask, from the parity sums: the same transform once more, and one exact division."""
    size = 1 << n
    sign = lambda m, s: 1 - 2 * (F.bit_count(m.bitwiseAND(s.cast("int"))) % 2)
    add = lambda m: F.aggregate(
        F.transform(sums, lambda v, s: v * sign(m, s)), F.lit(0).cast("long"), lambda a, v: a + v
    )
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.shiftright(add(m), n))


def _total(cells: Column, which) -> Column:
    """The sum of the cells whose mask satisfies ``which``."""
    taken = F.transform(cells, lambda c, m: F.when(which(m.cast("int")), c).otherwise(F.lit(0).cast("long")))
    return F.aggregate(taken, F.lit(0).cast("long"), lambda a, c: a + c)


def audit_orders(sums: DataFrame, filters: str, labels: tuple[str, ...] = (), part: str = "part") -> DataFrame:
    """One row for each part, order of the filters and step, from ``parity_sums`` by part and by boolean ``labels``.

    ``kept`` rows pass this step and all before; ``removed`` fall here; ``redundant`` fail this filter but fell earlier;
    ``unique_fails`` fail this filter alone; ``<label>_lost`` are the removed ones of a label. ``shapley`` is what the
    filter removes, summed over all orders: of ``k`` filters that a row fails, each comes first in n!/k orders.
    """
    n = len(filters)
    orders = ["".join(p) for p in permutations(filters)]
    added = [F.array(*[F.sum(F.when(who, F.col("cells")[m]).otherwise(0)) for m in range(1 << n)]).alias(name)
             for name, who in (("every", F.lit(True)), *[(f"of_{c}", F.col(c)) for c in labels])]
    parts = computed(sums.select(part, *labels, "sums"), cells=cells_of(F.col("sums"), n)).groupBy(part).agg(*added)
    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(n)))
    )
    letters = F.split("filter_order", "")
    bit = lambda c: F.call_function("shiftleft", F.lit(1), (F.instr(F.lit(filters), c) - 1).cast("int"))
    before = F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, c: a.bitwiseOR(bit(c)))
    placed = computed(steps, own=bit(F.element_at(letters, F.col("step"))), before=before)
    own, earlier = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    fell = lambda m: m.bitwiseAND(earlier) != 0
    here = lambda m: fails(m) & ~fell(m)
    every = F.col("every")
    share = F.transform(every, lambda c, m: F.when(
        fails(m.cast("int")), c * (F.lit(factorial(n)) / F.bit_count(m.cast("int"))).cast("long")
    ).otherwise(F.lit(0).cast("long")))
    return placed.select(
        part, "filter_order", "step",
        _total(every, lambda m: ~fails(m) & ~fell(m)).alias("kept"), _total(every, here).alias("removed"),
        _total(every, lambda m: fails(m) & fell(m)).alias("redundant"),
        _total(every, lambda m: m == own).alias("unique_fails"),
        *[_total(F.col(f"of_{c}"), here).alias(f"{c}_lost") for c in labels],
        F.aggregate(share, F.lit(0).cast("long"), lambda a, c: a + c).alias("shapley"),
    )


def repeats_earlier(rows: DataFrame, key: str, id_col: str, by: list[str], weight: str = "n") -> DataFrame:
    """``rows`` summed by ``key``, ``by`` and ``repeats``: whether a row of a smaller id has the same key.

    ``rows`` has each (id, key, by) once, with its number of rows. A key's rows are summed, map side first, before they
    meet, so a group of copies of any size comes to one row for each combination of ``by``.
    """
    id_ = F.col(id_col)
    met = rows.groupBy(key, *by).agg(
        F.sum(weight).alias("all"), F.min(F.when(id_.isNotNull(), F.struct(id_.alias("id"), F.col(weight).alias("k")))).alias("first"),
        F.sum(F.when(id_.isNull(), F.col(weight)).otherwise(0)).alias("unnamed"),
    )
    least = F.min("first.id").over(Window.partitionBy(key))
    apart = F.when(F.col("first.id") == F.col("least"), F.col("first.k")).otherwise(0) + F.col("unnamed")
    both = F.array(
        F.struct(F.lit(False).alias("repeats"), apart.alias("k")), F.struct(F.lit(True).alias("repeats"), (F.col("all") - apart).alias("k"))
    )
    split = met.withColumn("least", least).select(*by, F.explode(both).alias("s"))
    return split.select(*by, "s.repeats", F.col("s.k").alias(weight)).where(F.col(weight) > 0)


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The conditions A to D on a whole text and its words."""
    n, different = F.size(words), F.size(F.array_distinct(words))
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    return {"A": n < 100, "B": 100 * different < 80 * n, "C": 100 * upper > 10 * F.length(text), "D": text.rlike(MARKS)}


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters on whole ``docs`` (doc_id, text, lang), by language, with what they lose of each label.

    Null texts are empty, and a null language is the empty one. E looks at smaller ids in the whole table, whether or not
    their rows are removed; a null id is smaller or greater than none. Labels of an id that has several rows hold if any
    row has them. Repeated rows count each. An empty table gives no rows. Other columns are not looked at.
    """
    prepared(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # parting at a single letter, here the space, needs no regular expression
    spelt = computed(whole, words=F.array_remove(F.split(F.regexp_replace("text", OTHER_BLANKS, " "), " "), ""))
    mask = mask_of(text_failures(F.col("text"), F.col("words")))
    judged = spelt.select("id", "part", F.unhex(F.sha2("text", 256)).alias("key"), mask.alias("mask"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    each = judged.groupBy("id", "part", "key", "mask").agg(F.count("*").alias("n"))
    labelled = each.join(known, "id", "left").fillna(False, ["good", "toxic"])
    rows = repeats_earlier(labelled, "key", "id", ["part", "good", "toxic", "mask"])
    masked = rows.withColumn("mask", F.col("mask").bitwiseOR(F.when(F.col("repeats"), F.lit(16)).otherwise(F.lit(0))))
    return audit_orders(parity_sums(masked, 5, ["part", "good", "toxic"]), "ABCDE", ("good", "toxic"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
      [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
       100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
       coalesce(w.doc_id > least, false)] AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [a.i, b.i, p.i, q.i, r.i] AS ord FROM x a, x b, x p, x q, x r
      WHERE len(list_distinct([a.i, b.i, p.i, q.i, r.i])) = 5),
s AS (SELECT ord, array_to_string(list_transform(ord, lambda i: substr('ABCDE', (i + 1)::INT, 1)), '') AS filter_order,
      k.i AS k FROM o, x k),
e AS (SELECT part, filter_order, k + 1 AS step, ord[k + 1] AS own, n, good, toxic, fails[ord[k + 1] + 1] AS bad,
      len(list_filter(ord[1:k], lambda i: fails[i + 1])) > 0 AS fell,
      len(list_filter(fails, lambda b: b)) AS n_bad FROM c, s),
g AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT bad AND NOT fell THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN bad AND NOT fell THEN n ELSE 0 END) AS removed, sum(CASE WHEN bad AND fell THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN bad AND n_bad = 1 THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN bad AND NOT fell AND good THEN n ELSE 0 END) AS good_lost,
      sum(CASE WHEN bad AND NOT fell AND toxic THEN n ELSE 0 END) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g
"""
