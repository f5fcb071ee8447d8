"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found by pattern in whole texts. The hash of each candidate's value is counted by distinct
repositories and distinct owners over the corpus: a value that many owners hold is a copied example, one that few
hold is a live-looking credential of theirs. The base kinds (``assign``, ``access``, ``hex``) are always reported;
bare high-entropy tokens (``token``) are added where their value is live-looking and no base span covers them.

Places come from splitting: matches are wrapped in a private-use character that the text no longer contains, the
text is split there, and the lengths of the pieces are summed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.workspace import Workspace
from millrace.plans import computed

# Fixed values of the contract: the patterns, with letters of the keywords in either case, and the least lengths.
_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in _KEYWORDS)
ASSIGN = f"({_EITHER})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
#: Numbers that are summed up in one stretch, and tasks that the rows of a hash are dealt over.
STRETCH, SALTS = 256, 16
KINDS = ("assign", "access", "hex", "token")
LEAST_ASSIGNED = 6
#: Private-use characters: around a match, before its value, and what replaces them in texts that have them.
AROUND, VALUE, OTHER = "\ue000", "\ue001", "\ue002"


@dataclass(frozen=True)
class SecretParams:
    example_owners: int = 3  # a value of so many owners or repositories is a copied example


def _may_match(text: Column) -> list[Column]:
    """Of each kind a quick test that no text with a match fails: searches for words, and runs that begin a token."""
    lower, begins = F.lower(text), "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}"
    named = F.contains(lower, F.lit("apikey"))
    for word in ("password", "passwd", "secret", "token", "api_key"):
        named = named | F.contains(lower, F.lit(word))
    return [named & text.rlike(ASSIGN), F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS), text.rlike(HEX), text.rlike(begins)]


def _pieces(text: Column, pattern: str, value_group: int, found: Column) -> Column:
    """The text parted before and after the leftmost non-overlapping matches, each with its value; null without any."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{AROUND}$0{VALUE}${value_group}{AROUND}"))
    return F.when(found, F.split(marked, AROUND))


def _sums(numbers: Column, start: Column) -> Column:
    """``start`` plus the sum of all numbers up to each. Takes time in proportion to the square of their number."""
    zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("sums"))
    return F.aggregate(
        numbers,
        zero,
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["sums"], F.array(acc["at"] + n)).alias("sums")),
    )["sums"]


def running_sums(numbers: Column) -> Column:
    """The sums of all numbers up to each, by stretches of STRETCH numbers, so very many take time in proportion."""
    n_stretches = F.ceil(F.size(numbers) / STRETCH).cast("int")
    stretches = F.transform(F.sequence(F.lit(1), n_stretches), lambda k: F.slice(numbers, (k - 1) * STRETCH + 1, F.lit(STRETCH)))
    add = lambda s: F.aggregate(s, F.lit(0), lambda a, n: a + n)
    ends = _sums(F.transform(stretches, add), F.lit(0))
    each = F.arrays_zip(stretches.alias("s"), ends.alias("e"))
    return F.flatten(F.transform(each, lambda x: _sums(x["s"], x["e"] - add(x["s"]))))


def _matches(pieces: Column, ends: Column, kind: int) -> Column:
    """array<struct<begin, end, kind, value>> of the matches that parted a text, in code points."""
    both = F.arrays_zip(pieces.alias("piece"), ends.alias("end"))
    placed = F.transform(
        both,
        lambda x, i: F.struct(
            (x["end"] - F.length(F.substring_index(x["piece"], VALUE, 1))).alias("begin"), x["end"].alias("end"),
            F.lit(kind).alias("kind"), F.substring_index(x["piece"], VALUE, -1).alias("value"), i.alias("i"),
        ),
    )
    odd = F.filter(placed, lambda x: x["i"] % 2 == 1)
    found = F.transform(odd, lambda x: F.struct(x["begin"], x["end"], x["kind"], x["value"]))
    none = F.array().cast("array<struct<begin:int,end:int,kind:int,value:string>>")
    return F.when(pieces.isNotNull(), found).otherwise(none)


def candidates(docs: DataFrame, text_col: str, carry: list[Column]) -> DataFrame:
    """``carry`` with ``base`` and ``bare``: the spans of the base kinds, and tokens that no base span covers."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    has_marks = F.contains(text, F.lit(AROUND)) | F.contains(text, F.lit(VALUE))
    text = F.when(has_marks, F.translate(text, AROUND + VALUE, OTHER + OTHER)).otherwise(text)
    # each step is computed once: the optimizer would write the patterns into every use of their matches
    found = docs.select(*carry, text.alias("__t"))
    names = found.columns[:-1]
    found = computed(found, __t=F.col("__t"))
    may, kinds = _may_match(F.col("__t")), ((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (TOKEN, 0))
    parted = {f"__p{k}": _pieces(F.col("__t"), p, g, may[k]) for k, (p, g) in enumerate(kinds)}
    found = computed(found, **parted).drop("__t")
    lengths = lambda c: F.transform(c, lambda p: F.length(F.substring_index(p, VALUE, 1)))
    found = computed(found, **{f"__n{k}": lengths(F.col(f"__p{k}")) for k in range(4)})
    found = computed(found, **{f"__e{k}": F.when(F.col(f"__n{k}").isNotNull(), running_sums(F.col(f"__n{k}"))) for k in range(4)})
    matches = [_matches(F.col(f"__p{k}"), F.col(f"__e{k}"), k) for k in range(4)]
    assigned = F.filter(matches[0], lambda x: F.length(x["value"]) >= LEAST_ASSIGNED)
    mixed = F.filter(matches[3], lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))
    found = computed(found, base=F.array_sort(F.concat(assigned, matches[1], matches[2])), __mixed=mixed)
    bare = F.filter(
        F.col("__mixed"),
        lambda x: ~F.exists(F.col("base"), lambda b: (b["begin"] < x["end"]) & (x["begin"] < b["end"])),
    )
    return found.select(*names, "base", bare.alias("bare"))


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["begin"], x["end"])), ",")


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source",
    owner_col: str = "source", params: SecretParams = SecretParams(),
) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) of each row.

    Null texts are empty and have no spans; a null repository or owner is one of its own; rows with equal or null
    ids are scanned each; whole texts are scanned. Texts do not leave the scan: what is shuffled are candidates.
    """
    ws = Workspace(docs.sparkSession, "secrets")
    owner, repo = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (owner_col, repo_col))
    carry = [
        F.col(id_col).alias("id"), repo.alias("repo"), owner.alias("owner"),
        F.monotonically_increasing_id().alias("row"),
    ]
    found = ws.table(candidates(docs, text_col, carry), "candidates")
    empty = found.where((F.size("base") == 0) & (F.size("bare") == 0)).select(
        "id", F.array().cast("array<struct<begin:int,end:int,kind:int,live:boolean>>").alias("all")
    )
    each = found.select("id", "row", "repo", "owner", F.explode(F.concat("base", "bare")).alias("s")).select(
        "id", "row", "repo", "owner", "s.*", F.sha2("s.value", 256).alias("hash")
    )
    held = each.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    spread = held.groupBy("hash").agg(
        F.greatest(F.countDistinct("repo"), F.countDistinct("owner")).alias("holders")
    )
    live = F.col("holders") < params.example_owners
    # a copied example that very many rows hold is judged in SALTS tasks, each of which has the count of its holders
    salted = each.withColumn("salt", F.pmod(F.xxhash64("row", "begin"), F.lit(SALTS)).cast("int"))
    every = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = salted.join(every, ["hash", "salt"]).withColumn("live", live).where((F.col("kind") < 3) | F.col("live"))
    gathered = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "kind", "live"))).alias("all"))
    full = found.where((F.size("base") > 0) | (F.size("bare") > 0)).select("id", "row").join(gathered, "row", "left")
    none = F.array().cast("array<struct<begin:int,end:int,kind:int,live:boolean>>")
    everything = empty.unionByName(full.select("id", F.coalesce("all", none).alias("all")))
    # spans come in order of begin, then kind; the end lies between in the struct, so order again without it
    ordered = F.array_sort(F.transform("all", lambda x: F.struct(x["begin"], x["kind"], x["end"], x["live"])))
    base = F.filter(F.col("spans_"), lambda x: x["kind"] < 3)
    return everything.select("id", ordered.alias("spans_")).select(
        F.col("id").alias(id_col),
        *[_count(F.col("spans_"), k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans_")).alias("spans"),
        F.size(F.filter("spans_", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans_", lambda x: ~x["live"])).cast("long").alias("n_example"),
    )


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_PARTS = " UNION ALL ".join(
    f"SELECT rid, {k} AS k, string_split(regexp_replace(txt, {_sql(p)}, chr(57344) || '\\0' || chr(57345) || '\\{g}' "
    f"|| chr(57344), 'g'), chr(57344)) AS parts FROM t"
    for k, (p, g) in enumerate(((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (TOKEN, 0)))
)
_NAME = "(['assign', 'access', 'hex', 'token'])[k + 1] || ':' || b || ':' || e"
ORACLE_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner,
    translate(coalesce(text, ''), chr(57344) || chr(57345), chr(57346) || chr(57346)) AS txt FROM documents
),
m AS ({_PARTS}),
p AS (SELECT rid, k, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM m WHERE len(parts) > 1),
q AS (SELECT rid, k, i, split_part(part, chr(57345), 1) AS seg, split_part(part, chr(57345), 2) AS val FROM p),
r AS (SELECT *, sum(length(seg)) OVER (PARTITION BY rid, k ORDER BY i) AS e FROM q),
found AS (
  SELECT rid, k, CAST(e - length(seg) AS BIGINT) AS b, CAST(e AS BIGINT) AS e, val FROM r
  WHERE i % 2 = 0 AND (k <> 0 OR length(val) >= 6)
    AND (k <> 3 OR (regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')))
),
uncovered AS (
  SELECT f.* FROM found AS f WHERE k < 3 OR NOT EXISTS (
    SELECT 1 FROM found AS g WHERE g.rid = f.rid AND g.k < 3 AND g.b < f.e AND f.b < g.e)
),
spread AS (SELECT val, count(DISTINCT owner) AS holders FROM uncovered JOIN t USING (rid) GROUP BY val),
kept AS (SELECT rid, k, b, e, holders < 3 AS live FROM uncovered JOIN spread USING (val) WHERE k < 3 OR holders < 3),
g AS (
  SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
    string_agg({_NAME}, ',' ORDER BY b, k) FILTER (k < 3) AS base, string_agg({_NAME}, ',' ORDER BY b, k) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM kept GROUP BY rid
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN g USING (rid)
"""
