"""Quality evaluation of chunks, the ready filter, and the inspection sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.config import ChunkingConfig
from millrace.functions import text as T
from millrace.operators.chunking import token_count
from millrace.plans import kept, numbered
from millrace.session import ship_package

REQUIRED = ("chunk_id", "source_url", "title", "chunk_index", "text")
POLICY = "preserve_question_headings"


def _missing(col: str) -> Column:
    return F.col(col).isNull() | (F.col(col).cast("string") == "")


def flag_duplicates(chunks: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """``chunks`` with ``is_duplicate``: whether another row has the hash. Counts are joined, so a hash that very many
    rows share is counted in parts and its rows are not brought together."""
    counts = chunks.groupBy(hash_col).agg((F.count("*") > 1).alias("is_duplicate"))
    return chunks.join(counts.where("is_duplicate"), hash_col, "left").withColumn(
        "is_duplicate", F.coalesce("is_duplicate", F.lit(False))
    )


def chunk_issues(chunks: DataFrame, config: ChunkingConfig = ChunkingConfig(), position_col: str | None = None) -> DataFrame:
    """``chunks`` with ``issue_id`` and ``issues``, the sorted names of what is wrong, and ``short_faq``.

    Counts and hashes that are missing or null are computed. All rows of a repeated text are flagged. A short answer
    to a question heading is kept. A chunk without an id is named by its position from 0: that of ``position_col``, or
    else its place in the order of the table's files, which is looked up only if there is such a chunk.
    """
    ship_package(chunks.sparkSession)
    have = set(chunks.columns)
    col = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    text = F.coalesce(col("text", "string"), F.lit(""))
    nameless = F.coalesce(col("chunk_id", "string"), F.lit("")) == ""
    if position_col is None and not chunks.where(nameless).isEmpty():
        chunks, position_col = numbered(kept(chunks), "__place"), "__place"
    position = F.lit(None) if position_col is None else F.col(position_col)
    full = chunks.withColumn("__position", position.cast("string"))
    for name, kind in (("chunk_id", "string"), ("source_url", "string"), ("title", "string"), ("chunk_index", "int")):
        full = full.withColumn(name, col(name, kind))
    full = (
        full.withColumn("text", col("text", "string"))
        .withColumn("word_count", F.coalesce(col("word_count", "int"), T.word_count(text)))
        .withColumn("token_count", F.coalesce(col("token_count", "int"), token_count(text, config.tokens)))
        .withColumn("content_hash", F.coalesce(F.nullif(col("content_hash", "string"), F.lit("")), T.content_hash(text)))
        .withColumn("is_faq", F.coalesce(col("is_faq", "boolean"), F.lit(False)))
    )
    full = flag_duplicates(full)
    missing = _missing(REQUIRED[0])
    for name in REQUIRED[1:]:
        missing = missing | _missing(name)
    short = F.col("word_count") < config.min_words
    named = F.array_compact(
        F.array(
            F.when(F.col("is_duplicate"), F.lit("duplicate_text")),
            F.when(F.coalesce("text", F.lit("")) == "", F.lit("empty_text")),
            F.when(missing, F.lit("missing_metadata")),
            F.when(F.col("token_count") > config.max_tokens, F.lit("too_long")),
            F.when(short & ~F.col("is_faq"), F.lit("too_short")),
        )
    )
    named_by = F.coalesce(F.nullif("chunk_id", F.lit("")), F.concat(F.lit("position-"), "__position"))
    return full.select(
        *[c for c in full.columns if c not in ("__position", "__place")], named_by.alias("issue_id"),
        named.alias("issues"), (short & F.col("is_faq")).alias("short_faq"),
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    """(issue, n) over all chunks; kept short answers are counted, but are no issue."""
    names = F.concat("issues", F.when(F.col("short_faq"), F.array(F.lit("short_faq_preserved"))).otherwise(F.array().cast("array<string>")))
    return issues.select(F.explode(names).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def quality_report(issues: DataFrame, config: ChunkingConfig = ChunkingConfig(), embedding_model: str = "hashing") -> DataFrame:
    """One row of totals. Invalid chunks are counted by id; the ids themselves are ``invalid_ids``."""
    bad = F.size("issues") > 0
    totals = issues.agg(
        F.count("*").alias("total_chunks"), F.countDistinct(F.when(bad, F.col("issue_id"))).alias("invalid_chunks")
    )
    counts = issue_counts(issues).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue", "n")))).alias("issue_counts")
    )
    return totals.crossJoin(counts).select(  # one row each
        "total_chunks", (F.col("total_chunks") - F.col("invalid_chunks")).alias("valid_chunks"), "invalid_chunks",
        "issue_counts", F.lit(config.min_words).alias("min_words"), F.lit(config.max_tokens).alias("max_tokens"),
        F.lit(POLICY).alias("short_faq_policy"), F.lit(embedding_model).alias("embedding_model"),
        (F.col("invalid_chunks") == 0).alias("passed"),
    )


def invalid_ids(issues: DataFrame) -> DataFrame:
    return issues.where(F.size("issues") > 0).select(F.col("issue_id").alias("chunk_id")).distinct()


def ready_chunks(chunks: DataFrame, issues: DataFrame) -> DataFrame:
    """Chunks whose id is no invalid chunk's; those without an id are kept."""
    return chunks.join(invalid_ids(issues), "chunk_id", "left_anti")


def inspection_sample(chunks: DataFrame, order: list[str], size: int = 25) -> DataFrame:
    """At most ``size`` rows at even steps of the order, from the first on.

    Only the columns of the order are sorted and numbered; the rows at the places that are picked are joined to them
    last. Of rows that the order does not tell apart any may stand at a place, each at one.
    """
    ranged = chunks.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    # written once: a range shuffle that is planned twice may cut its ranges differently
    placed = numbered(kept(ranged), "sample_position")
    total = placed.agg(F.count("*").alias("n")).first()["n"]
    step = max(1, total // max(1, min(size, total)))
    at = F.col("sample_position")
    picked = placed.where((at % step == 0) & (at < step * size))
    keys = [f"__{c}" for c in order]
    places = picked.groupBy(*[F.col(c).alias(k) for c, k in zip(order, keys)]).agg(F.array_sort(F.collect_list(at)).alias("__places"))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(order, keys)]
    met = chunks.join(F.broadcast(places), same)  # at most ``size`` rows
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*[c for c in chunks.columns])))
    return met.withColumn("__nth", nth).where(F.col("__nth") <= F.size("__places")).select(
        F.element_at("__places", F.col("__nth")).alias("sample_position"), *chunks.columns
    )
