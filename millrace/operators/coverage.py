"""Coverage of retrieval cases by a corpus of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans import computed, kept
from millrace.session import ship_package

#: Parts that the chunks of a source url are dealt into where they meet cases.
PARTS = 32
#: Bytes of urls and terms up to which cases are sent to all tasks.
BROADCAST_BYTES = 4 << 20


def evidence(folded_text: Column, folded_terms: Column) -> Column:
    """Whether the text holds every term, both case folded."""
    return T.contains_all(F.coalesce(folded_text, F.lit("")), folded_terms)


def case_coverage(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, source_url_found, evidence_found, source_chunk_count, evidence_chunk_count) of each case.

    Chunks meet cases by the source url; only those of urls that a case names are folded, once. Where the cases' urls
    and terms are few bytes, they go to the chunks, and no text is shuffled. Else rows are dealt by url and a part of
    the chunk's hash, and cases go to all parts of their urls, so the chunks of a url that very many share are many
    tasks' work.
    """
    ship_package(cases.sparkSession)
    each = kept(T.fold_terms(cases.select("id", "relevant_source_urls", "relevant_terms"), "id", "relevant_terms"))
    wanted = each.select("id", F.explode(F.array_distinct("relevant_source_urls")).alias("source_url"), "relevant_terms")
    told = F.length("source_url") + F.length(F.array_join("relevant_terms", " ")) + 64
    few = (wanted.agg(F.sum(told).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES
    named = wanted.select("source_url").distinct()
    texts = chunks.select("source_url", "text").join(F.broadcast(named) if few else named, "source_url", "left_semi")
    folded = computed(texts.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int")), folded=T.fold(F.col("text")))
    if few:
        both = folded.join(F.broadcast(wanted), "source_url")
    else:
        both = folded.join(wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["source_url", "part"])
    met = both.select("id", evidence(F.col("folded"), F.col("relevant_terms")).alias("has_evidence"))
    counts = met.groupBy("id").agg(F.count("*").alias("s"), F.count_if("has_evidence").alias("e"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return cases.select("id").join(counts, "id", "left").select(
        "id", (n("s") > 0).alias("source_url_found"), (n("e") > 0).alias("evidence_found"),
        n("s").alias("source_chunk_count"), n("e").alias("evidence_chunk_count"),
    )


def corpus_coverage(case_rows: DataFrame, chunk_count: int | Column) -> DataFrame:
    """One row of means over cases; 0 where there are none."""
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    count = chunk_count if isinstance(chunk_count, Column) else F.lit(chunk_count)
    return case_rows.agg(
        F.count("*").alias("case_count"), F.first(count).alias("chunk_count"),
        mean("source_url_found").alias("source_url_coverage"), mean("evidence_found").alias("evidence_case_coverage"),
        mean("source_chunk_count").alias("average_source_chunks"), mean("evidence_chunk_count").alias("average_evidence_chunks"),
    )
