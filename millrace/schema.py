"""Explicit schemas of the data model."""

from pyspark.sql import types as T

SECTION = T.StructType([
    T.StructField("heading", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("section_index", T.IntegerType()),
])
SECTIONS = T.ArrayType(SECTION)
INPUT_DOCUMENT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("sections", SECTIONS),
    T.StructField("text", T.StringType()),
])
CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("is_faq", T.BooleanType()),
    T.StructField("section_index", T.IntegerType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("content_hash", T.StringType()),
])
FETCHED = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("sections", SECTIONS),
    T.StructField("links", T.ArrayType(T.StringType())),
])
CASE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("relevant_source_urls", T.ArrayType(T.StringType())),
    T.StructField("relevant_terms", T.ArrayType(T.StringType())),
])
SOURCE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("publisher_type", T.StringType()),
])
PDF_METADATA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("pdf", T.StringType()),
])
