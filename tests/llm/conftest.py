import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with names that clash."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (0, "the quick brown fox jumps over the lazy dog again and again\nsecond line of five words here", "en", "a", 1),
        (0, "the quick brown fox jumps over the lazy dog again and again\nsecond line of five words here", "en", "a", 1),
        (1, None, None, None, None), (2, "", "en", "b", 0), (3, " \n\t ", "en", "b", 3), (4, long, "en", "c", len(long)),
        (None, "no id here but some words in the text of it", "en", "a", 5), (5, "é ß Ünïcode \x00  text", "de", None, 7),
    ]
    clash = ["id", "place", "fp", "row", "key", "node", "gone", "maybe", "score", "label", "found", "tile", "doc"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in clash])
