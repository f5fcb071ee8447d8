"""Windows of words: chunks over units of one word each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans import computed


def word_windows(docs: DataFrame, keys: list[str], size: int, overlap: int, text_col: str = "text") -> DataFrame:
    """(keys, chunk_index, begin, end, text): ``size`` words every ``size - overlap``, until the last word is in one."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, and overlap less than it")
    stride = size - overlap
    split = computed(docs.select(*keys, text_col), words=T.words(F.col(text_col)))
    n = F.size("words")
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")
    each = split.where(n > 0).select(*keys, "words", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    begin = F.col("chunk_index") * stride
    return each.select(
        *keys, "chunk_index", begin.alias("begin"), F.least(begin + size, F.size("words")).alias("end"),
        F.array_join(F.slice("words", begin + 1, F.lit(size)), " ").alias("text"),
    )
