"""Units of text in Python against the same rules as columns."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as T

LINES = ["Hi there. v1.5 e.g. ok? Yes!! no", "one", ". x", "... x", "a.\x85b. c", "!", "!! a", "x .", "१. item", "- a. b. c", "12) a. b", "-a. b", "a. b"]


def test_units_are_those_of_columns(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "t string")
    rows = df.select("t", T.split_lines(F.col("t")).alias("lines"), T.sentences(F.col("t")).alias("s"), T.is_list_item(F.col("t")).alias("i")).collect()
    for r in rows:
        assert T.split_lines_py(r.t) == r.lines
        assert bool(T.LIST_ITEM.match(r.t)) == r.i
        if len(r.lines) == 1:
            assert T.sentences_py(r.t) == r.s, r.t


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!? ", max_size=20))
def test_sentences_lose_nothing(line):
    assert "".join("".join(T.sentences_py(line)).split()) == "".join(line.split())
