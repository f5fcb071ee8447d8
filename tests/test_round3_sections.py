import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import sections

PARTS = ["WhatsApp ", "Telegram", "Editor, ", "Edıtor (x)", "EDİTOR", "éTelegram", "Sanket Ghogare Editor (a)", "✕", " \t ", "  ", "\r\n", "\r", "\n", "| - x", "\x00",
         "Last Verified: १२ May 2024", "Last Verified: 12 Mayıs 2024", "3/4 documents ready", "https://t.me/ab c", "SG Written and fact-checked ", "ﬁ ½", "\xa0", "\x85", "a", "Is it?",
         "?", "HOW", "How to", "How to x", "\u2028", "İ", "Σ", "ß", "ª", "\x1c", "schemesinindia.in — All Indian Government Schemes "]


def texts(n, most=9):
    drawn = random.Random(3)
    return ["".join(drawn.choices(PARTS, k=drawn.randint(0, most))) for _ in range(n)]


def test_cleaning_and_headings_in_python_are_those_of_columns(spark):
    df = spark.createDataFrame([(x,) for x in texts(3000)], "t string")
    each = df.select("t", T.clean_text(F.col("t")).alias("clean"), F.transform(T.split_lines(F.col("t")), lambda x: F.struct(x.alias("x"), T.is_heading(x).alias("h"))).alias("lines"))
    for r in each.collect():
        assert T.clean_text_py(r.t) == r.clean, r.t
        assert [(x, T.is_heading_py(x)) for x in T.split_lines_py(r.t)] == [(x.x, x.h) for x in r.lines], r.t


def test_sections_move_their_text_once(spark):
    pages = spark.createDataFrame([("a", 2, "x\nHOW\nWHY\ny"), ("a", 1, "WHO\n-\nIs it?\nz"), ("b", 1, None), ("a", 3, "")], "d string, p int, text string")
    found = sections.line_sections(pages, ["d"], page_col="p")
    assert [tuple(r) for r in found.orderBy("section_index").collect()] == [("a", "Is it?", "z", 1, 0), ("a", "", "x", 2, 1), ("a", "WHY", "y", 2, 2)]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB? \n\r\t|-", max_size=40))
def test_no_line_is_in_two_sections(text):
    found = list(sections._page_sections(text))
    assert all(x for _, x in found)
    assert sum(x.count("\n") + 1 for _, x in found) <= len(T.split_lines_py(text))
