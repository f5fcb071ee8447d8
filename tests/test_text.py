from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.oracles import BOILERPLATE_LINES


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.select("i", expr(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_clean_text_squeezes_and_drops_repeats(spark):
    assert column(spark, ["  Heading  \r\nBody\xa0 text\nHeading\n\nBody text"], T.clean_text) == ["Heading\nBody text"]


def test_clean_text_edge_cases(spark):
    cases = {
        "": "", None: None, "\n\n": "", "- | x | -": "x", "Share on WhatsApp": "Share on", "Share onWhatsApp": "",
        "Box WhatsApp(/a) Telegram(/b) end": "Bo end", "a Last verified: 3 May · rest": "a rest",
        "Last verified: all of the rest": "", "½ … ﬁ ？\x00": "1⁄2 ... fi ?", "हिन्दीWhatsApp": "हिन्दी",
        "Official https://gov.example/a": "Official https://gov.example/a",
    }
    assert column(spark, list(cases), T.clean_text) == list(cases.values())


def test_both_cleaners_agree(spark):
    lines = [*BOILERPLATE_LINES, "a\x0bb c", "x \x1c y", "İstanbul ß ǅ", "a\r\nb\rc\na"]
    assert column(spark, lines, T.clean_text) == [T.clean_text_py(x) for x in lines]


def test_sentences_and_list_items(spark):
    got = column(spark, ["Hi there. v1.5 e.g. ok? Yes!! no", "one", ". x"], T.sentences)
    assert got == [["Hi there.", "v1.5 e.g.", "ok?", "Yes!!", "no"], ["one"], [". x"]]
    assert column(spark, ["- a", "1. a", "12) a", "a - b", "-a", "१. item"], T.is_list_item) == [True, True, True, False, False, True]


def test_headings(spark):
    lines = ["Who can apply?", "How to", "How to apply", "Officially so", "BENEFITS", "123", "A1", "plain text", "word " * 13 + "?", "हिन्दी"]
    assert column(spark, lines, T.is_heading) == [True, False, True, True, True, False, True, False, False, False]
    assert column(spark, ["Why?", "Why? ", "see https://a.b?", "WhatsApp?", ""], T.is_faq) == [True, True, False, False, False]


def test_fold(spark):
    values = ["Straße", "ΑΣ ﬃ", "İstanbul", "Ǆ ŉ Ᏸ ꭰ", "plain TEXT é É", None, "ΟΔΟΣ ς ſ K"]
    assert column(spark, values, T.fold) == [None if v is None else v.casefold() for v in values]
    terms = spark.createDataFrame([("a", ["STRASSE", "Ein"]), ("b", []), (None, ["ß"]), ("c", None)], "k string, t array<string>")
    got = {r.k: sorted(r.t) for r in T.fold_terms(terms, "k", "t").collect()}
    assert got == {"a": ["ein", "strasse"], "b": [], None: ["ss"], "c": []}
    assert column(spark, ["x"], lambda t: T.contains_all(t, F.array().cast("array<string>"))) == [True]


def test_ids(spark):
    assert column(spark, ["u"], lambda t: T.chunk_id(t, F.lit(12345)))[0].endswith("-12345")
    assert column(spark, ["u"], lambda t: T.chunk_id(t, F.lit(7)))[0].endswith("-0007")


def test_urls(spark):
    urls = ["https://u@h.example:80/a/b.PDF?x#y", "http://h.example/{{x}}", "https://h.example/a.pdf.html", "/just/path"]
    assert column(spark, urls, U.netloc) == ["u@h.example:80", "h.example", "h.example", ""]
    assert column(spark, urls, U.is_crawlable) == [False, False, True, True]
    assert column(spark, urls, U.defragment)[0] == "https://u@h.example:80/a/b.PDF?x"
    hrefs = ["/a", "b", "../c", "//o.example/x", "#f", "https://z.example/q"]
    got = column(spark, hrefs, lambda h: U.resolve(F.lit("https://h.example/d/e?q"), h))
    assert got == [
        "https://h.example/a", "https://h.example/d/b", "https://h.example/c", "https://o.example/x",
        "https://h.example/d/e?q#f", "https://z.example/q",
    ]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?|-\n\r\t✕xX", max_size=40))
def test_cleaning_twice_changes_little(value):
    once = T.clean_text_py(value)
    assert len(T.clean_text_py(once)) <= len(once)
