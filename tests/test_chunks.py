import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.config import ChunkingConfig, TokenizerFile, count_tokens
from millrace.operators import coverage, quality, sections
from millrace.operators.chunking import chunk_documents, pack_units, pack_widths
from millrace.operators.html import SECTION_TYPE, html_sections_py


class Doubling:
    def encode(self, text, add_special_tokens=True, truncation=False):
        return [1] * (2 * len(text.split()))


def chunks(spark, rows, schema, config):
    return chunk_documents(spark.createDataFrame(rows, schema), config).orderBy("source_url", "chunk_index").collect()


def test_overlap_and_provenance(spark):
    text = " ".join(f"w{i}" for i in range(10))
    got = chunks(spark, [("u", "t", text)], "url string, title string, text string", ChunkingConfig(6, 2, 1, 100, Doubling()))
    assert got[0].text.split()[-2:] == got[1].text.split()[:2]
    assert (got[0].chunk_index, got[0].source_url, got[0].title, got[0].token_count) == (0, "u", "t", 12)


def test_sentences_stay_whole(spark):
    text = "One two three. Four five six. Seven eight nine."
    config = ChunkingConfig(20, 0, 1, 6, Doubling())
    got = chunks(spark, [("u", "t", text)], "url string, title string, text string", config)
    assert [r.text for r in got] == ["One two three.", "Four five six.", "Seven eight nine."]


def test_html_heading_goes_with_text(spark):
    page = "<h1>Eligibility</h1><p>" + "word " * 20 + "</p>"
    got = chunks(spark, [("u", page)], "url string, html string", ChunkingConfig(50, 5, 20))
    assert got[0].section == "Eligibility" and got[0].text.startswith("Eligibility\n")


def test_word_fallback(spark):
    rows = [("u", [("Benefits", "word " * 12, None, 0)])]
    got = chunks(spark, rows, f"url string, sections {SECTION_TYPE}", ChunkingConfig(6, 2, 1))
    assert len(got) == 3 and {r.section for r in got} == {"Benefits"}


def test_token_bound(spark):
    got = chunks(spark, [("u", "word " * 30)], "url string, text string", ChunkingConfig(100, 10, 1, 12, Doubling()))
    assert all(r.token_count <= 12 for r in got)
    with pytest.raises(Exception, match="max_tokens is too small"):
        rows = [("u", [("a b c d", "word", None, 0)])]
        chunks(spark, rows, f"url string, sections {SECTION_TYPE}", ChunkingConfig(6, 2, 1, 3))


def test_overlap_only_chunk():
    assert pack_widths(np.array([100, 60, 380, 5]), 512, 400, 64) == [(0, 2), (1, 2), (2, 4)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=30), st.integers(9, 20), st.integers(0, 8))
def test_both_packers_agree(widths, size, overlap):
    units = [" ".join(f"u{i}x{k}" for k in range(w)) for i, w in enumerate(widths)]
    assert pack_widths(np.array(widths, int), 10**6, size, overlap) == pack_units(units, "", ChunkingConfig(size, overlap, 0, 10**6, Doubling()))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans()), max_size=7))
def test_merge_is_the_repeated_merge(spark, shape):
    rows = [("h" if h else "", " ".join(f"s{i}w{k}" for k in range(n)), None, i) for i, (n, h) in enumerate(shape)]
    expected = [[h, t] for h, t, _, _ in rows]
    while len(expected) > 1:
        at = next((i for i, s in enumerate(expected) if len(s[1].split()) < 4), None)
        if at is None:
            break
        at = min(at, len(expected) - 2)
        a, b = expected[at : at + 2]
        expected[at : at + 2] = [[a[0], "\n".join(x for x in (a[1], b[0], b[1]) if x)]]
    df = spark.createDataFrame([(rows,)], f"s {SECTION_TYPE}")
    got = df.select(sections.merge_short_sections(df.s, 4)).first()[0]
    assert [[s.heading, s.text] for s in got] == expected


def test_tokenizer_file(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"word": 0, "[UNK]": 1}, unk_token="[UNK]"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.enable_truncation(3)
    own.save(str(tmp_path / "t.json"))
    tokens = TokenizerFile(str(tmp_path / "t.json"))
    assert count_tokens(tokens, "word, word word") == 4  # truncation of the file does not count
    got = chunks(spark, [("u", "word, " * 30)], "url string, text string", ChunkingConfig(100, 10, 1, 12, tokens))
    assert [r.token_count for r in got[:2]] == [12, 12] and got[0].word_count == 6


def test_config():
    for bad in (dict(chunk_size=0), dict(chunk_overlap=400), dict(chunk_overlap=-1), dict(min_words=-1), dict(max_tokens=0)):
        with pytest.raises(ValueError):
            ChunkingConfig(**bad)


def test_quality(spark):
    schema = "chunk_id string, source_url string, title string, chunk_index int, text string, word_count int, token_count int, content_hash string, is_faq boolean"
    rows = [
        ("a", "u", "t", 0, "x " * 30, 30, 30, "h", False), ("b", "u", "t", 1, "one", 1, 1, "h", False),
        ("c", "u", "t", 2, "short answer", None, None, None, True), ("d", None, "t", 3, "y " * 30, None, 600, None, False),
        (None, "u", "t", 0, "", None, None, None, False),
    ]
    issues = quality.chunk_issues(spark.createDataFrame(rows, schema))
    got = {r.issue_id: list(r.issues) for r in issues.collect()}
    named = next(k for k in got if k.startswith("position-"))
    nameless = spark.createDataFrame([(i, "x") for i in range(7)], "at int, text string")
    assert {r.issue_id for r in quality.chunk_issues(nameless, position_col="at").collect()} == {f"position-{i}" for i in range(7)}
    assert quality.quality_report(quality.chunk_issues(nameless)).first().invalid_chunks == 7
    assert got == {
        "a": ["duplicate_text"], "b": ["duplicate_text", "too_short"], "c": [], "d": ["missing_metadata", "too_long"],
        named: ["empty_text", "missing_metadata", "too_short"],
    }
    report = quality.quality_report(issues).first()
    assert (report.total_chunks, report.valid_chunks, report.passed) == (5, 1, False)
    assert report.issue_counts["short_faq_preserved"] == 1
    empty = quality.quality_report(quality.chunk_issues(spark.createDataFrame([], schema))).first()
    assert empty.passed and empty.total_chunks == 0


@pytest.mark.parametrize("n,expected", [(0, []), (24, list(range(24))), (26, list(range(25))), (50, list(range(0, 50, 2))), (180, list(range(0, 175, 7)))])
def test_sample(spark, n, expected):
    df = spark.createDataFrame([(i,) for i in range(n)], "k int")
    assert sorted(r.sample_position for r in quality.inspection_sample(df, ["k"]).collect()) == expected


def test_line_sections_reset_on_each_page(spark):
    rows = [("d", 1, "INTRO\nfirst line\nINTRO TWO\nWhy so?\nsecond"), ("d", 2, "third\nLAST")]
    got = sections.line_sections(spark.createDataFrame(rows, "d string, page_number int, text string"), ["d"]).orderBy("section_index").collect()
    assert [(r.heading, r.text, r.page_number, r.section_index) for r in got] == [
        ("INTRO", "first line", 1, 0), ("Why so?", "second", 1, 1), ("", "third", 2, 2)
    ]


def test_html_nesting():
    page = "<html><head><title>T</title></head><body><nav><p>Menu</p></nav><p><b>One<br><p>Two</p></em><h2>H</h2><ul><li>a<li>b</ul><!-- c --><script>x</script>"
    got = html_sections_py(page)
    assert [(s["heading"], s["text"]) for s in got] == [("", "One Two H a b\nTwo"), ("H", "a b\nb")]
    assert html_sections_py("plain &amp; text")[0]["text"] == "plain & text"
    assert html_sections_py("<h1>only</h1>") == [{"heading": "", "text": "only", "page_number": None, "section_index": 0}]


def test_sample_of_rows_that_tie(spark):
    rows = spark.createDataFrame([(k // 3, k, "x" * k) for k in range(100)], "ord int, own int, text string").repartition(5)
    got = quality.inspection_sample(rows, ["ord"], 10).orderBy("sample_position").collect()
    assert [r.sample_position for r in got] == list(range(0, 100, 10)) and [r.ord for r in got] == [p // 3 for p in range(0, 100, 10)]
    assert len({r.own for r in got}) == 10
    same = quality.inspection_sample(rows.withColumn("ord", F.lit(None).cast("int")), ["ord"], 10).collect()
    assert sorted(r.sample_position for r in same) == list(range(0, 100, 10)) and len({r.own for r in same}) == 10
    assert quality.inspection_sample(rows.limit(0), ["ord"], 10).count() == 0
    assert [r.sample_position for r in quality.inspection_sample(rows.where("own < 3"), ["own"], 10).orderBy("sample_position").collect()] == [0, 1, 2]


def test_chunks_without_ids_are_named_by_their_place(spark, tmp_path):
    rows = [(None if k % 3 == 0 else f"c{k}", "word " * 25 if k % 2 else "") for k in range(12)]
    spark.createDataFrame(rows, "chunk_id string, text string").coalesce(1).write.parquet(str(tmp_path / "c"))
    named = quality.chunk_issues(spark.read.parquet(str(tmp_path / "c")))
    assert sorted(r.issue_id for r in named.collect()) == sorted(c or f"position-{k}" for k, (c, _) in enumerate(rows))
    assert "__place" not in named.columns


def test_coverage_of_many_and_of_few_cases(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"u{k % 5}", f"Straße {k} of it") for k in range(60)], "source_url string, text string")
    cases = spark.createDataFrame([(str(k), [f"u{k}", f"u{k + 1}", f"u{k}"], ["STRASSE", str(k)]) for k in range(7)], "id string, relevant_source_urls array<string>, relevant_terms array<string>")
    few = sorted(map(tuple, coverage.case_coverage(cases, chunks).collect()))
    monkeypatch.setattr(coverage, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, coverage.case_coverage(cases, chunks).collect())) == few
    assert few[3][3] == 24 and few[6] == ("6", False, False, 0, 0)
