"""What the findings of round 3 were about."""

import duckdb
import pytest

from millrace.queries import ORACLE_SQL, QUERIES

#: Ends of titles that were cut within a character reference, and of some that were not.
CUT = ["&amp;&amp", "x &lt", "&gt", "&quot", "it&#x27", "&#x27;", "&#x2", "&#x", "&#", "&am", "&", "&amp;lt", "&amp;amp;", "&lt;b&gt;"]


@pytest.mark.parametrize("name", ["page_title", "page_text", "page_sections", "page_chunks"])
def test_references_without_semicolon(spark, tmp_path, name):
    html = (
        "<html><head><title>{0}</title></head><body><nav><a href=\"/\">home</a></nav><article><h1>{0}</h1>\n<p>Some words of {1}.</p>\n"
        "<p>Others, and {0}</p></article><footer>end</footer></body></html>"
    )
    rows = [(k, f"https://a.example/{k}", html.format(f"Title {end}", k)) for k, end in enumerate(CUT)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = con.sql(ORACLE_SQL[name]).df()
    columns = sorted(expected.columns)
    told = lambda df: sorted(map(repr, df[columns].itertuples(index=False, name=None)))
    assert len(got) == len(CUT) and told(got) == told(expected)


def test_batches_are_bounded(spark):
    from millrace.session import BATCH_BYTES, ship_package

    old = spark.conf.get(BATCH_BYTES)
    spark.conf.unset(BATCH_BYTES)
    ship_package(spark)
    told = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, old)
    assert told == "4m"


def test_plain_texts_do_not_reach_python(spark):
    from pyspark.sql import functions as F

    from millrace.functions import text as T

    texts = spark.createDataFrame([("plain",), ("ﬁ",), (None,)], "t string")
    plan = texts.select(T.nfkc(F.col("t")), T.fold(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert sent and all("normalize(t#" not in line and "casefold(t#" not in line for line in sent)


class Noted:
    """Notes what it is asked for."""

    def __init__(self, path):
        self.path = path

    def encode(self, texts, **_):
        import numpy as np

        with open(self.path, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return np.array([[1.0, len(t)] for t in texts], np.float32)


def test_questions_are_encoded_once(spark, tmp_path):
    from millrace.operators import routing, search

    rows = [(k, "x" * (1 + k), "ab"[k % 2]) for k in range(60)]
    labelled = search.embed_chunks(spark.createDataFrame(rows, "id long, text string, label string"), Noted(str(tmp_path / "asked")))
    routing.fit_router(labelled, "id")
    assert sorted((tmp_path / "asked").read_text().split()) == sorted(t for _, t, _ in rows)


def test_hashing_encoder_is_what_it_was():
    import hashlib

    import numpy as np

    from millrace.operators.search import HashingEncoder

    texts = ["", "a b a", "The thing AND the other", "ünï çödé x" * 3]
    for row, text in zip(HashingEncoder(16).encode(texts), texts):
        told = np.zeros(16, np.float32)
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            told[h % 16] += 1 if h >> 63 else -1
        n = np.linalg.norm(told)
        assert (row == (told / n if n else told)).all()


def test_words_are_encoded_once():
    import public_tokenizers

    from millrace.config import TokenizerFile, count_tokens
    from millrace.functions.tokens import text_encoder

    tokens = TokenizerFile(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", "A plain text, of words.", "x\x1cy  z\n\nÉÀ 3.14 <|endoftext|> it's", "हिन्दी ﬁ Σ İ 中文"] * 2
    assert [count_tokens(tokens, t) for t in texts] == [len(tokens.encode(t)) for t in texts]
    assert "plain" in text_encoder(tokens.path).words


def test_lines_are_trimmed_without_a_regex(spark):
    from pyspark.sql import functions as F

    from millrace.functions import text as T

    plan = spark.createDataFrame([("x",)], "t string").select(T.trim_ws(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
    assert set(T.SPACES) == {c for c in map(chr, range(0x110000)) if c.isspace()}
