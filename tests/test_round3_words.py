import numpy as np
import pyarrow as pa

from millrace.functions import tokens as TK


def test_words_stay_from_one_task_to_the_next(spark, monkeypatch, tmp_path):
    from millrace.llm.tokenfile import write_token_files

    encoder = TK.TextEncoder(TK.default_tokenizer())
    monkeypatch.setattr(TK, "MAX_WORDS", 8)
    for text in ("often", "a b", "often c", "d e f", "often", "g h i j", "k l", "often"):
        encoder.encode(text)
    assert "often" in encoder.words and len(encoder.words) + len(encoder.words.older) <= 12
    assert "a" not in encoder.words and "a" not in encoder.words.older
    encoder.encode("x" * 1000)
    assert max(map(len, encoder.words)) <= TK.LONGEST_WORD

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(TK.text_encoder(TK.default_tokenizer()).words)]})

    docs = spark.createDataFrame([(i, f"word{'abcdefghij'[i % 10]} and others") for i in range(40)], "doc_id long, text string").coalesce(1)
    write_token_files(docs, f"file://{tmp_path}/files")
    assert sum(r.n for r in spark.range(0, 16, 1, 16).mapInArrow(kept, "n long").collect()) > 0


def test_signs_after_letters_are_encoded_apart():
    encoder = TK.TextEncoder(TK.default_tokenizer())
    texts = ["word*** wört##, so!? it's. 3.14. é') x. <|endoftext|> y<|endoftext|>. हि. ﬁ% İ. é."]
    for text in texts:
        assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert "word" in encoder.words and "***" in encoder.words
