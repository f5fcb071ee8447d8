from pyspark.sql import functions as F

from millrace.operators import keyword


def test_a_task_sorts_the_postings_of_bounded_text(spark, monkeypatch, tmp_path):
    rows = [(i, " ".join(f"w{i * j % 50}" for j in range(20)) if i % 9 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "w1 w7 w30"), (2, "w49")], "q long, text string")

    def found():
        index = keyword.build_index(docs, "doc_id")
        files = index.postings.groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).agg(F.sum("n")).collect()
        return len(files), sorted(map(tuple, keyword.bm25(asked, "q", index, 5).collect()))

    whole = found()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(keyword, "TASK_BYTES", size // 10)
    parts = found()
    assert whole[0] == 1 and parts[0] >= 10
    assert parts[1] == whole[1] and len(whole[1]) == 10
