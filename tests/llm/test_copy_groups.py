import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_large_copy_group_keeps_one_full_text(spark):
    copy = "\n".join(f"line {i} of the copied page" for i in range(8))
    rows = [(i, copy if i % 3 == 0 else f"footer\nown text number {i}\nwith {i * 7} and {i * 11}", "en", "s", 1) for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    left = corpus_pipeline.near_dedup(spark, corpus_pipeline.boilerplate_lines(spark, docs, ""), "").collect()
    assert [r.text for r in left if r.doc_id % 3 == 0] == [copy]
    assert len(left) == 61 and not any("footer" in r.text for r in left)
