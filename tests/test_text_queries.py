from spoolmark.queries import structures


def test_whole_text_is_slugged_and_escaped(spark, tmp_path):
    texts = ["。" * 150 + "Weld 7", " " * 60 + "sheet 4", "a" * 300 + "<&>", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in structures.fs4_slug_and_escape(spark, str(tmp_path)).collect()}
    assert got[0].slug == "Weld-7" and got[1].labelled and not got[2].labelled
    assert got[2].escaped == "a" * 300 + "&lt;&amp;&gt;" and got[2].slug == "a" * 80 and set(got) == {0, 1, 2}
