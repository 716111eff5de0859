import __spark_entry__


def test_every_text_problem_has_a_query():
    numbers = {int(name[1:].split("_")[0]) for name in __spark_entry__.queries() if name[0] == "p" and name[1].isdigit()}
    assert {3, 5, 8, 9, 10} <= numbers


def test_text_queries_read_whole_tables(spark):
    base, queries = "/root/testdata/sf0.001", __spark_entry__.queries()
    documents = spark.read.parquet(f"{base}/documents.parquet")
    ids = queries["p8_ids"](spark, base)
    assert ids.columns == ["doc_id", "ids"]
    assert ids.count() == documents.count()
    assert ids.where("doc_id is null").count() == documents.where("doc_id is null").count()
    placed = queries["p9_windows"](spark, base)
    assert placed.select("doc_id").distinct().count() == documents.select("doc_id").distinct().count()
    assert queries["p10_statistics"](spark, base).count() == documents.count()
    for name, column in (("p3_found", "path"), ("p5_found", "path"), ("p10_found", "doc_id")):
        found = queries[name](spark, base)
        assert found.columns == [column]
        assert found.count() == found.distinct().count() > 0
