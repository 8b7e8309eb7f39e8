import datetime as dt

from spoolmark.streaming import ingest


def test_upsert_counts_and_rejects(spark, tmp_path):
    t = lambda m: dt.datetime(2025, 1, 1, 0, m)
    schema = "k long, v string, at timestamp, line_no int, raw_line string"
    for i, rows in enumerate([[(1, "a", t(0), 20, "x"), (2, "b", t(1), 20, None)], [(1, "c", t(2), 1, "1 2"), (1, "old", t(0), 20, '"'), (3, "d", t(59), 20, "")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    like = spark.read.parquet(str(tmp_path / "in/p0"))
    source = lambda: ingest.table_stream(spark, like, str(tmp_path / "in/*"), 1)
    ingest.upsert(source(), str(tmp_path / "out"), ["k"], ["at"], str(tmp_path / "cp")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out/v1"))
    assert {(r.k, r.v) for r in last.collect()} == {(1, "c"), (2, "b"), (3, "d")}
    for name, stream in (("parsed", ingest.split_stream(source())), ("once", ingest.once_per_key(source(), ["k"], "at", "1 hour"))):
        q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("parsed").where("reason is not null").count() == 5
    assert spark.table("once").count() == 3
    q = ingest.window_counts(source(), "at", ["k"], "10 minutes", "5 minutes").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.n) for r in spark.table("win").collect()} == {(1, 3), (2, 1), (3, 1)}
