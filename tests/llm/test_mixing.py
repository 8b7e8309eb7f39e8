import pytest
from pyspark.sql import functions as F, types as T

from spoolmark.llm import mixing

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("slot", T.StringType())])
TARGETS = T.StructType([T.StructField("source_key", T.StringType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.IntegerType())])


def docs(spark, counts):
    rows = [(i * 1000 + k, "word " * (1 + (k * 7 + i) % 40), s, "clash") for i, (s, n) in enumerate(counts) for k in range(n)]
    rows += [(90001, None, "big", ""), (90002, "", "big", ""), (None, "x", "big", ""), (90003, "x", None, ""), rows[0]]
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_caps(spark):
    d = docs(spark, [("big", 900), ("mid", 300), ("small", 60), ("unlisted", 50)])
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.19, 6), ("none", 0.01, 2), ("bad", None, 1)], TARGETS)
    mixed = mixing.mix(d, t, block_tokens=64)
    report = {r.source_key: r for r in mixing.shares(mixed, t).collect()}
    assert report["none"].tokens == 0 and report["bad"].tokens == 0
    for key in ("big", "mid", "small"):
        assert report[key].max_used <= report[key].max_repeats
        assert report[key].reached_share == pytest.approx(report[key].target_share / 0.99, abs=0.02)
    total = sum(r.tokens for r in report.values())
    all_big = mixing.token_counts(d).where("source = 'big'").agg(F.sum("n_tokens")).first()[0]
    assert total > 0.9 * min(all_big / 0.5, total * 2)
    assert mixed.groupBy("source", "doc_id", "pass_no").count().where("count > 1").count() == 0
    assert {r.source for r in mixed.select("source").distinct().collect()} == {"big", "mid", "small"}
    again = mixing.mix(d.repartition(7), t, block_tokens=64)
    assert mixed.exceptAll(again).count() == 0 and again.count() == mixed.count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    t = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    assert mixing.mix(none, t).count() == 0
    assert mixing.mix(docs(spark, [("big", 3)]), t.limit(0)).count() == 0
    assert mixing.shares(mixing.mix(none, t), t).first()["reached_share"] == 0


def test_pieces_keep_token_counts():
    encoder = mixing._encoder(mixing.TOKENIZERS)
    text = ("Weld W12  moved\n\n by 3.5 mm, 焊口 " * 9000) + "x" * 120_000
    assert "".join(mixing.pieces(text)) == text
    assert sum(len(encoder.encode_ordinary(p)) for p in mixing.pieces(text)) == len(encoder.encode_ordinary(text))
