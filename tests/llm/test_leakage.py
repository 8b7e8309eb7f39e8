import random

from pyspark.sql import types as T

from spoolmark.llm import leakage

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_id", T.StringType())])
BENCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("item_text", T.StringType())])


def brute(docs, bench, n):
    out = {}
    for item, it in bench:
        for doc, dt in docs:
            if None in (item, it, doc, dt):
                continue
            a, b = leakage.words(it), leakage.words(dt)
            best = None
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                        k += 1
                    if k >= n and (best is None or (-k, j, i) < best):
                        best = (-k, j, i)
            if best:
                out[item, doc] = (-best[0], best[1], best[2])
    return out


def test_agrees_with_brute_force(spark):
    rng = random.Random(5)
    vocab = ["Weld", "ＤＮ", "line-7", "焊口", "Ä", "rot", "b", "x1"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, text(rng.randint(2, 25))) for i in range(12)] + [(90, None), (None, text(20)), (91, "")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, "zz " + bench[i][1].upper() + " yy") for i in range(6)]
    docs += [(200, docs[5][1]), (201, None), (202, ""), (203, "a" * 200_000), (204, bench[1][1] * 50)]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs + docs[:3]], DOCS).repartition(3)
    b = spark.createDataFrame(bench + bench[:2], BENCH)
    for kwargs in ({}, {"shard_words": 100}, {"block_chars": 60}, {"block_chars": 60, "pass_blocks": 2, "shard_words": 100}):
        got = {(r.item_id, r.doc_id): (r.n_words, r.doc_word, r.item_word) for r in leakage.find_leaks(d, b, min_words=5, **kwargs).collect()}
        assert got == brute(docs, bench, 5)
    leaked = {doc for _, doc in got}
    kept = leakage.clean_corpus(d, leakage.find_leaks(d, b, min_words=5))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - leaked


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "w " * 20)], BENCH)
    assert leakage.find_leaks(none, one).count() == 0
    assert leakage.find_leaks(none, spark.createDataFrame([], BENCH)).count() == 0
