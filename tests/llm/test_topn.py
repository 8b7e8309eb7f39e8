import random

from pyspark.sql import types as T

from spoolmark.llm import topn

ROWS = T.StructType([T.StructField(c, T.StringType()) for c in ("line", "pipe", "item")] + [T.StructField("score", T.DoubleType()), T.StructField("rnk", T.StringType())])


def brute(rows, n):
    best = {}
    for line, pipe, item, score, _ in rows:
        if pipe is not None and item is not None and score is not None and score == score:
            key = (line, pipe), item
            best[key] = max(best.get(key, score), score)
    out, groups = [], {}
    for (group, item), score in best.items():
        groups.setdefault(group, []).append((-score, item.encode(), item))
    for group, items in groups.items():
        out += [(*group, i + 1, x[2]) for i, x in enumerate(sorted(items)[:n])]
    return sorted(out, key=str)


def test_ties_nulls_and_a_hot_group(spark):
    rng = random.Random(1)
    scores = [1.0, 1.0, 1.0 + 2**-52, float("nan"), None, float("inf"), float("-inf"), -0.0, 0.0, 7.5]
    names = ["é", "z", "Z", "😀", "￮", None] + [f"i{k}" for k in range(30)]
    pick = lambda: (rng.choice(["L1", None]), rng.choice(["p", "q", None]), rng.choice(names), rng.choice(scores), "clash")
    rows = [pick() for _ in range(600)] + [("L1", "hot", rng.choice(names), rng.choice(scores), "x") for _ in range(1500)]
    d = spark.createDataFrame(rows + rows[:50], ROWS).repartition(5)
    for n in (1, 5, 100):
        got = topn.top_n(d, ["line", "pipe"], "item", "score", n).select("line", "pipe", "rnk", "item").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, n)
    assert topn.top_n(d.limit(0), ["line", "pipe"], "item", "score", 5).count() == 0


def test_heaps_merge_exactly_and_stay_small():
    import pyarrow as pa

    rng = random.Random(3)
    rows = [("L", rng.choice("pq"), f"i{rng.randrange(40)}", float(rng.randrange(30)), "") for _ in range(4000)]
    table = lambda part: pa.table({"line": [r[0] for r in part], "pipe": [r[1] for r in part], "item": [r[2] for r in part], "score": [r[3] for r in part]})
    parts = [topn.heaps(table(rows[k::7]), ["line", "pipe"], "item", "score", 5) for k in range(7)]
    assert all(p.num_rows == 10 for p in parts)
    whole = topn.heaps(pa.concat_tables(parts), ["line", "pipe"], "item", "score", 5).to_pylist()
    seen = {}
    got = [(r["line"], r["pipe"], seen.setdefault(r["pipe"], []).append(0) or len(seen[r["pipe"]]), r["item"]) for r in whole]
    assert sorted(got, key=str) == brute(rows, 5)
