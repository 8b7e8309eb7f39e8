import random
import statistics

import pytest
from pyspark.sql import functions as F

from spoolmark.operators import linking, ranking, stats


@pytest.fixture()
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_medians_of_a_hot_group(spark, many_ranges):
    rng = random.Random(1)
    rows = [("hot", float(rng.randint(0, 400))) for _ in range(901)] + [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, 2.0, -3.0, float(rng.randint(0, 9))])) for _ in range(80)] + [("none", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).extend([] if v is None else [v])
    got = {r.g: (r.n, r.med, r.mad) for r in stats.median_mad(d, ["g"], "v").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        want = (len(vs), None, None)
        if vs:
            med = statistics.median(vs)
            want = (len(vs), med, statistics.median([abs(v - med) for v in vs]))
        assert got[g] == want
    every = [v for _, v in rows if v is not None]
    assert stats.median_mad(d, [], "v").first()["med"] == statistics.median(every)
    assert {r.g: r.upper_median for r in stats.upper_median(d, ["g"], "v").collect()} == {g: sorted(vs)[len(vs) // 2] for g, vs in groups.items() if vs}
    assert stats.median_mad(d.limit(0), ["g"], "v").count() == 0 and tuple(stats.median_mad(d.limit(0), [], "v").first()) == (0, None, None)


def test_as_of_over_many_ranges(spark, many_ranges):
    rng = random.Random(2)
    left = [(i, rng.choice(["hot", "hot", "x", None]), rng.choice([None, *range(200)])) for i in range(400)]
    right = [(rng.choice(["hot", "y", "x", None]), rng.choice([None, *range(0, 200, 7)]), f"v{i}") for i in range(90)]
    a, b = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, at int, val string")
    got = {r.id: (r["at"], r.val) for r in linking.as_of(a, b, ["k"], "t", "at", ["val"]).collect()}
    for i, k, t in left:
        best = max(((x, v) for q, x, v in right if q == k and x is not None and t is not None and x <= t), default=(None, None))
        assert got[i] == best


def test_margin_and_containment(spark):
    d = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 3.0), ("a", "z", 1.0), ("b", "x", None), ("c", "q", 2.0), (None, "n", 1.0)], "g string, i string, s double")
    assert {r.g: (r.i, r.margin) for r in ranking.best_with_margin(d, ["g"], "s", "i").collect()} == {"a": ("x", 0.0), "b": ("x", None), "c": ("q", None), None: ("n", None)}
    parts = spark.createDataFrame([("W",), ("WELD",), ("EL",), ("zzz",), (None,), ("",), ("LONG WELD AT",)], "p string")
    texts = spark.createDataFrame([("A LONG WELD AT TEE",), ("PIPE",), (None,), ("",)], "t string")
    assert {r.p for r in linking.within_texts(parts, texts, "p", "t").collect()} == {"W", "WELD", "EL", "", "LONG WELD AT"}


def test_tolerance_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.uniform(-0.3, 0.3), rng.uniform(4.5, 5.6), rng.uniform(-5.2, -4.8), rng.uniform(900, 1000), 5.0, 4.9, 4.95, 5 / 0.98, 0.1, 0.0, 1e9 / 0.98, 1e9, 0.1 / 0.98]) for _ in range(600)]
    rows = [(rng.choice(["x", "y"]), rng.randint(0, 500), v) for v in values] + [("x", 1, None), (None, 1, 5.0), (None, 2, 5.0)]
    want = sorted((p[0], p[1], q[1]) for p in rows for q in rows if p[0] and p[0] == q[0] and p[1] < q[1] and None not in (p[2], q[2]) and abs(p[2] - q[2]) <= max(0.1, 0.02 * max(abs(p[2]), abs(q[2]))))
    got = linking.tolerance_pairs(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "i", "v", 0.1, 0.02)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_tolerance_pairs_makes_few_candidates_in_vain(spark):
    rows = spark.range(2000).select(F.lit("x").alias("k"), F.col("id").alias("i"), (900 + F.col("id") * 37 % 1000 / 10).alias("v"))
    n = linking.tolerance_pairs(rows, ["k"], "i", "v", 0.1, 0.02)
    found = n.count()
    plan = n._jdf.queryExecution().optimizedPlan()
    # The join without its condition on the values: as many rows as it has to look at.
    a, b = plan.children().apply(0).children().apply(0), plan.children().apply(0).children().apply(1)
    from pyspark.sql import DataFrame

    side = lambda p: DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, p), spark).groupBy("__cell").count()
    seen = side(a).withColumnRenamed("count", "n").join(side(b), "__cell").agg(F.sum(F.col("n") * F.col("count"))).first()[0]
    assert found < seen < 1.6 * found
