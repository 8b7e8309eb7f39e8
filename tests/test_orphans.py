import datetime as dt
import random

from pyspark.sql import functions as F, types as T

from spoolmark.functions.keys import graphic_key, uci_key
from spoolmark.operators.orphans import citations, find_orphans, lives, orphan_counts

CITE = T.StructType([T.StructField("id", T.LongType()), T.StructField("uci", T.StringType()), T.StructField("at", T.TimestampNTZType()), T.StructField("key", T.StringType())])
LIFE = T.StructType([T.StructField("uci", T.StringType()), T.StructField("created", T.TimestampNTZType()), T.StructField("deleted", T.TimestampNTZType()), T.StructField("month", T.StringType())])


def norm(u):
    u = (u or "").replace("{", "").replace("}", "").strip(" \t").upper()
    return u or None


def brute(cites, parents):
    out = set()
    for i, u, at, _ in cites:
        k = norm(u)
        if k is None:
            continue
        own = [(c, d) for p, c, d, _ in parents if norm(p) == k]
        if at is not None and any(c is not None and c <= at and (d is None or d > at) for c, d in own):
            continue
        verdict = "missing" if not own else "deleted" if at is not None and any(c is not None and c <= at for c, _ in own) else "late"
        out.add(("t", i, verdict, at.strftime("%Y-%m") if at else None))
    return out


def test_agrees_with_brute_force(spark):
    rng = random.Random(8)
    t = lambda: rng.choice([None, *[dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.choice([0, 24 * 31, rng.randint(0, 9000)])) for _ in range(12)]])
    name = lambda: rng.choice(["{a%d}", "A%d", " a%d\t", "{A%d }"]) % rng.randint(0, 30)
    parents = [(rng.choice([name(), name(), None, "{}"]), t(), t() if rng.random() < 0.6 else None, "x") for _ in range(120)]
    cites = [(i, rng.choice([name(), name(), name(), None, " ", "{zz}"]), t(), "x") for i in range(500)] + [(1000 + i, "{a3}", t(), "hot") for i in range(300)]
    c, p = spark.createDataFrame(cites + cites[:40], CITE), spark.createDataFrame(parents + parents[:10], LIFE)
    key = uci_key(F.col("uci"))
    got = find_orphans([citations(c, "t", "id", key, "at")], [lives(p, key, "created", "deleted")])
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(cites, parents)
    assert sum(r.n_orphans for r in orphan_counts(got).collect()) == len(rows)
    split = find_orphans([citations(c, "t", "id", key, "at")], [lives(p, key, "created", "deleted")], hot_rows=20)
    assert {tuple(r) for r in split.collect()} == set(rows)
    none = find_orphans([citations(c, "t", "id", key, "at")], [lives(p.limit(0), key, "created", "deleted")])
    assert {tuple(r) for r in none.collect()} == brute(cites, [])
    assert find_orphans([citations(c.limit(0), "t", "id", key, "at")], [lives(p, key, "created", "deleted")]).count() == 0


def test_keys(spark):
    d = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a long, b long")
    assert [r[0] for r in d.select(graphic_key(F.col("a"), F.col("b"))).collect()] == [None, None, "g:3:4"]
