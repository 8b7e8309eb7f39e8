import random

from pyspark.sql import types as T

from spoolmark.llm import components

EDGES = T.StructType([T.StructField(c, T.StringType()) for c in ("from_node", "to_node", "node_id")])


def brute(edges):
    up = {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b, *_ in edges:
        a, b = (a or "").strip(), (b or "").strip()
        if a and b:
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {n: find(n) for n in up}


def groups(spark, edges):
    got = components.group_ids(spark.createDataFrame([(a, b, "clash") for a, b in edges], EDGES), "from_node", "to_node").collect()
    assert len(got) == len({r.node_id for r in got})
    return {r.node_id: r.group_id for r in got}


def test_chains_hubs_and_dirt(spark):
    rng = random.Random(3)
    chain = [f"n{i}" for i in range(60)]
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [("hub", f"h{i}") for i in range(80)] + [(f"é{i}", f"😀{rng.randint(0, 9)}") for i in range(20)]
    edges += [("a", "a"), ("b", "c"), ("c", "b"), (" b ", "c\t"), (None, "x"), ("y", ""), (" ", "z"), ("only", "only")]
    assert groups(spark, edges) == brute(edges)


def test_empty_table(spark):
    assert groups(spark, []) == {}
