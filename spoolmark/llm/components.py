"""Groups of directly or indirectly matched records, by alternating star rewrites.

Node names are encoded as integers in their sort order (one range shuffle), so
the smallest number of a group is its smallest name.  A large-star rewrite
links every larger neighbour of a node to the smallest node of its
neighbourhood, a small-star rewrite does so for the smaller neighbours; both
are joins of the edges with a map-side combined minimum per node.  They
alternate until neither changes an edge, which each rewrite counts while it is
written, and then every node points at the smallest node of its component.
Once no node has two smaller neighbours, which a large star leaves so, a small
star is known to change nothing and is not computed.

A node that a third of all edges touch gets its minimum from partial minima of
all tasks, and the join that hands the minimum out is a plain shuffled join
followed by another shuffle or a write, which adaptive execution splits when
one node fills a partition.  Every rewrite is written to the shared folder, so
a lost executor costs no earlier round, and those of earlier rounds are
deleted.

Defined results: ends are trimmed of blanks, tabs and line breaks; an edge
with a null or empty end is no edge, and its other end is no node because of
it; an edge from a node to itself makes the node a group of its own if it has
no other edge; repeated and reversed edges count once; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from spoolmark.plans.lineage import cut, release

MAX_ROUNDS = 200


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The edges (u, v) as a table, and how many of them are marked as changed."""
    seen = Observation()
    table = cut(edges.observe(seen, F.sum(F.col("changed").cast("long")).alias("changed")).select("u", "v"), name)
    return table, seen.get["changed"] or 0


def large_star(edges: DataFrame) -> DataFrame:
    """(u, v, changed) of edges(u > v): every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select("u", "v"))
    least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
    return edges.join(least, F.col("v") == F.col("x")).select("u", F.col("m").alias("v"), (F.col("m") != F.col("v")).alias("changed"))


def small_star(edges: DataFrame) -> DataFrame:
    """(u, v, changed) of edges(u > v): a node and every smaller neighbour of it are linked to the smallest of them."""
    least = edges.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
    other = F.col("v") != F.col("m")
    linked = edges.join(least, F.col("u") == F.col("x")).select(F.when(other, F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"), other.alias("changed"))
    return linked.groupBy("u", "v").agg(F.max("changed").alias("changed"))


def _clean(end: Column) -> Column:
    return F.nullif(F.btrim(end.cast("string"), F.lit(" \t\r\n")), F.lit(""))


def group_ids(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node_id, group_id) of every node of an edge with both ends, group_id being the smallest node of the group."""
    ends = edges.select(_clean(F.col(a)).alias("a"), _clean(F.col(b)).alias("b")).where("a is not null and b is not null")
    pairs = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    names = pairs.select(F.col("a").alias("name")).unionAll(pairs.select("b")).distinct()
    nodes = cut(names.repartitionByRange("name").sortWithinPartitions("name").select("name", F.monotonically_increasing_id().alias("id")), "nodes")
    number = lambda name, as_: nodes.select(F.col("name").alias(name), F.col("id").alias(as_))
    coded = pairs.where("a != b").join(number("a", "v"), "a").select("b", "v").join(number("b", "u"), "b").select("u", "v")
    edges = cut(coded, "edges")
    release(pairs)
    forked = 1
    for _ in range(MAX_ROUNDS):
        large, moved = _written(large_star(edges), "large")
        release(edges)
        edges = large
        if forked:
            edges, forked = _written(small_star(large), "small")
            release(large)
        elif not moved:
            break
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    grouped = nodes.join(edges.withColumnRenamed("u", "id"), "id", "left").select("name", F.coalesce("v", "id").alias("root"))
    roots = nodes.select(F.col("id").alias("root"), F.col("name").alias("group_id"))
    return grouped.join(roots, "root").select(F.col("name").alias("node_id"), "group_id")
