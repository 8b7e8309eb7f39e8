"""Reports over references: namespaces, chains, agreement of builders, membership.

Statuses are data: a report on something malformed is a row, not an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spoolmark.plans.lineage import cut

SEGMENT_MASK = 0xFFFFE000


def namespaces(refs: DataFrame, ref: str, ranked: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``refs`` with the first namespace of the ranked list that has the reference, null when none has.

    The namespaces become one table with the least rank per reference, so it is one join for any number of them.
    """
    rows = reduce(DataFrame.unionAll, [d.select(F.col(d.columns[0]).alias("__r"), F.lit(k).alias("__k")) for k, (_, d) in enumerate(ranked)])
    best = rows.groupBy("__r").agg(F.min("__k").alias("__k"))
    names = F.array(*[F.lit(n) for n, _ in ranked])
    return refs.join(best, F.col(ref) == F.col("__r"), "left").withColumn("namespace", F.get(names, F.col("__k"))).drop("__r", "__k")


def edge_patterns(edges: DataFrame, pattern: Sequence[str], unclassified: Column, sample: int = 20) -> tuple[DataFrame, DataFrame]:
    """(counts of edge patterns, the ``sample`` most frequent unclassified ones)."""
    counts = edges.groupBy(*pattern).agg(F.count("*").alias("n"), F.max(unclassified).alias("unclassified"))
    top = counts.where("unclassified").orderBy(F.desc("n"), *[F.col(p).asc_nulls_last() for p in pattern]).limit(sample)
    return counts.drop("unclassified"), top.drop("unclassified")


def successor_chains(edges: DataFrame, by: Sequence[str], a: str, b: str, rounds: int = 40) -> DataFrame:
    """(by..., start, terminal, hops, looped): where the chain from each node ends, following only nodes with one successor.

    Jumps double in length each round, so chains of any depth end after a
    logarithmic number of joins; a chain that is still moving then runs in a
    circle.
    """
    one = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("x"), F.col(b).alias("y")).distinct()
    only = one.groupBy(*by, "x").agg(F.min("y").alias("y"), F.count("*").alias("n")).where("n = 1").select(*by, "x", "y")
    jump = cut(only.select(*by, F.col("x").alias("start"), F.col("y").alias("at"), F.lit(1).cast("long").alias("hops"), F.lit(True).alias("moving")), "jumps")
    for _ in range(rounds):
        step = jump.select(*by, F.col("start").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"))
        moved = jump.join(step, [*by, "at"], "left").select(
            *by, "start", F.coalesce("to", "at").alias("at"), F.least(F.col("hops") + F.coalesce("more", F.lit(0)), F.lit(1 << 40)).alias("hops"), F.col("to").isNotNull().alias("moving")
        )
        jump = cut(moved, "jumps")
        if jump.where("moving and hops < (1L << 36)").limit(1).count() == 0:
            break
    looped = F.col("moving")
    return jump.select(*by, "start", F.when(~looped, F.col("at")).alias("terminal"), F.when(~looped, F.col("hops")).alias("hops"), looped.alias("looped"))


def segment_address(target: Column) -> tuple[Column, Column]:
    """(base, offset) of a segment address; null below the first segment."""
    usable = target >= 0x2000
    base = F.when(usable, target.bitwiseAND(F.lit(SEGMENT_MASK)))
    return base, target - base


def declared_counts(declared: DataFrame, members: Sequence[DataFrame], key: str, n: str) -> DataFrame:
    """Declared against counted members per key, and whether they agree."""
    all_members = reduce(DataFrame.unionAll, [m.select(key) for m in members]).groupBy(key).agg(F.count("*").alias("n_found"))
    d = declared.join(all_members, key, "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return d.withColumn("agrees", F.col(n) == F.col("n_found"))


def attachments(rows: DataFrame, ref: str, families: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with the names of all families that have the reference; 0 and null are attached to nothing."""
    tagged = reduce(DataFrame.unionAll, [d.select(F.col(d.columns[0]).alias("__r"), F.lit(n).alias("__f")) for n, d in families.items()])
    sets = tagged.where(F.col("__r") != 0).groupBy("__r").agg(F.array_sort(F.collect_set("__f")).alias("families"))
    return rows.join(sets, F.col(ref) == F.col("__r"), "left").drop("__r").withColumn("families", F.coalesce("families", F.array().cast("array<string>")))


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: rows and distinct keys of two builders, keys of both, of one only, and keys that either repeats."""
    n = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(key, F.lit(0), F.lit(1))).where(F.col(key).isNotNull())
    each = n.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return each.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("rows_b"),
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("keys_both"), F.count_if(F.col("b") == 0).alias("keys_only_a"),
        F.count_if(F.col("a") == 0).alias("keys_only_b"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("keys_repeated"),
    )


def all_members(members: DataFrame, by: Sequence[str], ok: Column) -> DataFrame:
    """Whether every member of a group passes; null counts as not passing."""
    return members.groupBy(*by).agg(F.count("*").alias("n_members"), F.every(F.coalesce(ok, F.lit(False))).alias("all_pass"))


def range_members(children: DataFrame, by: Sequence[str], within: float = 2.0) -> DataFrame:
    """Per range child (prim_type 0): its fellow children inside it and whether their union is its box, both within ``within`` units.

    A composite's children are few (their count is a 16-bit field bounded at
    100 by the record), so the join inside one composite is small.
    """
    box = ("box_left", "box_bottom", "box_right", "box_top")
    r = children.where("prim_type = 0").select(*by, F.col("child_ref").alias("range_ref"), *[F.col(c).alias(f"r_{c}") for c in box])
    m = children.select(*by, "child_ref", *box)
    inside = (
        (F.col("box_left") >= F.col("r_box_left") - within) & (F.col("box_bottom") >= F.col("r_box_bottom") - within)
        & (F.col("box_right") <= F.col("r_box_right") + within) & (F.col("box_top") <= F.col("r_box_top") + within)
    )
    j = r.join(m, list(by)).where(inside & (F.col("child_ref") != F.col("range_ref")))
    near = lambda a, c: F.abs(a - F.first(f"r_{c}")) <= within
    same = near(F.min("box_left"), "box_left") & near(F.min("box_bottom"), "box_bottom") & near(F.max("box_right"), "box_right") & near(F.max("box_top"), "box_top")
    return j.groupBy(*by, "range_ref").agg(F.count("*").alias("n_members"), same.alias("exact"))


def route_name(terminals: Column, total: Column) -> Column:
    """A meaning only where the counts leave no choice: all chains of a group end in one place."""
    return F.when((terminals == 1) & (total > 0), "single_terminal").when(terminals == total, "all_separate").otherwise("unresolved")


def resource_inventory(streams: DataFrame) -> DataFrame:
    """Per numbered resource storage: its streams, whether it has contents, printable text and an image header."""
    rid = F.regexp_extract("stream", "JSite([0-9]+)/", 1)
    return streams.withColumn("resource_id", F.nullif(rid, F.lit("")).try_cast("int")).where("resource_id is not null").groupBy("path", "resource_id").agg(
        F.count("*").alias("n_streams"), F.bool_or(F.col("stream").endswith("/CONTENTS")).alias("has_contents"),
        F.bool_or(F.substring("data", 1, 2) == F.lit(b"BM")).alias("has_image"), F.sum(F.length("data")).alias("n_bytes"),
    )


def counter_map(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """(by..., counts): how often each key occurs, as a map; absent keys count 0 by ``try_element_at``'s default."""
    n = rows.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("counts"))


def count_in(counts: Column, key: Column) -> Column:
    return F.coalesce(F.try_element_at(counts, key), F.lit(0))


def array_pairs(items: Column) -> Column:
    """All pairs (first, second) of places i < j of one array."""
    at = F.sequence(F.lit(0), F.size(items) - 1)
    pairs = F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j > i), lambda j: F.struct(F.get(items, i).alias("first"), F.get(items, j).alias("second"))))
    return F.when(F.size(items) > 1, F.flatten(pairs))


def named_children(entries: DataFrame, by: Sequence[str], index: str, name: str, children: str) -> DataFrame:
    """(by..., parent, place, child, child_name) of entries that list their children by index; an index no entry has gives a null name."""
    e = entries.select(*by, F.col(index).alias("parent"), F.posexplode(children).alias("place", "child"))
    known = entries.select(*by, F.col(index).alias("child"), F.col(name).alias("child_name")).dropDuplicates([*by, "child"])
    return e.join(known, [*by, "child"], "left").select(*by, "parent", "place", "child", "child_name")


def anchor_comparison(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n_left, n_right, status): whether two sides observe the same number of anchors; it only rejects, and matches nothing."""
    a = left.groupBy(*by).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*by).agg(F.count("*").alias("n_right"))
    d = a.join(b, list(by), "full").fillna(0, ["n_left", "n_right"])
    same = F.col("n_left") == F.col("n_right")
    return d.withColumn("status", F.when(same & (F.col("n_left") == 1), "unique_anchor").when(same, "several_anchors").otherwise("anchor_mismatch"))


def arm_geometry(arms: DataFrame, by: Sequence[str], parallel: float = 0.98, least: float = 0.90) -> DataFrame:
    """(by..., cos_left, cos_right, status) of junctions with two open arms on each side.

    ``arms`` (by..., side, arm, dx, dy) has the direction of each open arm away
    from the junction.  Arms that are parallel on the left but not on the right
    reject the junction; nothing is matched here.  Junctions with other numbers
    of arms or an arm without direction give no row.
    """
    size = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    unit = arms.where(size > 0).withColumn("u", F.struct("arm", (F.col("dx") / size).alias("x"), (F.col("dy") / size).alias("y")))
    side = unit.groupBy(*by).pivot("side", ["left", "right"]).agg(F.array_sort(F.collect_list("u")))
    cosine = lambda c: F.abs(F.get(F.col(c), F.lit(0)).x * F.get(F.col(c), F.lit(1)).x + F.get(F.col(c), F.lit(0)).y * F.get(F.col(c), F.lit(1)).y)
    two = side.where((F.size("left") == 2) & (F.size("right") == 2)).select(*by, cosine("left").alias("cos_left"), cosine("right").alias("cos_right"))
    return two.withColumn("status", F.when((F.col("cos_left") >= parallel) & (F.col("cos_right") < least), "rejected").otherwise("not_rejected"))
