"""Links between records: exact, unique, as-of, set-based and by tolerance.

Equality is SQL equality, so a null key links to nothing.  An ambiguous link
yields no row.  Every operator works on empty tables and keeps rows that occur
more than once unless it says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spoolmark.plans.lineage import cut


def coverage(left: DataFrame, right: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group of ``left``: its rows, those with a partner of the same key, and the rest.

    ``right`` is reduced to distinct keys first, so partners never multiply rows.
    """
    keys = right.select(F.col(key).alias("__k")).where(F.col(key).isNotNull()).distinct().withColumn("__hit", F.lit(True))
    joined = left.join(keys, F.col(key) == F.col("__k"), "left")
    hit = F.col("__hit").isNotNull()
    return joined.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(hit).alias("n_linked"), F.count_if(~hit).alias("n_unlinked")
    )


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key no row of ``right`` has; a null key is unmatched."""
    return left.join(right.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def unique_candidate(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` with the single row of ``right`` that shares their key; ambiguous keys give nothing.

    Ambiguity is decided by an aggregate on ``right`` before the join, so it never multiplies rows.
    """
    rest = [c for c in right.columns if c != key]
    single = right.groupBy(key).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in rest]).where("__n = 1").drop("__n")
    return left.join(single, key)


def candidate_distribution(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many rows of ``left`` have 0, 1, 2, ... candidates."""
    counts = right.groupBy(key).agg(F.count("*").alias("n_candidates"))
    return (
        left.select(key).join(counts, key, "left").groupBy(F.coalesce("n_candidates", F.lit(0)).alias("n_candidates")).agg(F.count("*").alias("n_rows"))
    )


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, value: Sequence[str]) -> DataFrame:
    """``left`` with the values of the latest row of ``right`` of its group that is not later.

    The rows of both sides are cut into ranges of (group, time), so a group of
    any size is spread over tasks.  Inside a range the last known values are
    carried forward; what a range begins with comes from the ranges before it,
    of which one row each is kept.  Ties among ``right`` are broken by the
    values themselves; a row of ``right`` at the same instant counts.
    """
    payload = F.struct(F.col(right_at), *[F.col(v) for v in value])
    events = right.where(F.col(right_at).isNotNull()).groupBy(*by, right_at).agg(F.max(payload).alias("__p"))
    a = left.select(*by, F.col(left_at).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(events.schema["__p"].dataType).alias("__p"))
    b = events.select(*by, F.col(right_at).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), "__p")
    placed = cut(a.unionByName(b).repartitionByRange(*by, "__t", "__side").withColumn("__range", F.spark_partition_id()), "ranges")
    lasts = placed.where("__side = 0").groupBy(*by, "__range").agg(F.max_by("__p", "__t").alias("__p"))
    # One row per group and range with rows of the group: few groups reach over more than one range.
    spread = placed.select(*by, "__range").distinct().join(lasts.select(*[F.col(x).alias(f"__{x}") for x in by], F.col("__range").alias("__r"), "__p"), _same(by) & (F.col("__range") == F.col("__r")), "left")
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spread.select(*[F.col(x).alias(f"__{x}") for x in by], F.col("__range").alias("__r"), F.last("__p", ignorenulls=True).over(earlier).alias("__carry")).where("__carry is not null")
    w = Window.partitionBy(*by, "__range").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = placed.withColumn("__own", F.last("__p", ignorenulls=True).over(w)).where("__side = 1")
    merged = merged.join(carried, _same(by) & (F.col("__range") == F.col("__r")), "left").withColumn("__last", F.coalesce("__own", "__carry"))
    timed = F.col("__t").isNotNull()
    return merged.select("__row.*", *[F.when(timed, F.col(f"__last.{v}")).alias(v) for v in value], F.when(timed, F.col(f"__last.{right_at}")).alias(right_at))


def _same(by: Sequence[str]) -> Column:
    same = F.lit(True)
    for x in by:
        same = same & F.col(x).eqNullSafe(F.col(f"__{x}"))
    return same


def within_texts(parts: DataFrame, texts: DataFrame, part: str, text: str, width: int = 4) -> DataFrame:
    """Distinct values of ``part`` that stand inside some ``text``, through an index of the pieces of the texts.

    A part is looked up by its first ``width`` characters (all of a shorter one)
    among the pieces of that length of every distinct text and then compared,
    so only pairs that share the piece meet.
    """
    p = parts.select(F.col(part).alias("__part")).where("__part is not null").distinct().withColumn("__piece", F.substring("__part", 1, width))
    t = texts.select(F.col(text).alias("__text")).where("__text is not null").distinct()
    sizes = F.explode(F.sequence(F.lit(0), F.lit(width))).alias("__w")
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("__text") - F.col("__w") + 1, F.lit(1))), lambda i: F.substr("__text", i, F.col("__w"))))
    index = t.select("__text", sizes).select("__text", F.explode(cuts).alias("__piece")).where("length(__piece) <= length(__text)").distinct()
    return p.join(index, "__piece").where(F.contains("__text", "__part")).select(F.col("__part").alias(part)).distinct()


def set_key(items: Column) -> Column:
    """A set of items as a canonical array: sorted, distinct."""
    return F.array_sort(F.array_distinct(items))


def equal_sets(sets: DataFrame, owner: str, items: str) -> DataFrame:
    """Owners with equal item sets: (members, n_members), one row per set that at least two owners hold."""
    return (
        sets.groupBy(set_key(F.col(items)).alias("items"))
        .agg(F.array_sort(F.collect_set(owner)).alias("members"))
        .where(F.size("members") > 1)
        .select("items", "members", F.size("members").alias("n_members"))
    )


def subset_pairs(small: DataFrame, large: DataFrame, a: str, b: str, items: str) -> DataFrame:
    """Pairs (a, b) where every item of a's set is in b's set, through an inverted index of the rarest item of a.

    Each small set is looked up by one item only, the one with the fewest large sets, so
    no pair is made that does not share it.
    """
    s = small.select(F.col(a), set_key(F.col(items)).alias("si")).where(F.size("si") > 0)
    index = large.select(F.col(b), F.explode(set_key(F.col(items))).alias("item"))
    freq = index.groupBy("item").agg(F.count("*").alias("freq"))
    probe = s.select(a, "si", F.explode("si").alias("item")).join(freq, "item", "left")
    rarest = probe.groupBy(a, "si").agg(F.min_by("item", F.struct(F.coalesce("freq", F.lit(0)), "item")).alias("item"))
    sets = large.select(F.col(b), set_key(F.col(items)).alias("li"))
    return rarest.join(index, "item").join(sets, b).where(F.size(F.array_except("si", "li")) == 0).select(a, b)


def tolerance_pairs(rows: DataFrame, key: Sequence[str], ident: str, value: str, floor: float, share: float) -> DataFrame:
    """Pairs of one key whose values differ by at most max(floor, share * larger), id_a < id_b.

    Values are hashed to linear cells up to floor/share and logarithmic ones
    beyond, a quarter of the tolerance wide.  A row meets the rows of its own
    cell and of the next four only, so each pair is made once and few in vain.
    """
    v = F.abs(F.col(value))
    knee, parts = floor / share, 4
    # Continuous and rising; two values within the tolerance are at most 1 apart, with room for rounding.
    linear = lambda x: x * ((1 - share) / floor)
    place = F.when(v <= knee, linear(v)).otherwise(F.log(v / knee) / -math.log1p(-share) + linear(knee))
    r = rows.where(F.col(value).isNotNull()).select(*key, ident, value, F.floor(place * (parts * (1 - 1e-9))).alias("__cell"))
    a = r.select(*key, F.col(ident).alias("__a"), F.col(value).alias("va"), F.col("__cell").alias("__own"), F.explode(F.sequence(F.col("__cell"), F.col("__cell") + parts)).alias("__cell"))
    b = r.select(*key, F.col(ident).alias("__b"), F.col(value).alias("vb"), "__cell")
    close = F.abs(F.col("va") - F.col("vb")) <= F.greatest(F.lit(floor), F.lit(share) * F.greatest(F.abs("va"), F.abs("vb")))
    once = (F.col("__a") < F.col("__b")) | ((F.col("__own") < F.col("__cell")) & (F.col("__a") > F.col("__b")))
    return a.join(b, [*key, "__cell"]).where(close & once).select(*key, F.least("__a", "__b").alias("id_a"), F.greatest("__a", "__b").alias("id_b"))


def prioritised(rows: DataFrame, key: str, families: Sequence[tuple[str, DataFrame]], value: str) -> DataFrame:
    """``rows`` with the value and name of the first family that has their key."""
    out, picks = rows, []
    for name, family in families:
        one = family.groupBy(F.col(key).alias("__k")).agg(F.min(value).alias(f"__v_{name}"))
        out = out.join(one, F.col(key) == F.col("__k"), "left").drop("__k")
        picks.append((name, F.col(f"__v_{name}")))
    source = F.lit(None).cast("string")
    for name, c in reversed(picks):
        source = F.when(c.isNotNull(), F.lit(name)).otherwise(source)
    return out.select(*rows.columns, F.coalesce(*[c for _, c in picks]).alias(value), source.alias("family"))
