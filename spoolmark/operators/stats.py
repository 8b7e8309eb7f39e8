"""Counts and robust statistics over groups.

Nulls in a measured value do not count; a null group key is a group of its
own; an empty table gives no groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spoolmark.plans.lineage import cut


def _same(by: Sequence[str]) -> Column:
    """Null-safe equality of the group columns with their copies under ``__``."""
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    return same


def _copied(by: Sequence[str]) -> list[Column]:
    return [F.col(b).alias(f"__{b}") for b in by]


#: Half the width of the rank bracket around the middle, and the accuracy of the sketch that proposes it.
BRACKET, ACCURACY = 0.002, 2_000


def _values(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))


def _middles(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n, lower, upper): rows and the two middle values (equal for an odd count) of each group of ``values`` (by..., __v).

    A mergeable sketch proposes a bracket of values around the middle; all
    smaller values of a group become one count, larger ones are left out, and
    the few values inside are ranked exactly.  Should a bracket miss the middle,
    which the sketch's error bound rules out, all values are ranked.
    """
    keys = list(by) or ["__all"]
    v = values if by else values.withColumn("__all", F.lit(0))
    sketch = v.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", [0.5 - BRACKET, 0.5 + BRACKET], ACCURACY).alias("__q"))
    sketch = cut(sketch, "sketch").select(*_copied(keys), F.col("__n"), F.get("__q", F.lit(0)).alias("__lo"), F.get("__q", F.lit(1)).alias("__hi"))
    near = v.join(sketch, _same(keys)).where(F.col("__v") <= F.col("__hi"))
    freq = near.groupBy(*keys, F.when(F.col("__v") >= F.col("__lo"), F.col("__v")).alias("__v"), "__n").agg(F.count("*").alias("__c"))
    found = cut(_ranked(freq, keys), "middles")
    if found.where("lower is null or upper is null").limit(1).count():
        whole = v.groupBy(*keys, "__v").agg(F.count("*").alias("__c")).withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))
        found = _ranked(whole, keys)
    return found if by else found.drop("__all")


def _ranked(freq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n, lower, upper) from frequencies (keys..., __v, __c) of groups of __n rows; a null value stands below all others.

    Frequencies are cut into ranges of (group, value), so a group of any size is
    spread over tasks.  Counts per range tell which range holds a middle place;
    only the values of those ranges are ranked.
    """
    placed = cut(freq.repartitionByRange(*keys, "__v").select(*keys, "__v", "__c", "__n", F.spark_partition_id().alias("__p")), "ranges")
    sums = placed.groupBy(*keys, "__p", "__n").agg(F.sum("__c").alias("__s"))
    # One row per range that holds a part of the group.
    before = F.sum("__s").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__s")
    offsets = sums.select(*keys, "__p", "__s", before.alias("__before"), F.col("__n").alias("n"))
    low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")
    holds = ((low >= F.col("__before")) & (low < F.col("__before") + F.col("__s"))) | ((high >= F.col("__before")) & (high < F.col("__before") + F.col("__s")))
    wanted = offsets.where(holds).select(*_copied(keys), F.col("__p").alias("__q"), "__before", "n")
    near = placed.join(wanted, _same(keys) & (F.col("__p") == F.col("__q")))
    up_to = F.col("__before") + F.sum("__c").over(Window.partitionBy(*keys, "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = near.withColumn("__u", up_to)
    pick = lambda place: F.min_by("__v", F.when(F.col("__u") > place, F.col("__u")))
    return at.groupBy(*keys).agg(F.first("n").alias("n"), pick(low).alias("lower"), pick(high).alias("upper"))


def median_mad(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median and median absolute deviation of each group, exact, with the group's count.

    Both are found by ``_middles``; the deviations need
    the medians first, whose table has one row per group.  A group without a
    value has n = 0 and null medians.
    """
    values = _values(rows, by, value)
    half = (F.col("lower") + F.col("upper")) / 2
    med = _middles(values, by).select(*by, "n", half.alias("med"))
    keys = med.select(*_copied(by), F.col("med").alias("__med"))
    joined = values.join(keys, _same(by)) if by else values.crossJoin(F.broadcast(keys))  # one row when there are no keys
    apart = joined.select(*by, F.abs(F.col("__v") - F.col("__med")).alias("__v"))
    mad = _middles(apart, by).select(*_copied(by), half.alias("mad"))
    both = med.join(mad, _same(by)) if by else med.crossJoin(F.broadcast(mad))
    both = both.select(*by, "n", "med", "mad")
    if not by:
        # Without a value there is no frequency; the answer is still one row.
        one = rows.sparkSession.range(1).select(F.lit(0).alias("one"))
        filled = one.join(both, F.lit(True), "left")
        return filled.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), "med", "mad")
    groups = rows.select(*_copied(by)).distinct()
    return groups.join(both, _same(by), "left").select(*[F.col(f"__{b}").alias(b) for b in by], F.coalesce("n", F.lit(0)).cast("long").alias("n"), "med", "mad")


def outliers(rows: DataFrame, by: Sequence[str], value: str, factor: float = 4.0, least: float = 1.0) -> DataFrame:
    """``rows`` marked ``dense`` above median + factor * max(MAD, least) or ``sparse`` below its mirror (not below 0)."""
    stats = median_mad(rows, by, value).select(*_copied(by), "med", "mad")
    reach = factor * F.greatest(F.col("mad"), F.lit(least))
    mark = F.when(F.col(value) > F.col("med") + reach, "dense").when(F.col(value) < F.greatest(F.lit(0.0), F.col("med") - reach), "sparse")
    joined = rows.join(stats, _same(by)) if by else rows.crossJoin(F.broadcast(stats))  # one row when there are no keys
    return joined.withColumn("mark", mark).where("mark is not null").drop("mad", *[f"__{b}" for b in by])


def upper_median(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The element at place n/2 of the sorted values, from 0: the upper of the two middle ones for an even count."""
    return _middles(_values(rows, by, value), by).select(*by, F.col("upper").alias("upper_median"), "n")


def pooled_medians(rows: DataFrame, by: Sequence[str], value: str, style: Sequence[str]) -> DataFrame:
    """Median per style over the medians of its groups (``style`` columns within ``by``): every group counts once, whatever its size."""
    per_group = _middles(_values(rows, by, value), by).select(*by, ((F.col("lower") + F.col("upper")) / 2).alias("__m"))
    pooled = _middles(_values(per_group, style, "__m"), style)
    return pooled.select(*style, F.col("n").alias("n_groups"), ((F.col("lower") + F.col("upper")) / 2).alias("med"))


def mode(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, the largest of equals."""
    freq = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return freq.groupBy(*by).agg(F.max(F.struct("n", value)).alias("m")).select(*by, f"m.{value}", "m.n")


def occurrences(rows: DataFrame, value: str, known: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences and distinct values, and how many of each are known."""
    k = known.select(F.col(value).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    freq = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c")).join(k, F.col(value) == F.col("__k"), "left")
    return freq.groupBy(*by).agg(
        F.sum("c").alias("n_occurrences"), F.count("*").alias("n_distinct"), F.count_if("__hit").alias("n_known"),
        F.coalesce(F.sum(F.when(F.col("__hit"), F.col("c"))), F.lit(0)).alias("n_known_occurrences"),
    )


def multiplicity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys of ``left`` have 0, 1, 2, ... rows in ``right``."""
    counts = right.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__c"))
    joined = left.select(key).distinct().join(counts, F.col(key) == F.col("__k"), "left")
    return joined.groupBy(F.coalesce("__c", F.lit(0)).alias("multiplicity")).agg(F.count("*").alias("n_keys"))


def inliers(rows: DataFrame, hypothesis: str, sample: str, score: str, least: float) -> DataFrame:
    """Support of each hypothesis: scores, inliers, samples with an inlier, means and its lead over the next one."""
    from pyspark.sql import Window

    inside = F.col(score) >= least
    agg = rows.groupBy(hypothesis).agg(
        F.count(score).alias("n"), F.count_if(inside).alias("n_inliers"), F.countDistinct(F.when(inside, F.col(sample))).alias("n_samples"),
        F.avg(score).alias("mean"), F.avg(F.when(inside, F.col(score))).alias("inlier_mean"),
    )
    w = Window.orderBy(F.desc("n_inliers"), F.asc(hypothesis))  # one row per hypothesis, a fixed list
    return agg.withColumn("lead", F.col("n_inliers") - F.lead("n_inliers").over(w)).withColumn(
        "wins", F.coalesce((F.row_number().over(w) == 1) & (F.col("n_samples") >= 2) & (F.col("lead") >= 2), F.lit(False))
    )


def mean_absolute_difference(a: Column, b: Column) -> Column:
    """Mean of |a - b| over two arrays of one length; null for empty or unequal ones."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a))


def _others(children: Column, i: Column, side: str) -> Column:
    pick = F.array_min if side in ("box_left", "box_bottom") else F.array_max
    return pick(F.transform(F.filter(children, lambda x, j: j != i), lambda x: x[side]))


BOX = ("box_left", "box_bottom", "box_right", "box_top")


def _siblings(children: Column, sides: Sequence[str], test) -> Column:
    def holds(i: Column) -> Column:
        ok = F.size(children) > 2
        for side in sides:
            ok = ok & test(F.get(children, i)[side], _others(children, i, side), side)
        return ok

    return F.filter(F.sequence(F.lit(0), F.size(children) - 1), holds)


def sibling_union(children: Column, sides: Sequence[str] = BOX) -> Column:
    """For an array of boxes: places (from 0) of those that equal the union box of all others on the given sides."""
    return _siblings(children, sides, lambda own, others, side: own == others)


def sibling_cover(children: Column, sides: Sequence[str] = BOX) -> Column:
    """Places of the boxes that reach at least as far as the union of all others on the given sides."""
    return _siblings(children, sides, lambda own, others, side: own <= others if side in ("box_left", "box_bottom") else own >= others)
