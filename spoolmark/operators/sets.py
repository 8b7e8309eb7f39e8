"""Set and multiset operators over rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def families(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of the parts with the name of theirs."""
    return reduce(DataFrame.unionByName, [p.withColumn("family", F.lit(n)) for n, p in parts.items()])


def distinct_values(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values that any of the columns holds."""
    pairs = F.explode(F.array(*[F.col(c).cast("long") for c in columns]))
    return rows.select(pairs.alias("value")).where("value is not null").distinct()


def multiset_difference(a: DataFrame, b: DataFrame, item: str, by: Sequence[str] = ()) -> DataFrame:
    """Items with their count in both and how many more the first holds; counted before the shuffle, null equals null."""
    both = a.select(*by, item, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionAll(b.select(*by, item, F.lit(0), F.lit(1)))
    n = both.groupBy(*by, item).agg(F.sum("__a").alias("a"), F.sum("__b").alias("b"))
    return n.select(*by, item, F.least("a", "b").alias("n_common"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("n_extra"))


def universe_gaps(rows: DataFrame, by: Sequence[str], number: str, low: int, high: int) -> DataFrame:
    """Numbers of low..high that a group lacks, and those it has more than once.

    Each group is one row of counts, so the gaps are found inside it without a join.
    """
    counts = rows.where(F.col(number).between(low, high)).groupBy(*by, number).agg(F.count("*").alias("c"))
    held = counts.groupBy(*by).agg(F.collect_set(number).alias("has"), F.array_sort(F.collect_set(F.when(F.col("c") > 1, F.col(number)))).alias("duplicates"))
    return held.select(*by, F.array_sort(F.array_except(F.sequence(F.lit(low), F.lit(high)), "has")).alias("missing"), "duplicates")


def range_intersection(ranges: DataFrame, by: Sequence[str], first: str, last: str) -> DataFrame:
    """The range that all ranges of a group share, if there is one."""
    return ranges.groupBy(*by).agg(F.max(first).alias("first"), F.min(last).alias("last")).where("first <= last")


def compare_names(expected: DataFrame, found: DataFrame, by: Sequence[str], name: str, reserved: Sequence[str]) -> DataFrame:
    """Per group: names missing and extra; accepted when nothing but the reserved names is missing and none is extra."""
    tagged = expected.select(*by, name, F.lit(1).alias("e"), F.lit(0).alias("f")).unionAll(found.select(*by, name, F.lit(0), F.lit(1)))
    each = tagged.groupBy(*by, name).agg(F.max("e").alias("e"), F.max("f").alias("f"))
    sides = each.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(F.col("f") == 0, F.col(name)))).alias("missing"), F.array_sort(F.collect_list(F.when(F.col("e") == 0, F.col(name)))).alias("extra")
    )
    allowed = F.array(*[F.lit(r) for r in reserved])
    return sides.withColumn("accepted", (F.size(F.array_except("missing", allowed)) == 0) & (F.size("extra") == 0))
