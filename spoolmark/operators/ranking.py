"""Order, top-k and margins, always with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_margin(rows: DataFrame, by: Sequence[str], score: str, ident: str) -> DataFrame:
    """``rows`` with their rank in the group and the lead over the next one, null when there is none.

    Rows with a null score come last; ties go by ``ident``.
    """
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(ident).asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col(score) - F.lead(score).over(w))


def best_with_margin(rows: DataFrame, by: Sequence[str], score: str, ident: str) -> DataFrame:
    """The first row of each group in the order of ``with_margin``, with its lead over the second.

    Every task keeps two rows of a group before the shuffle (the rank limit), so no group meets in one task.
    """
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(ident).asc_nulls_last())
    two = rows.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    following = F.lead(score).over(Window.partitionBy(*by).orderBy("rank"))
    return two.withColumn("margin", F.col(score) - following).where("rank = 1")


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given total order (reverse the order for the last one).

    Ranked rows that cannot be first are dropped before the shuffle by the rank limit.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each group with their rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def logical_order(pages: DataFrame, by: Sequence[str], logical: str, physical: str) -> DataFrame:
    """Pages in their logical order if that is 1..n without gap or repeat, else physical order; ``order_basis`` tells which."""
    whole = Window.partitionBy(*by)
    n = F.count("*").over(whole)
    exact = (F.count(logical).over(whole) == n) & (F.min(logical).over(whole) == 1) & (F.max(logical).over(whole) == n) & (F.size(F.collect_set(logical).over(whole)) == n)
    basis = pages.withColumn("order_basis", F.when(exact, "logical").otherwise("physical"))
    key = F.when(F.col("order_basis") == "logical", F.col(logical).cast("long")).otherwise(F.col(physical).cast("long"))
    return basis.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(key.asc_nulls_last(), physical)))


def weighted_sample(rows: DataFrame, taken: DataFrame, key: str, total: Column, families: Column, n: int) -> DataFrame:
    """The n rows of the highest total plus 50 per distinct family, none of them in ``taken``."""
    left = rows.join(taken.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")
    return left.withColumn("score", total + 50 * families).orderBy(F.desc("score"), F.col(key).asc()).limit(n)


def representatives(rows: DataFrame, stratum: Sequence[str], style: str, order: Sequence[Column], per_stratum: int) -> DataFrame:
    """The first row of each style in a stratum, at most ``per_stratum`` styles, styles by their first row."""
    first = first_per_key(rows, [*stratum, style], order)
    return top_per_group(first, stratum, order, per_stratum)
