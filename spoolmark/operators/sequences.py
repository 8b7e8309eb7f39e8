"""Operators over ordered rows of a group.

Every order ends in a unique column.  A null order value comes first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spoolmark.functions.text import serial_label


def _w(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def blocks(rows: DataFrame, by: Sequence[str], order: Sequence[str], header: Column) -> DataFrame:
    """``rows`` with the number of the block each belongs to; rows before the first header have block 0."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("block", F.sum(F.when(header, 1).otherwise(0)).over(w))


def islands(rows: DataFrame, by: Sequence[str], at: str, ident: str, gap: float, least: int) -> DataFrame:
    """Maximal runs whose neighbours are at most ``gap`` apart, with at least ``least`` rows."""
    w = _w(by, [at, ident])
    broken = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    run = F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.where(F.col(at).isNotNull()).withColumn("__b", broken).withColumn("run", run)
    return marked.groupBy(*by, "run").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")).where(F.col("n") >= least)


def pending_marker(rows: DataFrame, by: Sequence[str], order: Sequence[str], marker: Column, taker: Column) -> DataFrame:
    """Takers directly preceded, among markers and takers, by a marker."""
    d = rows.withColumn("__m", marker).withColumn("__t", taker).where("__m or __t")
    d = d.withColumn("__p", F.lag("__m").over(_w(by, order)))
    return d.where("__t and __p").drop("__m", "__t", "__p")


def near(rows: DataFrame, by: Sequence[str], order: Sequence[str], flag: Column, before: int, after: int, name: str) -> DataFrame:
    """``rows`` with whether any row from ``before`` places back to ``after`` ahead has the flag."""
    return rows.withColumn(name, F.coalesce(F.max(flag).over(_w(by, order).rowsBetween(-before, after)), F.lit(False)))


def running_ranges(sizes: DataFrame, by: Sequence[str], order: Sequence[str], size: str) -> DataFrame:
    """``sizes`` with the contiguous range (first, last) each takes, from 1, and whether it is empty."""
    last = F.sum(size).over(_w(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sizes.withColumn("last", last).withColumn("first", F.col("last") - F.col(size) + 1)


def numbering(rows: DataFrame, by: Sequence[str], order: Sequence[Column], prefix: str, fixed: Column | None = None) -> DataFrame:
    """``rows`` with a serial label in the given order; a fixed label where there is one."""
    label = serial_label(prefix, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return rows.withColumn("label", label if fixed is None else F.coalesce(fixed, label))


def transitions(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Per group: whether values strictly rise, and how many steps fall or are not 1."""
    step = F.col(value) - F.lag(value).over(_w(by, order))
    return rows.withColumn("__s", step).groupBy(*by).agg(
        F.count("*").alias("n"), F.coalesce(F.every(F.col("__s") > 0), F.lit(True)).alias("rises"), F.count_if(F.col("__s") < 0).alias("n_falls"), F.count_if(F.col("__s") != 1).alias("n_jumps")
    )


def windows(frames: DataFrame, by: Sequence[str], at: str, value: Column, lo: int, hi: int) -> DataFrame:
    """Every window of ``lo`` to ``hi`` consecutive places with the number of flagged frames inside.

    Flags are turned into running counts, so a window costs two lookups in the
    same ordered pass whatever its width.
    """
    w = _w(by, [at])
    d = frames.withColumn("__c", F.sum(F.when(value, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = F.coalesce(F.lag("__c", 1).over(w), F.lit(0))
    spans = [
        F.struct(F.lit(k).alias("width"), (F.lead("__c", k - 1).over(w) - before).alias("n_flagged")) for k in range(lo, hi + 1)
    ]
    return d.withColumn("__spans", F.array(*spans)).select(*by, F.col(at).alias("start"), F.explode("__spans").alias("s")).select(
        *by, "start", "s.width", "s.n_flagged"
    ).where("n_flagged is not null")


def alternate_sides(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with side left for even dense ranks from 0, right for odd ones."""
    rank = F.dense_rank().over(_w(by, order)) - 1
    return rows.withColumn("rank", rank).withColumn("side", F.when(rank % 2 == 0, "left").otherwise("right"))
