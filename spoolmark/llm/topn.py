"""The N best items of every group, by a mergeable bounded heap.

Each task keeps, per group, the N best distinct items it has seen with their
best scores; these heaps are built batch by batch before the only shuffle and
are merged after it.  That is exact although an item may be scored more than
once: an item outside the N best distinct items of a task is beaten there by N
other items, and these beat it everywhere.  A group of any size costs at most
N rows a task, so a group that holds a third of all rows is no hot spot, and
the merge of one group reads at most N rows a task.

Defined results: rows with a null in the group's last key or in the item, or
with a null or NaN score, do not count; a null in an earlier key is a value of
its own; infinite scores are ordinary values; -0.0 is read as 0.0; equal
scores are ordered by the item's code points; groups with fewer than N items
give what they have; an empty table gives no rows; further columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

#: Rows a task buffers before it reduces them to heaps, and heap rows it holds before handing them on.
BUFFER_ROWS = 200_000
HELD_ROWS = 1_000_000


def heaps(rows: pa.Table, group: list[str], item: str, score: str, n: int) -> pa.Table:
    """The n best distinct items of every group of ``rows``, with their best scores."""
    best = rows.group_by([*group, item], use_threads=False).aggregate([(score, "max")])
    best = best.rename_columns([score if c == f"{score}_max" else c for c in best.column_names]).select(rows.column_names)
    best = best.sort_by([(g, "ascending") for g in group] + [(score, "descending"), (item, "ascending")])
    first = np.zeros(best.num_rows, bool)
    first[:1] = True
    for g in group:
        code = pc.fill_null(best[g].combine_chunks().dictionary_encode().indices, -1).to_numpy()
        first[1:] |= code[1:] != code[:-1]
    start = np.flatnonzero(first)
    rank = np.arange(best.num_rows) - np.repeat(start, np.diff(np.append(start, best.num_rows)))
    return best.filter(pa.array(rank < n))


def top_n(rows: DataFrame, group: list[str], item: str, score: str, n: int) -> DataFrame:
    """(group..., rnk, item, score) for the n best items of every group, rnk from 1."""
    s = F.col(score).cast("double")
    valid = rows.where(F.col(group[-1]).isNotNull() & F.col(item).isNotNull() & s.isNotNull() & ~F.isnan(s))
    valid = valid.select(*group, item, (s + F.lit(0.0)).alias(score))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, buffer, size = None, [], 0
        for batch in batches:
            buffer.append(batch)
            size += batch.num_rows
            if size >= max(BUFFER_ROWS, held.num_rows if held else 0):
                held = heaps(pa.concat_tables([*([held] if held else []), pa.Table.from_batches(buffer)]), group, item, score, n)
                buffer, size = [], 0
                if held.num_rows >= HELD_ROWS:  # heaps of the same group merge later all the same
                    yield from held.to_batches(max_chunksize=50_000)
                    held = None
        if buffer:
            held = heaps(pa.concat_tables([*([held] if held else []), pa.Table.from_batches(buffer)]), group, item, score, n)
        if held:
            yield from held.to_batches(max_chunksize=50_000)

    partial = valid.mapInArrow(build, valid.schema)
    # One shuffle by group serves the best score per item and the rank.
    best = partial.repartition(*group).groupBy(*group, item).agg(F.max(score).alias(score))
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), item)
    ranked = best.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= n)
    return ranked.select(*group, F.col("rnk").cast("int").alias("rnk"), item, score)
