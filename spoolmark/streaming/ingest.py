"""Streams of record files: the same parsing as in batch, with last-row-wins and windowed counts.

The state of every operator is bounded by a watermark or by its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from spoolmark.operators import rejects


def table_stream(spark: SparkSession, like: DataFrame, location: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files that appear at a location, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(location)


def split_stream(lines: DataFrame) -> DataFrame:
    """Parsed lines with ``reason``; the parser is a narrow expression and needs no state."""
    return rejects.read_lines(lines)


def window_counts(events: DataFrame, at: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts per window and key; windows close when the watermark passes, later rows are left out and their number is in the progress."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), *by, "n"
    )


def once_per_key(rows: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """The first row of each key, whose memory the watermark bounds."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def upsert(stream: DataFrame, location: str, key: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key in a table of versions; each batch writes a whole new version and then names it.

    A batch that is run again after a failure writes the same version, so the
    outcome is exactly once.
    """
    from spoolmark.operators.ranking import first_per_key

    last = [F.col(c).desc_nulls_last() for c in order]

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if epoch > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{location}/v{epoch - 1}").unionByName(batch)
        first_per_key(rows, key, last).write.mode("overwrite").parquet(f"{location}/v{epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
