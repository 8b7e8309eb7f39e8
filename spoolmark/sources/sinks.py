"""Sinks: drawings, traces, reports, flat files and an append-only source store.

All but the store write what Spark's own writers write; the work is shaping
rows.  One document is one page or file, ordered inside its own aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spoolmark.functions.text import html_escape


def svg_pages(elements: DataFrame, by: list[str], width: float, height: float) -> DataFrame:
    """(by..., value): a drawing per page from elements (layer, ord, x1, y1, x2, y2, label), lower layers first, y downwards."""
    n = lambda c: F.call_function("format_number", c, F.lit("0.###"))
    line = F.concat(
        F.lit('<line x1="'), n(F.col("x1")), F.lit('" y1="'), n(height - F.col("y1")), F.lit('" x2="'), n(F.col("x2")), F.lit('" y2="'), n(height - F.col("y2")),
        F.lit('"><title>'), html_escape(F.coalesce("label", F.lit(""))), F.lit("</title></line>"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "ord", line.alias("e")))), lambda x: x.e), "\n")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}">\n'
    return elements.groupBy(*by).agg(F.concat(F.lit(head), body, F.lit("\n</svg>")).alias("value"))


def trace_pages(segments: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., segments, texts, counts): one nested trace per page; a page without texts or segments has an empty list."""
    s = segments.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*[c for c in segments.columns if c not in by]))).alias("segments"))
    t = texts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*[c for c in texts.columns if c not in by]))).alias("texts"))
    j = s.join(t, by, "full")
    j = j.withColumn("segments", F.coalesce("segments", F.from_json(F.lit("[]"), F.lit(s.schema["segments"].dataType.simpleString()))))
    j = j.withColumn("texts", F.coalesce("texts", F.from_json(F.lit("[]"), F.lit(t.schema["texts"].dataType.simpleString()))))
    return j.withColumn("counts", F.struct(F.size("segments").alias("segments"), F.size("texts").alias("texts")))


def report(rows: DataFrame, title: str) -> DataFrame:
    """(section, json, markdown): the lines of a report, one per row, after a head with section 0; nothing is gathered into one row.

    Written in the order of (section, json) they are a JSON-lines and a
    Markdown document.
    """
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    body = rows.select(F.lit(1).alias("section"), F.to_json(F.struct(*rows.columns)).alias("json"), cells.alias("markdown"))
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}"
    first = rows.sparkSession.range(1).select(F.lit(0).alias("section"), F.to_json(F.struct(F.lit(title).alias("title"))).alias("json"), F.lit(head).alias("markdown"))
    return first.unionByName(body)


def write_report(lines: DataFrame, location: str) -> None:
    """Both documents of a report, each in the order of its lines."""
    for form in ("json", "markdown"):
        lines.orderBy("section", "json").select(F.col(form).alias("value")).write.mode("overwrite").text(f"{location}/{form}")


def write_csv(rows: DataFrame, location: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(location)


def write_json(rows: DataFrame, location: str, by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(location)


def write_text(documents: DataFrame, location: str) -> None:
    """One text file part per task with the column ``value``."""
    documents.select("value").write.mode("overwrite").text(location)


def with_digest(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col(content), 256))


def store_sources(files: DataFrame, location: str) -> int:
    """Append files (path, content) whose digest the store does not have yet; returns how many were new."""
    spark = files.sparkSession
    new = with_digest(files).dropDuplicates(["sha256"])
    try:
        have = spark.read.parquet(location).select("sha256")
        new = new.join(have, "sha256", "left_anti")
    except Exception as error:  # an absent store is an empty one
        if "PATH_NOT_FOUND" not in str(error):
            raise
    before = new.withColumn("stored_at", F.current_timestamp()).cache()
    n = before.count()
    if n:
        before.write.mode("append").parquet(location)
    before.unpersist()
    return n


def integrity(stored: DataFrame, content: str = "content") -> DataFrame:
    """One row: files and how many still have the digest they were stored with."""
    same = F.sha2(F.col(content), 256) == F.col("sha256")
    return stored.agg(F.count("*").alias("n_files"), F.count_if(same).alias("n_intact"), F.coalesce(F.every(same), F.lit(True)).alias("all_intact"))
