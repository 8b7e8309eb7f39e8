"""Scans of drawing exchange text: pairs of a group code and a value, entities from code 0 to the next.

Lines come as (path, pos, line) with positions from 0.  Defined results: a
trailing code without value and codes that are no integers are left out; an
entity without the coordinates of its kind has null ones; a polyline's points
are its own 10/20 pairs (LWPOLYLINE) or those of the VERTEX entities up to its
SEQEND (POLYLINE), in order; a ring whose last point repeats the first is
closed without the repetition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spoolmark.functions.text import page_target
from spoolmark.operators.sequences import blocks


def pairs(lines: DataFrame) -> DataFrame:
    """(path, n, code, value) of the group code pairs."""
    w = Window.partitionBy("path").orderBy("pos")
    d = lines.withColumn("value", F.lead("line").over(w)).where((F.col("pos") % 2 == 0) & F.col("value").isNotNull())
    return d.select("path", (F.col("pos") / 2).cast("long").alias("n"), F.trim("line").try_cast("int").alias("code"), F.trim("value").alias("value")).where("code is not null")


def _first(code: int, kind: str) -> Column:
    own = F.when(F.col("code") == code, F.col("value"))
    return F.min_by(own, F.when(F.col("code") == code, F.col("n"))).try_cast(kind)


def _all(code: int) -> Column:
    rows = F.array_sort(F.collect_list(F.when(F.col("code") == code, F.struct("n", F.col("value").try_cast("double").alias("v")))))
    return F.transform(rows, lambda r: r.v)


def entities(lines: DataFrame) -> DataFrame:
    """(path, entity, etype, handle, layer, text, x, y, x2, y2, width, flags, points) in file order."""
    b = blocks(pairs(lines), ["path"], ["n"], F.col("code") == 0).where("block > 0")
    e = b.groupBy("path", F.col("block").alias("entity")).agg(
        F.min_by("value", "n").alias("etype"), _first(5, "string").alias("handle"), _first(8, "string").alias("layer"), _first(1, "string").alias("text"),
        *[_first(c, "double").alias(n) for c, n in ((10, "x"), (20, "y"), (11, "x2"), (21, "y2"), (43, "width"))], _first(70, "int").alias("flags"),
        _all(10).alias("xs"), _all(20).alias("ys"),
    )
    points = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.struct(p.xs.alias("x"), p.ys.alias("y")))
    return e.withColumn("points", points).drop("xs", "ys")


def texts(lines: DataFrame) -> DataFrame:
    """TEXT and MTEXT with their place and the page that a continuation note points to."""
    e = entities(lines).where(F.col("etype").isin("TEXT", "MTEXT"))
    return e.select("path", "handle", "layer", "text", "x", "y", page_target(F.col("text")).alias("target_page"), F.upper("text").contains("CONT").alias("continues"))


def polylines(lines: DataFrame) -> DataFrame:
    """(path, handle, layer, etype, points, closed, first, last, width) of LINE, LWPOLYLINE and POLYLINE."""
    e = entities(lines)
    w = Window.partitionBy("path").orderBy("entity").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.when(F.col("etype") == "POLYLINE", F.col("entity")).when(F.col("etype") != "VERTEX", F.lit(-1))
    e = e.withColumn("owner", F.last(opens, ignorenulls=True).over(w))
    vertices = e.where("etype = 'VERTEX' and owner > 0").groupBy("path", F.col("owner").alias("entity")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("entity", F.struct("x", "y").alias("p")))), lambda r: r.p).alias("own")
    )
    kinds = e.where(F.col("etype").isin("LINE", "LWPOLYLINE", "POLYLINE")).join(vertices, ["path", "entity"], "left")
    ends = F.array(F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    p = F.when(F.col("etype") == "LINE", ends).when(F.col("etype") == "POLYLINE", F.coalesce("own", F.array().cast("array<struct<x:double,y:double>>"))).otherwise(F.col("points"))
    d = kinds.withColumn("points", p)
    ring = (F.size("points") > 2) & (F.get("points", F.lit(0)) == F.try_element_at("points", F.lit(-1)))
    d = d.withColumn("closed", ring | (F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(1) == 1))
    d = d.withColumn("points", F.when(ring, F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0)))).otherwise(F.col("points")))
    return d.select("path", "handle", "layer", "etype", "points", "closed", F.get("points", F.lit(0)).alias("first"), F.try_element_at("points", F.lit(-1)).alias("last"), "width")


def paired_labels(labels: DataFrame, reach: float = 8.0) -> DataFrame:
    """Pairs of a continuation note and a page note at most ``reach`` apart that have no other partner."""
    from spoolmark.operators.graph import unique_pairs
    from spoolmark.operators.spatial import epsilon_pairs

    p = labels.withColumn("is_note", F.col("continues") & F.col("target_page").isNull()).where(F.col("is_note") | F.col("target_page").isNotNull())
    near = epsilon_pairs(p, ["path"], "handle", "x", "y", reach)
    side = p.select("path", "handle", "is_note")
    a = near.join(side.select("path", F.col("handle").alias("id_a"), F.col("is_note").alias("na")), ["path", "id_a"])
    b = a.join(side.select("path", F.col("handle").alias("id_b"), F.col("is_note").alias("nb")), ["path", "id_b"]).where("na != nb")
    pairs_ = b.select("path", F.when(F.col("na"), F.col("id_a")).otherwise(F.col("id_b")).alias("note"), F.when(F.col("na"), F.col("id_b")).otherwise(F.col("id_a")).alias("page_note"))
    return unique_pairs(pairs_, ["path"], "note", "page_note")


def semantic_pages(pipes: DataFrame, components: DataFrame, by: list[str]) -> DataFrame:
    """(by..., page_json): classified items as one semantic page per group, the form that nested pages are read in.

    ``pipes`` has (by..., place, kind, handles, endpoints), ``components``
    (by..., place, kind, handles); the items stand in the order of their
    places.  A group with items of one sort only has an empty list of the other.
    """
    listed = lambda d, *c: d.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", *c))), lambda x: F.struct(*[x[n].alias(n) for n in c])).alias("items"))
    p = listed(pipes, "kind", "handles", "endpoints").withColumnRenamed("items", "pipes")
    kinds = components.groupBy(*by, "kind").agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("component_counts"))
    c = listed(components, "kind", "handles").withColumnRenamed("items", "components").join(kinds, by)
    page = p.join(c, by, "full")
    count = F.coalesce(F.size("pipes"), F.lit(0))
    body = F.struct(F.greatest(count, F.lit(0)).alias("pipe_count"), "component_counts", F.coalesce("components", F.array()).alias("components"), F.coalesce("pipes", F.array()).alias("pipes"))
    return page.select(*by, F.to_json(body).alias("page_json"))
