"""Spatial joins by grid buckets: rows meet only inside a cell, and the exact predicate follows.

Null or non-finite coordinates match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spoolmark.functions import geometry as geo


def _finite(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    return F.coalesce(ok, F.lit(False))


def _cells(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def boxes_meet(a: DataFrame, b: DataFrame, by: Sequence[str], box_a: Sequence[str], box_b: Sequence[str], cell: float, pad: float = 0.0) -> DataFrame:
    """Pairs of one group whose boxes (left, bottom, right, top) overlap, ``b`` widened by ``pad``; touching counts.

    A pair that shares several cells is kept in the cell of its lower left overlap only, so
    there is no distinct afterwards.
    """
    al, ab, ar, at = box_a
    bl, bb, br, bt = box_b
    ga = a.where(_finite(*box_a)).select("*", F.explode(_cells(F.col(al), F.col(ar), cell)).alias("__x")).select("*", F.explode(_cells(F.col(ab), F.col(at), cell)).alias("__y"))
    gb = b.where(_finite(*box_b)).select("*", F.explode(_cells(F.col(bl) - pad, F.col(br) + pad, cell)).alias("__x")).select("*", F.explode(_cells(F.col(bb) - pad, F.col(bt) + pad, cell)).alias("__y"))
    joined = ga.join(gb, [*by, "__x", "__y"])
    meet = (F.col(al) <= F.col(br) + pad) & (F.col(bl) - pad <= F.col(ar)) & (F.col(ab) <= F.col(bt) + pad) & (F.col(bb) - pad <= F.col(at))
    home = (F.floor(F.greatest(F.col(al), F.col(bl) - pad) / cell) == F.col("__x")) & (F.floor(F.greatest(F.col(ab), F.col(bb) - pad) / cell) == F.col("__y"))
    return joined.where(meet & home).drop("__x", "__y")


def epsilon_pairs(points: DataFrame, by: Sequence[str], ident: str, x: str, y: str, eps: float) -> DataFrame:
    """Pairs (id_a < id_b) of one group at most ``eps`` apart: each point meets the nine cells around it."""
    p = points.where(_finite(x, y)).select(*by, ident, x, y, F.floor(F.col(x) / eps).alias("__x"), F.floor(F.col(y) / eps).alias("__y"))
    near = F.explode(F.array(*[F.struct((F.col("__x") + i).alias("__x"), (F.col("__y") + j).alias("__y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = p.select(*by, F.col(ident).alias("id_a"), F.col(x).alias("xa"), F.col(y).alias("ya"), near.alias("__n")).select(*by, "id_a", "xa", "ya", "__n.__x", "__n.__y")
    b = p.select(*by, F.col(ident).alias("id_b"), F.col(x).alias("xb"), F.col(y).alias("yb"), "__x", "__y")
    d = geo.distance2(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb"))
    return a.join(b, [*by, "__x", "__y"]).where((F.col("id_a") < F.col("id_b")) & (d <= eps)).select(*by, "id_a", "id_b", d.alias("gap"))


def nearest_segment(points: DataFrame, segments: DataFrame, by: Sequence[str], ident: str, seg_id: str, limit: float) -> DataFrame:
    """Each point (px, py) with the nearest segment (x1, y1, x2, y2) of its group within ``limit``; ties by segment id.

    Points fall into cells of the limit's width, segments into all cells their widened box touches.
    """
    s = segments.where(_finite("x1", "y1", "x2", "y2")).select(
        *by, seg_id, "x1", "y1", "x2", "y2",
        F.explode(_cells(F.least("x1", "x2") - limit, F.greatest("x1", "x2") + limit, limit)).alias("__x"),
    ).select("*", F.explode(_cells(F.least("y1", "y2") - limit, F.greatest("y1", "y2") + limit, limit)).alias("__y"))
    p = points.where(_finite("px", "py")).select(*by, ident, "px", "py", F.floor(F.col("px") / limit).alias("__x"), F.floor(F.col("py") / limit).alias("__y"))
    d = geo.point_segment_2d(*[F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2")])
    return (
        p.join(s, [*by, "__x", "__y"]).withColumn("dist", d).where(F.col("dist") <= limit)
        .groupBy(*by, ident).agg(F.min(F.struct("dist", seg_id)).alias("m")).select(*by, ident, f"m.{seg_id}", "m.dist")
    )


def smallest_frame(points: DataFrame, frames: DataFrame, by: Sequence[str], ident: str, frame_id: str, cell: float, least: int = 2) -> DataFrame:
    """Each point with the smallest box around it among boxes that hold at least ``least`` points; ties by frame id."""
    p = points.where(_finite("px", "py")).withColumns({"pl": F.col("px"), "pb": F.col("py"), "pr": F.col("px"), "pt": F.col("py")})
    inside = boxes_meet(p, frames, by, ("pl", "pb", "pr", "pt"), ("box_left", "box_bottom", "box_right", "box_top"), cell)
    busy = inside.groupBy(*by, frame_id).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*by, frame_id)
    area = (F.col("box_right") - F.col("box_left")).cast("double") * (F.col("box_top") - F.col("box_bottom"))
    return (
        inside.join(busy, [*by, frame_id]).groupBy(*by, ident)
        .agg(F.min(F.struct(area.alias("area"), F.col(frame_id))).alias("m")).select(*by, ident, f"m.{frame_id}", "m.area")
    )


def rectangles(segments: DataFrame, by: Sequence[str], least: tuple[float, float] = (40, 40), most: tuple[float, float] = (1500, 500)) -> DataFrame:
    """Boxes closed by two horizontal and two vertical segments (x1, y1, x2, y2) whose corners are equal.

    Horizontals meet only those of the same left and right end, and each box
    asks for its two sides by key.
    """
    lo = lambda a, b: F.least(a, b)
    s = segments.where(_finite("x1", "y1", "x2", "y2"))
    h = s.where("y1 = y2 and x1 != x2").select(*by, lo("x1", "x2").alias("l"), F.greatest("x1", "x2").alias("r"), F.col("y1").alias("y")).distinct()
    v = s.where("x1 = x2 and y1 != y2").select(*by, F.col("x1").alias("x"), lo("y1", "y2").alias("b"), F.greatest("y1", "y2").alias("t")).distinct()
    box = h.withColumnRenamed("y", "b").join(h.withColumnRenamed("y", "t"), [*by, "l", "r"]).where("b < t")
    w, k = F.col("r") - F.col("l"), F.col("t") - F.col("b")
    box = box.where((w >= least[0]) & (w <= most[0]) & (k >= least[1]) & (k <= most[1]))
    for side in ("l", "r"):
        box = box.join(v.withColumnRenamed("x", side), [*by, side, "b", "t"], "left_semi")
    return box.select(*by, F.col("l").alias("box_left"), F.col("b").alias("box_bottom"), F.col("r").alias("box_right"), F.col("t").alias("box_top"))
