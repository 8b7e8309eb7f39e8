"""Plane and space geometry as column expressions; a null or degenerate input gives null unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def distance2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def distance3(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0.0)))


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def _clamp(t: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def point_segment_2d(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment; a segment of no length is its point."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(_clamp(((px - x1) * dx + (py - y1) * dy) / F.when(square == 0, 1.0).otherwise(square)))
    return distance2(px, py, x1 + t * dx, y1 + t * dy)


def point_segment_3d(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    d = [q - o for o, q in zip(a, b)]
    square = sum((c * c for c in d), F.lit(0.0))
    along = sum(((q - o) * c for q, o, c in zip(p, a, d)), F.lit(0.0))
    t = F.when(square == 0, 0.0).otherwise(_clamp(along / F.when(square == 0, 1.0).otherwise(square)))
    return distance3(p, [o + t * c for o, c in zip(a, d)])


def cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cosine of the angle between two vectors, clamped; null when one has no length."""
    norm = F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / F.when(norm > 0, norm))))


def angle_degrees(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.degrees(F.acos(cosine(ax, ay, bx, by)))


def bearing(x: Column, y: Column) -> Column:
    """Direction of a vector in degrees from 0 up to 360; 0 for a vector of no length."""
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


#: The eight directions in the order of their bearings.
OCTANTS = ["E", "NE", "N", "NW", "W", "SW", "S", "SE"]


def octant(degrees: Column) -> Column:
    place = F.floor(F.pmod(degrees + 22.5, F.lit(360.0)) / 45).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in OCTANTS]), place + 1)


def circular_delta(a: Column, b: Column, period: float = 360.0) -> Column:
    return F.abs(F.pmod(a - b + period / 2, F.lit(period)) - period / 2)


#: The eight symmetries of the square as matrices (xx, xy, yx, yy).
SYMMETRIES = {
    "identity": (1, 0, 0, 1), "flip_x": (-1, 0, 0, 1), "flip_y": (1, 0, 0, -1), "rotate_180": (-1, 0, 0, -1),
    "swap": (0, 1, 1, 0), "swap_flip_x": (0, -1, 1, 0), "swap_flip_y": (0, 1, -1, 0), "swap_flip_both": (0, -1, -1, 0),
}


def symmetric_images(x: Column, y: Column) -> Column:
    """Array of (transform, x, y) for the eight symmetries."""
    return F.array(*[F.struct(F.lit(k).alias("transform"), (a * x + b * y).alias("x"), (c * x + d * y).alias("y")) for k, (a, b, c, d) in SYMMETRIES.items()])


# Three isometric projections are in use; they are not interchangeable.
def project_half(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return (x - y) * 0.5, (x + y) * 0.288675 + z * 0.57735


def project_full(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return (x - y) * (math.sqrt(3) / 2), (x + y) / 2 + z


def project_short(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return (x - y) * 0.866, z - (x + y) / 2


def affine_axes(source: list[Column], target: list[Column]) -> Column:
    """Matrix (xx, xy, yx, yy) carrying the vectors (s1, s2) to (t1, t2), null when s1 and s2 are parallel."""
    ax, ay, bx, by = source
    cx, cy, dx, dy = target
    det = ax * by - ay * bx
    safe = F.when(F.abs(det) >= 1e-8, det)
    return F.when(
        safe.isNotNull(),
        F.struct(
            ((cx * by - dx * ay) / safe).alias("xx"), ((dx * ax - cx * bx) / safe).alias("xy"),
            ((cy * by - dy * ay) / safe).alias("yx"), ((dy * ax - cy * bx) / safe).alias("yy"),
        ),
    )


def similarity_image(x: Column, y: Column, frm: tuple[Column, Column], to: tuple[Column, Column], scale: Column, turn: Column, mirrored: Column) -> tuple[Column, Column]:
    u, v = x - frm[0], y - frm[1]
    v = F.when(mirrored, -v).otherwise(v)
    return to[0] + scale * (F.cos(turn) * u - F.sin(turn) * v), to[1] + scale * (F.sin(turn) * u + F.cos(turn) * v)


def segment_error(a: list[Column], b: list[Column]) -> Column:
    """Mean end distance of two segments (x1, y1, x2, y2), whichever way round is less."""
    straight = (distance2(a[0], a[1], b[0], b[1]) + distance2(a[2], a[3], b[2], b[3])) / 2
    swapped = (distance2(a[0], a[1], b[2], b[3]) + distance2(a[2], a[3], b[0], b[1])) / 2
    return F.least(straight, swapped)


def rotated_extent(width: Column, height: Column, turn: Column, least: float = 34.0) -> Column:
    """(along, across) of a box turned by ``turn`` with the axis-parallel extent given; the extent itself near 45 degrees."""
    c, s = F.abs(F.cos(turn)), F.abs(F.sin(turn))
    det = c * c - s * s
    usable = F.abs(det) > 0.08
    safe = F.when(usable, det).otherwise(1.0)
    along = F.when(usable, (width * c - height * s) / safe).otherwise(width)
    across = F.when(usable, (height * c - width * s) / safe).otherwise(height)
    return F.struct(F.greatest(F.lit(least), along).alias("along"), F.greatest(F.lit(least), across).alias("across"))


def boxes_overlap(a: list[Column], b: list[Column]) -> Column:
    """Whether two boxes (left, bottom, right, top) share a point, edges included."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def box_contains(outer: list[Column], inner: list[Column], margin: float = 0.0) -> Column:
    return (inner[0] >= outer[0] - margin) & (inner[1] >= outer[1] - margin) & (inner[2] <= outer[2] + margin) & (inner[3] <= outer[3] + margin)


def overlap_area(a: list[Column], b: list[Column]) -> Column:
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w.cast("double") * h


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_cross(a: list[Column], b: list[Column]) -> Column:
    """Whether two segments (x1, y1, x2, y2) cross in their interiors."""
    return (_side(*a, b[0], b[1]) * _side(*a, b[2], b[3]) < 0) & (_side(*b, a[0], a[1]) * _side(*b, a[2], a[3]) < 0)


def layout_score(expected: list[Column], observed: list[Column], weights: list[float], exact: float) -> Column:
    """Sum over features of ``exact`` when equal, else minus weight times the absolute difference."""
    parts = [F.when(e == o, F.lit(exact)).otherwise(-w * F.abs(e - o)) for e, o, w in zip(expected, observed, weights)]
    return sum(parts, F.lit(0.0))
