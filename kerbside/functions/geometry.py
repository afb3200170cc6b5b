"""Geometry as Column expressions: points, lines, polygons and boxes. All stay within generated code.

A polygon is an array of structs (x, y); `polygon` makes one from literals. Distances are in the units of the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Points = Sequence[tuple[float, float]]


def polygon(points: Points) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def edges(poly: Column) -> Column:
    """The sides, as structs (a, b), the last back to the first point."""
    return F.zip_with(poly, F.concat(F.slice(poly, 2, F.size(poly) - 1), F.slice(poly, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def side_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    at = F.least(F.greatest(F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - a["x"] - at * dx, y - a["y"] - at * dy)


def polygon_distance(x: Column, y: Column, poly: Column) -> Column:
    """Distance from the polygon's outline, positive inside and negative outside."""
    least = F.array_min(F.transform(edges(poly), lambda e: side_distance(x, y, e["a"], e["b"])))
    return F.when(_odd(x, y, poly), least).otherwise(-least)


def _odd(x: Column, y: Column, poly: Column) -> Column:
    """Ray casting: an odd number of sides to the right."""

    def hit(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.size(F.filter(edges(poly), hit)) % 2 == 1


def inside(x: Column, y: Column, poly: Column) -> Column:
    """In the polygon; its sides and corners belong to it."""

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(edges(poly), on) | _odd(x, y, poly)


def signed_side(x: Column, y: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Signed distance from the line through a and b."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = (dx * dx + dy * dy) ** 0.5 + 1e-9
    return ((x - a[0]) * F.lit(-dy) + (y - a[1]) * F.lit(dx)) / size


def within_extent(x: Column, y: Column, a: tuple[float, float], b: tuple[float, float], margin: float = 0.0) -> Column:
    """Whether the foot on the line lies between a and b, with a margin."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = (dx * dx + dy * dy) ** 0.5
    return ((x - a[0]) * F.lit(dx) + (y - a[1]) * F.lit(dy)).between(-margin * size, size * size + margin * size)


def polyline_side(x: Column, y: Column, line: Points) -> Column:
    """Struct (side, on): the signed distance from the nearest segment whose extent has the point (the first of equals), 0 and false if none has."""
    parts = [F.struct(F.abs(signed_side(x, y, a, b)).alias("d"), F.lit(i).alias("i"), signed_side(x, y, a, b).alias("side"), within_extent(x, y, a, b).alias("on")) for i, (a, b) in enumerate(zip(line[:-1], line[1:], strict=True))]
    best = F.array_min(F.filter(F.array(*parts), lambda p: p["on"]))
    return F.struct(F.coalesce(best["side"], F.lit(0.0)).alias("side"), best.isNotNull().alias("on"))


def affine(x: Column, y: Column, m: Sequence[float]) -> tuple[Column, Column]:
    """A point under a 2 x 3 matrix, given row by row."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def invert_affine(m: Sequence[float]) -> list[float]:
    det = m[0] * m[4] - m[1] * m[3]
    a, b, c, d = m[4] / det, -m[1] / det, -m[3] / det, m[0] / det
    return [a, b, -(a * m[2] + b * m[5]), c, d, -(c * m[2] + d * m[5])]


def transform_polygon(poly: Column, m: Sequence[float]) -> Column:
    return F.transform(poly, lambda p: F.struct(affine(p["x"], p["y"], m)[0].alias("x"), affine(p["x"], p["y"], m)[1].alias("y")))


def registration_accepted(m: Sequence[float], inliers: int, least_inliers: int = 40, most_shift: float = 150.0, most_scale: float = 0.15) -> bool:
    """Whether a camera registration is trusted; else the identity is used."""
    scale = (m[0] ** 2 + m[3] ** 2) ** 0.5
    return inliers >= least_inliers and (m[2] ** 2 + m[5] ** 2) ** 0.5 <= most_shift and abs(scale - 1) <= most_scale


Box = Sequence[Column]


def _overlap(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)


def area(a: Box) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2)."""
    both = _overlap(a, b)
    return both / (area(a) + area(b) - both + 1e-6)


def inside_fraction(a: Box, b: Box, floor: float = 1e-6) -> Column:
    """The share of box a that lies in box b."""
    return _overlap(a, b) / F.greatest(area(a), F.lit(floor))


def interval_iou(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Overlap of two intervals in time over their union; 0 for empty ones."""
    both = F.greatest(F.least(a[1], b[1]) - F.greatest(a[0], b[0]), F.lit(0.0))
    return F.coalesce(F.try_divide(both, a[1] - a[0] + b[1] - b[0] - both), F.lit(0.0))


def any_of(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))
