"""Points in zones where each video has zones of its own: polygons cut into grid cells.

A polygon's cells are wholly inside, or on its outline; only these carry the polygon and need the exact test. A point then meets
its zones by an equality on video and cell, whatever the number of videos and polygons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geometry import inside, polygon_distance

#: The side of a cell, in pixels.
SIDE = 16.0


def square(v: Column | str, side: float = SIDE) -> Column:
    return F.floor((F.col(v) if isinstance(v, str) else v) / side).cast("int")


def zone_cells(zones: DataFrame, side: float = SIDE) -> DataFrame:
    """Adds cx and cy for each cell that a zone reaches, and `edge`: whether its outline may pass through; poly is null in cells wholly inside."""
    bound = lambda axis, f: f(F.transform("poly", lambda p: p[axis]))
    span = lambda axis: F.sequence(square(bound(axis, F.array_min), side), square(bound(axis, F.array_max), side))
    cells = zones.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    # a cell whose centre is farther from the outline than its corners lies on one side of it
    depth = polygon_distance((F.col("cx") + 0.5) * side, (F.col("cy") + 0.5) * side, F.col("poly"))
    reach = side * 0.7072
    cells = cells.withColumn("_depth", depth).where(F.col("_depth") >= -reach).withColumn("edge", F.col("_depth") <= reach)
    return cells.withColumn("poly", F.when(F.col("edge"), F.col("poly"))).drop("_depth")


def in_zones(points: DataFrame, cells: DataFrame, x: str = "x", y: str = "y", side: float = SIDE) -> DataFrame:
    """Each point with each zone of its video that it is in (on the outline is in). Points in no zone are left out."""
    placed = points.withColumn("cx", square(x, side)).withColumn("cy", square(y, side))
    met = placed.join(cells, ["video_id", "cx", "cy"])
    return met.where(~F.col("edge") | inside(F.col(x), F.col(y), F.col("poly"))).drop("cx", "cy", "edge", "poly")
