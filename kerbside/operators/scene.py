"""A grid model of normal traffic: visits, standing time and headings by cell, and what follows from them.

Grids are sparse tables (video_id, r, c) and (video_id, r, c, b); a missing cell is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators.kinematics import heading_bin

ROWS, COLS, BINS = 27, 48, 8
MOVING = 25.0
CELL = ("video_id", "r", "c")


def cell(v: Column, extent: float, n: int) -> Column:
    """The cell of a coordinate: cut towards zero, then kept in the grid."""
    return F.least(F.greatest((v / extent * n).cast("int"), F.lit(0)), F.lit(n - 1))


def with_cells(obs: DataFrame, width: float = 1280.0, height: float = 720.0) -> DataFrame:
    return obs.withColumn("r", cell(F.col("y"), height, ROWS)).withColumn("c", cell(F.col("x"), width, COLS))


def grid(cells: DataFrame, dt: float = 0.1) -> DataFrame:
    """Per cell: tracks that moved there (visits) and the time that vehicles stood there (dwell)."""
    moving = F.col("speed") >= MOVING
    return cells.groupBy(*CELL).agg(F.count_distinct(F.when(moving, F.col("tid"))).alias("visits"), F.sum(F.when(~moving, F.lit(dt)).otherwise(0.0)).alias("dwell"))


def heading_votes(cells: DataFrame) -> DataFrame:
    """Per cell and direction the number of tracks that moved so."""
    moving = cells.where(F.col("speed") >= MOVING).withColumn("b", heading_bin(F.col("vx"), F.col("vy")))
    return moving.groupBy(*CELL, "b").agg(F.count_distinct("tid").alias("votes"))


def blend(own: DataFrame, prior: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], weight: float = 1.0) -> DataFrame:
    """The own grid plus the prior's, weighted."""
    both = own.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unionByName(prior.select(*keys, *[(F.col(v) * weight).alias(v) for v in values]))
    return both.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def offsets(reach: int = 1) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]))


def dilated(cells: DataFrame) -> DataFrame:
    """The cells (video_id, r, c) and their neighbours within the grid."""
    near = cells.select(*CELL, offsets().alias("o")).select("video_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    return near.where(F.col("r").between(0, ROWS - 1) & F.col("c").between(0, COLS - 1)).distinct()


def road(g: DataFrame, least: int = 3) -> DataFrame:
    return dilated(g.where(F.col("visits") >= least))


def driven(g: DataFrame, least: int = 8) -> DataFrame:
    return g.where(F.col("visits") >= least).select(*CELL)


def queue_zone(g: DataFrame, seconds: float = 60.0) -> DataFrame:
    return g.where(F.col("dwell") >= seconds).select(*CELL)


def blurred(votes: DataFrame) -> DataFrame:
    """9 x the 3 x 3 mean of each direction's votes; beyond the border its own cells repeat. Only cells with votes near them."""
    # a source cell reaches a target within one step; on the border it counts once more for each missing neighbour
    near = votes.select("*", offsets().alias("o"))
    r, c = F.col("r") + F.col("o.dr"), F.col("c") + F.col("o.dc")

    def times(source: Column, target: Column, n: int) -> Column:
        edge = (source == 0) & (target == 0) | (source == n - 1) & (target == n - 1)
        return F.when(edge, 2).otherwise(1)

    near = near.select("video_id", r.alias("r"), c.alias("c"), "b", (F.col("votes") * times(F.col("r"), r, ROWS) * times(F.col("c"), c, COLS)).alias("votes"))
    return near.where(F.col("r").between(0, ROWS - 1) & F.col("c").between(0, COLS - 1)).groupBy(*CELL, "b").agg(F.sum("votes").alias("votes9"))


def direction_share(votes: DataFrame) -> DataFrame:
    """Per cell and direction (all eight): its share of the pooled votes, and all votes near the cell.

    A direction's pooled votes are its own and half of each neighbour's, after the 3 x 3 mean; the share is of the sum
    over all directions, which is twice the votes.
    """
    near = blurred(votes)
    pooled = near.select(*CELL, "votes9", F.explode(F.array(*[F.struct(F.pmod(F.col("b") + d, F.lit(BINS)).cast("int").alias("b"), F.lit(w).alias("w")) for d, w in ((-1, 1), (0, 2), (1, 1))])).alias("p"))
    by_bin = pooled.groupBy(*CELL, "p.b").agg(F.sum(F.col("votes9") * F.col("p.w")).alias("pooled18"))
    total = near.groupBy(*CELL).agg(F.sum("votes9").alias("total9"))
    all_bins = total.select(*CELL, "total9", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("b"))
    joined = all_bins.join(by_bin, [*CELL, "b"], "left")
    pooled18 = F.coalesce(F.col("pooled18"), F.lit(0))
    return joined.select(*CELL, "b", (F.col("total9") / 9).alias("votes"), ((pooled18 / 18) / F.greatest(F.col("total9") * 2 / 9, F.lit(1e-6))).alias("share"))


def dominant_direction(votes: DataFrame, groups: int = 2) -> DataFrame:
    """Per cell the direction with most votes (the lowest of equals) and its group."""
    best = votes.groupBy(*CELL).agg(F.max_by("b", F.struct("votes", -F.col("b"))).alias("b"))
    return best.withColumn("direction", F.floor(F.col("b") * groups / BINS).cast("int"))


def warped(g: DataFrame, m: list[float], values: tuple[str, ...], width: float = 1280.0, height: float = 720.0) -> DataFrame:
    """A grid under an inverse affine map: each target cell's centre looks up its nearest source cell."""
    spark = g.sparkSession
    a, b = width / COLS, height / ROWS
    cells = spark.range(ROWS * COLS).select(F.floor(F.col("id") / COLS).cast("int").alias("r"), (F.col("id") % COLS).cast("int").alias("c"))
    x, y = (F.col("c") + 0.5) * a, (F.col("r") + 0.5) * b
    target = cells.select("r", "c", F.floor((m[3] * x + m[4] * y + m[5]) / b).cast("int").alias("sr"), F.floor((m[0] * x + m[1] * y + m[2]) / a).cast("int").alias("sc"))
    source = g.select("video_id", F.col("r").alias("sr"), F.col("c").alias("sc"), *values)
    return source.join(F.broadcast(target), ["sr", "sc"]).select("video_id", "r", "c", *values)  # the target has ROWS x COLS rows


def warped_by_video(g: DataFrame, videos: DataFrame, bins: tuple[str, ...], values: tuple[str, ...], width: float = 1280.0, height: float = 720.0) -> DataFrame:
    """The grids of the videos' scenes, each seen through its video's map. g: scene_id, r, c, bins, values; videos: video_id, scene_id, m.

    m (six numbers, row by row; null: none) leads from the scene's pixels to the video's; on the grid its shift is in cells.
    Each cell of the video takes the nearest one of the scene, halves up; what lies outside is empty.
    """
    m = F.coalesce("m", F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)]))
    maps = videos.select("video_id", "scene_id", *[m[k].alias(f"m{k}") for k in (0, 1, 3, 4)], (m[2] * (COLS / width)).alias("m2"), (m[5] * (ROWS / height)).alias("m5"))
    cells = maps.select("*", F.explode(F.sequence(F.lit(0), F.lit(ROWS * COLS - 1))).alias("_k")).withColumn("r", F.floor(F.col("_k") / COLS).cast("int")).withColumn("c", (F.col("_k") % COLS).cast("int"))
    det = F.col("m0") * F.col("m4") - F.col("m1") * F.col("m3")
    x, y = F.col("c") - F.col("m2"), F.col("r") - F.col("m5")
    cells = cells.withColumn("_sc", F.floor((F.col("m4") * x - F.col("m1") * y) / det + 0.5).cast("int")).withColumn("_sr", F.floor((F.col("m0") * y - F.col("m3") * x) / det + 0.5).cast("int"))
    source = g.select("scene_id", F.col("r").alias("_sr"), F.col("c").alias("_sc"), *bins, *values)
    return cells.join(source, ["scene_id", "_sr", "_sc"]).select("video_id", "r", "c", *bins, *values)


def prior_of(cells: DataFrame, videos: DataFrame, dt: float = 0.1, width: float = 1280.0, height: float = 720.0) -> tuple[DataFrame, DataFrame]:
    """A prior from many videos of a scene: their grids and votes, each seen back through its video's map, and summed by scene."""
    m = F.col("m")
    det = m[0] * m[4] - m[1] * m[3]
    back = F.when(m.isNull(), None).otherwise(F.array(m[4] / det, -m[1] / det, (m[1] * m[5] - m[4] * m[2]) / det, -m[3] / det, m[0] / det, (m[3] * m[2] - m[0] * m[5]) / det))
    turned = videos.select(F.col("video_id").alias("scene_id"), F.col("scene_id").alias("_scene"), back.alias("m")).withColumn("video_id", F.col("scene_id"))
    out = []
    for g, bins, values in ((grid(cells, dt), (), ("visits", "dwell")), (heading_votes(cells), ("b",), ("votes",))):
        seen = warped_by_video(g.withColumnRenamed("video_id", "scene_id"), turned, bins, values, width, height).join(turned.select("video_id", "_scene"), "video_id")
        out.append(seen.groupBy(F.col("_scene").alias("scene_id"), "r", "c", *bins).agg(*[F.sum(v).cast("double").alias(v) for v in values]))
    return out[0], out[1]
