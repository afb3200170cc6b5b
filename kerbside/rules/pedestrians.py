"""Pedestrians on the road, and jaywalking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geometry import any_of, inside_fraction, iou, polygon, polygon_distance
from kerbside.operators import scene as S
from kerbside.operators.sequences import hysteresis, runs
from kerbside.rules import Context, events, rule
from kerbside.rules.flow import TRACK, at_time

BOX = ("x1", "y1", "x2", "y2")


def carried(ctx: Context) -> DataFrame:
    """Person observations of riders (on a two-wheeler) or of people inside a vehicle, by the vehicles' nearest observations."""
    v = ctx.vehicles.select("video_id", F.col("tid").alias("v"), F.col("kind").alias("vkind"), F.col("t").alias("vt"), F.floor(F.col("t") / 1.5).alias("slot"), *[F.col(c).cast("double").alias(f"v{c}") for c in BOX])
    v = v.withColumn("slot", F.explode(F.array(*[F.col("slot") + d for d in (-1, 0, 1)]))).hint("merge")  # Spark's estimate leaves exploded rows uncounted
    p = ctx.people.select(*TRACK, "t", *[F.col(c).cast("double").alias(c) for c in BOX], F.floor(F.col("t") / 1.5).alias("slot"))
    met = p.join(v, ["video_id", "slot"]).where(F.abs(F.col("t") - F.col("vt")) <= 0.75)
    near = met.groupBy(*TRACK, "t", *BOX, "v", "vkind").agg(F.min_by(F.struct(*[f"v{c}" for c in BOX]), F.struct(F.abs(F.col("t") - F.col("vt")), F.col("vt"))).alias("n"))
    own, other = [F.col(c) for c in BOX], [F.col(f"n.v{c}") for c in BOX]
    rides = F.col("vkind").isin("bicycle", "motorcycle") & (iou(own, other) > 0.3)
    sits = F.col("vkind").isin("car", "bus", "truck") & (inside_fraction(own, other, 1.0) >= 0.7)
    return near.where(rides | sits).select(*TRACK, "t").distinct()


def road_depth(ctx: Context) -> Column | None:
    """How deep in the drawn road a point is: the largest over all road areas."""
    areas = [*ctx.layout.road_areas, *[c["poly"] for c in ctx.layout.carriageways], *([ctx.layout.intersection] if ctx.layout.intersection else [])]
    if not areas:
        return None
    return F.greatest(*[polygon_distance(F.col("x"), F.col("y"), polygon(p)) for p in areas], F.lit(-1e9))


def on_road(ctx: Context, rows: DataFrame, in_order: bool = False) -> DataFrame:
    """Rows with `on_road`: deep in the road (with hysteresis along a track) where vehicles drive; without drawn areas, on the learned road."""
    depth = road_depth(ctx)
    if depth is None:
        return rows.join(S.road(ctx.grid).withColumn("on_road", F.lit(True)), ["video_id", "r", "c"], "left").withColumn("on_road", F.coalesce("on_road", F.lit(False)))
    rows = rows.withColumn("_depth", depth)
    deep = hysteresis(TRACK, "t", "_depth", 24.0, 4.0) if in_order else F.col("_depth") >= 12.0
    rows = rows.withColumn("_deep", deep).join(S.driven(ctx.grid).withColumn("_driven", F.lit(True)), ["video_id", "r", "c"], "left")
    return rows.withColumn("on_road", F.col("_deep") & F.coalesce("_driven", F.lit(False))).drop("_deep", "_driven", "_depth")


def walkers(ctx: Context, in_order: bool = False) -> DataFrame:
    """Observations of people on foot on the road."""
    return on_road(ctx, ctx.people, in_order).where("on_road").join(carried(ctx), [*TRACK, "t"], "left_anti")


def chain_pieces(pieces: pd.DataFrame, most_gap: float = 0.8, most_distance: float = 1.5) -> pd.DataFrame:
    """Joins a video's pieces, in the order of their starts, each to the nearest chain that ended just before it."""
    chains: list[dict] = []
    for p in pieces.sort_values(["start", "tid"]).to_dict("records"):
        options = []
        for i, c in enumerate(chains):
            far = np.hypot(p["x0"] - c["x1"], p["y0"] - c["y1"]) / max(c["height"], p["height"], 1.0)
            if -0.3 <= p["start"] - c["end"] <= most_gap and far <= most_distance:
                options.append((far, i))
        if not options:
            chains.append(p | {"tids": {p["tid"]}})
            continue
        c = chains[min(options)[1]]
        if p["end"] > c["end"]:
            c |= {k: p[k] for k in ("end", "x1", "y1")}
        c["height"] = max(c["height"], p["height"])
        c["tids"].add(p["tid"])
    rows = [{k: c[k] for k in ("video_id", "start", "end", "x0", "y0", "x1", "y1", "height")} | {"tids": sorted(c["tids"])} for c in chains]
    return pd.DataFrame(rows, columns=["video_id", "start", "end", "x0", "y0", "x1", "y1", "height", "tids"])


@rule("jaywalking")
def jaywalking(ctx: Context, margin: float = 15.0, most_speed: float = 2.5, least_height: float = 18.0, least_seconds: float = 1.0, least_travel: float = 1.5) -> DataFrame:
    """On foot on the road away from crossings, pieces joined over lost ids, over a real distance."""
    height = F.col("y2") - F.col("y1")
    away = ~any_of([polygon_distance(F.col("x"), F.col("y"), polygon(p)) >= -margin for p in [*ctx.layout.crossings, *ctx.layout.refuges]])
    fit = F.col("on_road") & away & (F.col("speed") / F.greatest(height, F.lit(1.0)) <= most_speed) & (height >= least_height)
    rows = on_road(ctx, ctx.people, True).withColumn("height", height.cast("double"))
    rows = rows.join(carried(ctx).withColumn("_carried", F.lit(True)), [*TRACK, "t"], "left").withColumn("_fit", fit & F.col("_carried").isNull())
    found = runs(rows, TRACK, "t", "_fit", 1.0).select(*TRACK, "start", "end")
    found = at_time(at_time(found, ctx.people, "start", x0="x", y0="y"), ctx.people, "end", x1="x", y1="y")
    sized = found.join(rows.select(*TRACK, "t", "height"), TRACK).where(F.col("t").between(F.col("start"), F.col("end")))
    pieces = sized.groupBy(*found.columns).agg(F.percentile("height", 0.5).alias("height"))
    # a video's pieces: a few people's
    chains = pieces.groupBy("video_id").applyInPandas(lambda pieces: chain_pieces(pieces), "video_id string, start double, end double, x0 double, y0 double, x1 double, y1 double, height double, tids array<bigint>")
    travel = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / F.greatest("height", F.lit(1.0))
    return events(chains.where((F.col("end") - F.col("start") >= least_seconds) & (travel >= least_travel)), "jaywalking", F.col("tids"))
