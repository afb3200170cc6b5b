"""failure_to_yield: a vehicle passes over a crossing while someone on it is close."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geometry import any_of, inside, polygon
from kerbside.operators.sequences import enter_leave
from kerbside.rules import Context, events, rule
from kerbside.rules.flow import TRACK
from kerbside.rules.pedestrians import walkers


@rule("failure_to_yield")
def failure_to_yield(ctx: Context, least_speed: float = 20.0, near: float = 1.5, lag: tuple[float, float] = (0.4, 0.9)) -> DataFrame:
    parts = []
    for poly in ctx.layout.crossings:
        p = polygon(poly)
        people = walkers(ctx).where(inside(F.col("x"), F.col("y"), p) & ~any_of([inside(F.col("x"), F.col("y"), polygon(r)) for r in ctx.layout.refuges]))
        people = people.select("video_id", F.col("t").alias("pt"), F.col("x").alias("px"), F.col("y").alias("py"))
        middle = (F.col("x1") + F.col("x2")) / 2
        probes = [(F.col("x1"), F.col("y2")), (middle, F.col("y2")), (F.col("x2"), F.col("y2")), (middle, (F.col("y1") + 3 * F.col("y2")) / 4)]
        on = any_of([inside(x, y, p) for x, y in probes]) & (F.col("speed") >= least_speed)
        found = enter_leave(ctx.vehicles.withColumn("_on", on), TRACK, "t", "_on").where((F.col("end") - F.col("start")).between(0.2, 8.0)).select(*TRACK, "start", "end")
        met = found.join(people, "video_id").where(F.col("pt").between(F.col("start"), F.col("end")))
        # the vehicle's observation nearest to the pedestrian's sample
        v = ctx.vehicles.select(*TRACK, "t", "x", "y", "size")
        pairs = met.join(v, TRACK).where(F.abs(F.col("t") - F.col("pt")) <= 1.5)
        nearest = pairs.groupBy(*TRACK, "start", "end", "pt", "px", "py").agg(F.min_by(F.struct("x", "y", "size"), F.struct(F.abs(F.col("t") - F.col("pt")), F.col("t"))).alias("v"))
        close = nearest.where(F.hypot(F.col("v.x") - F.col("px"), F.col("v.y") - F.col("py")) < near * F.col("v.size")).select(*TRACK, "start", "end").distinct()
        ended = close.join(ctx.videos.select("video_id", "duration"), "video_id")
        parts.append(ended.select(*TRACK, (F.col("start") + lag[0]).alias("start"), F.least(F.col("end") + lag[1], "duration").alias("end")))
    return events(reduce(DataFrame.unionByName, parts), "failure_to_yield") if parts else ctx.empty()
