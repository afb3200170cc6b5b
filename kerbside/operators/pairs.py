"""Pairs of tracks: which come near each other, their aligned samples, and the measures of a conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.functions.geometry import iou
from kerbside.operators.temporal import overlap_join

PAIR = ["video_id", "a", "b"]
VALUES = ("x", "y", "vx", "vy", "size", "x1", "y1", "x2", "y2", "is_vehicle")


def candidate_pairs(obs: DataFrame, reach: float = 4.0, bucket_seconds: float = 5.0, least_overlap: float = 0.5) -> DataFrame:
    """Pairs (video_id, a, b) of tracks whose spans overlap and whose bounding boxes are within `reach` sizes; a starts first (or has the smaller id)."""
    spans = obs.groupBy("video_id", "tid").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.min("x").alias("l"), F.max("x").alias("r"), F.min("y").alias("u"), F.max("y").alias("d"), F.max("size").alias("z"))
    one, two = (spans.select("video_id", *[F.col(c).alias(f"{c}{k}") for c in ("tid", "s", "e", "l", "r", "u", "d", "z")]) for k in "01")
    order = (F.col("s0") < F.col("s1")) | ((F.col("s0") == F.col("s1")) & (F.col("tid0") < F.col("tid1")))
    gap = lambda lo, hi: F.greatest(F.lit(0.0), F.col(f"{lo}1") - F.col(f"{hi}0"), F.col(f"{lo}0") - F.col(f"{hi}1"))
    near = F.hypot(gap("l", "r"), gap("u", "d")) <= reach * F.greatest("z0", "z1")
    joined = overlap_join(one, two, ["video_id"], ("s0", "e0"), ("s1", "e1"), bucket_seconds, order & (F.col("s1") <= F.col("e0") - least_overlap) & near)
    return joined.select("video_id", F.col("tid0").alias("a"), F.col("tid1").alias("b"))


def pair_series(obs: DataFrame, pairs: DataFrame, tolerance: float = 0.15, least: int = 3, reach: float = 4.0) -> DataFrame:
    """Aligned samples of each pair: a's samples with b's nearest (under `tolerance` away), distance and closing speed in sizes, and IoU.

    Pairs with fewer than `least` samples, or that never come within `reach`, are left out.
    """
    side = lambda k: obs.select("video_id", F.col("tid").alias(k), F.col("t").alias(f"t_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in VALUES])
    # times alone are matched, each of a's with b's last up to it and first after it; the values join what is left
    times = lambda k: obs.select("video_id", F.col("tid").alias(k), F.col("t").alias(f"t_{k}"))
    # only a's samples in the common span count; a starts first
    span = obs.groupBy("video_id", F.col("tid").alias("b")).agg(F.min("t").alias("_from"), F.max("t").alias("_to"))
    a = pairs.join(times("a"), ["video_id", "a"]).join(span, ["video_id", "b"]).where(F.col("t_a").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
    slot = lambda t: F.floor(F.col(t) / tolerance)
    b = times("b").withColumn("slot", F.explode(F.array(*[slot("t_b") + d for d in (-1, 0, 1)]))).hint("merge")  # Spark's estimate leaves exploded rows uncounted
    met = a.withColumn("slot", slot("t_a")).join(b, ["video_id", "b", "slot"]).where(F.abs(F.col("t_a") - F.col("t_b")) < tolerance)
    around = met.groupBy(*PAIR, "t_a").agg(F.max(F.when(F.col("t_b") <= F.col("t_a"), F.col("t_b"))).alias("_before"), F.min(F.when(F.col("t_b") > F.col("t_a"), F.col("t_b"))).alias("_after"))
    earlier = F.col("_after").isNull() | (F.col("t_a") - F.col("_before") <= F.col("_after") - F.col("t_a"))
    best = around.select(*PAIR, "t_a", F.when(earlier, F.col("_before")).otherwise(F.col("_after")).alias("t_b"))
    best = best.join(side("a").distinct(), ["video_id", "a", "t_a"]).join(side("b").dropDuplicates(["video_id", "b", "t_b"]), ["video_id", "b", "t_b"])
    rows = best.select(*PAIR, F.col("t_a").alias("t"), *[f"{c}_a" for c in VALUES], "t_b", *[f"{c}_b" for c in VALUES])
    dx, dy = F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a")
    distance, scale = F.hypot(dx, dy), F.greatest(0.5 * (F.col("size_a") + F.col("size_b")), F.lit(1.0))
    closing = -(dx * (F.col("vx_b") - F.col("vx_a")) + dy * (F.col("vy_b") - F.col("vy_a"))) / F.greatest(distance, F.lit(1e-6))
    rows = rows.withColumn("dist_rel", distance / scale).withColumn("closing_rel", closing / scale).withColumn("iou", iou(*[[F.col(f"{c}_{k}").cast("double") for c in ("x1", "y1", "x2", "y2")] for k in "ab"]))
    own = Window.partitionBy(*PAIR)
    return rows.withColumn("_n", F.count("*").over(own)).withColumn("_least", F.min("dist_rel").over(own)).where((F.col("_n") >= least) & (F.col("_least") < reach)).drop("_n", "_least")


def hazard(p: dict[str, Column], most_seconds: float = 3.0, most_miss: float = 0.6, least_closing: float = 0.5) -> Column:
    """Deceleration needed to avoid a crash, in sizes/s2, less for wide misses. p: x, y, vx, vy, size of both sides (x1 ... size2)."""
    dx, dy, dvx, dvy = p["x2"] - p["x1"], p["y2"] - p["y1"], p["vx2"] - p["vx1"], p["vy2"] - p["vy1"]
    dv2, scale, distance = dvx * dvx + dvy * dvy, 0.5 * (p["size1"] + p["size2"]), F.hypot(dx, dy)
    closing = -(dx * dvx + dy * dvy) / (distance + 1e-6) / scale
    at = F.try_divide(-(dx * dvx + dy * dvy), dv2)
    miss = F.hypot(dx + dvx * at, dy + dvy * at) / scale
    need = closing * closing / (2 * F.greatest(distance / scale - 1, F.lit(0.25))) * (1 - (miss / most_miss) * (miss / most_miss))
    hit = (dv2 >= 1e-6) & (closing >= least_closing) & (at > 0) & (at < most_seconds) & (miss < most_miss)
    return F.when(hit, need).otherwise(0.0)


def time_to_collision(distance: Column, closing: Column, least_closing: float = 1.5) -> Column:
    return F.when(closing > least_closing, distance / F.greatest(closing, F.lit(1e-6))).otherwise(F.lit(float("inf")))


def paths_meet(most_seconds: float = 1.2, most_miss: float = 0.6) -> Column:
    """On rows of pair_series: whether straight on from here the two come within `most_miss` sizes soon."""
    dx, dy, dvx, dvy = (F.col(f"{c}_b") - F.col(f"{c}_a") for c in ("x", "y", "vx", "vy"))
    dv2 = dvx * dvx + dvy * dvy
    at = F.least(F.greatest(F.coalesce(F.try_divide(-(dx * dvx + dy * dvy), dv2), F.lit(0.0)), F.lit(0.0)), F.lit(most_seconds))
    scale = F.greatest(0.5 * (F.col("size_a") + F.col("size_b")), F.lit(1.0))
    return (dv2 >= 1e-6) & (F.hypot(dx + dvx * at, dy + dvy * at) / scale < most_miss)
