"""From boxes to observations: ground points, local fits, speeds.

Tracks are keyed by (video_id, tid); time is in integer microseconds (t_us), so that window frames are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Detector classes by kind, and the kinds that are vehicles (fixed values).
KINDS = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck", 15: "animal", 16: "animal", 17: "animal", 18: "animal", 19: "animal"}
VEHICLES = ("car", "motorcycle", "bus", "truck", "bicycle")
TRACK = ("video_id", "tid")
LEAST_OBSERVATIONS = 5
#: Half the width of the local fit, in microseconds: 0.3 s and a margin for times that are rounded.
HALF_WIDTH_US = 300_001


def kind_of(cls: Column) -> Column:
    out = F.lit("other")
    for c, kind in KINDS.items():
        out = F.when(cls == c, kind).otherwise(out)
    return out


def majority_class(detections: DataFrame) -> DataFrame:
    """Each track's most frequent class; of equally frequent ones the first seen."""
    by_class = detections.groupBy(*TRACK, "cls").agg(F.count("*").alias("n"), F.min("t_us").alias("first"))
    return by_class.groupBy(*TRACK).agg(F.max_by("cls", F.struct("n", -F.col("first"), -F.col("cls"))).alias("cls"))


def ground(df: DataFrame) -> DataFrame:
    """Adds the ground point (gx, gy: the middle of the box's lower edge) and the size (its diagonal)."""
    return df.withColumn("gx", (F.col("x1") + F.col("x2")) / 2).withColumn("gy", F.col("y2").cast("double")).withColumn("size", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))


def observations(boxes: DataFrame, half_width_us: int = HALF_WIDTH_US) -> DataFrame:
    """Adds to boxes (video_id, tid, kind, t_us, x1, y1, x2, y2) the smoothed point, velocity, speed and sizes.

    Position and velocity are a least-squares line over a centred window, at the sample's time. Tracks of two samples
    have their points and the slope between them, single samples stand still. n_obs counts the track's samples.
    """
    track = Window.partitionBy(*TRACK)
    near = track.orderBy("t_us").rangeBetween(-half_width_us, half_width_us)
    t = F.col("t_us") / 1_000_000
    rows = ground(boxes).withColumn("t", t).withColumn("n_obs", F.count("*").over(track))
    # sums about the sample's own track start keep the numbers small
    origin = F.min("t_us").over(track)
    rows = rows.withColumn("_t", (F.col("t_us") - origin) / 1_000_000)
    mean_t, n = F.avg("_t").over(near), F.count("*").over(near)
    spread = F.sum(F.col("_t") * F.col("_t")).over(near) - n * mean_t * mean_t
    for axis in "xy":
        g = F.col(f"g{axis}")
        mean = F.avg(g).over(near)
        slope = F.when(spread > 1e-9, F.try_divide(F.sum(F.col("_t") * g).over(near) - n * mean_t * mean, spread)).otherwise(0.0)
        rows = rows.withColumn(f"_v{axis}", slope).withColumn(f"_p{axis}", mean + slope * (F.col("_t") - mean_t))
        ends = F.try_divide(F.last(g).over(track.orderBy("t_us").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.first(g).over(track.orderBy("t_us").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), (F.max("t_us").over(track) - origin) / 1_000_000)
        rows = rows.withColumn(axis, F.when(F.col("n_obs") < 3, g).otherwise(F.col(f"_p{axis}"))).withColumn(f"v{axis}", F.when(F.col("n_obs") < 3, F.coalesce(ends, F.lit(0.0))).otherwise(F.col(f"_v{axis}")))
    rows = rows.withColumn("speed", F.hypot("vx", "vy")).withColumn("rel_speed", F.col("speed") / F.greatest("size", F.lit(1.0)))
    return rows.withColumn("is_vehicle", F.col("kind").isin(*VEHICLES)).drop("_t", "_vx", "_vy", "_px", "_py")


def usable(obs: DataFrame, least: int = LEAST_OBSERVATIONS) -> DataFrame:
    return obs.where(F.col("n_obs") >= least)


def causal_fit(obs: DataFrame, seconds: float = 1.0, least: int = 4) -> DataFrame:
    """Adds fx, fy, fvx, fvy, fsize from the last `seconds` only: a line at the newest time and the median size; null before `least` samples."""
    own = Window.partitionBy(*TRACK).orderBy("t_us").rangeBetween(-round(seconds * 1_000_000), 0)
    t = F.col("t_us") / 1_000_000
    enough = F.count("*").over(own) >= least
    rows = obs
    for axis in "xy":
        slope = F.coalesce(F.regr_slope(f"g{axis}", t).over(own), F.lit(0.0))
        rows = rows.withColumn(f"fv{axis}", F.when(enough, slope)).withColumn(f"f{axis}", F.when(enough, F.avg(f"g{axis}").over(own) + slope * (t - F.avg(t).over(own))))
    return rows.withColumn("fsize", F.when(enough, F.percentile("size", F.lit(0.5)).over(own)))


def heading_bin(vx: Column, vy: Column) -> Column:
    """One of eight directions; bin 0 is centred on +x."""
    return F.pmod(F.floor(F.pmod(F.atan2(vy, vx), F.lit(2 * 3.141592653589793)) / (3.141592653589793 / 4) + 0.5), F.lit(8)).cast("int")


def heading_change(vx0: Column, vy0: Column, vx1: Column, vy1: Column) -> Column:
    d = F.atan2(vy1, vx1) - F.atan2(vy0, vx0)
    return F.abs(F.atan2(F.sin(d), F.cos(d)))
