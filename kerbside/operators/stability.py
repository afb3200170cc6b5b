"""How events hold when detections are slightly wrong: noise that a row's hash fixes, runs of a whole video, survival of its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geometry import interval_iou
from kerbside.operators.temporal import overlap_join

#: Noise of box edges (share of the box's size) and of confidences, and the least confidence of a detection (fixed values).
EDGE_NOISE, CONFIDENCE_NOISE, LEAST_CONFIDENCE = 0.01, 0.02, 0.25
#: The overlap from which two events are one, and the survival under which an event is fragile (fixed values).
SAME, FRAGILE = 0.3, 0.75


def uniform(key: Column) -> Column:
    """A number over 0 and under 1 that the text `key` fixes."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(key: Column) -> Column:
    """A standard normal number that the text `key` fixes."""
    return F.sqrt(-2 * F.log(uniform(F.concat(key, F.lit("a"))))) * F.cos(2 * 3.141592653589793 * uniform(F.concat(key, F.lit("b"))))


def noisy_runs(detections: DataFrame, runs: int, *row: str, edge: float = EDGE_NOISE, confidence: float = CONFIDENCE_NOISE, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """The detections once as they are (run 0) and `runs` times with noise; `video_id` and `run` are a video of their own.

    row: the columns that tell a video's rows apart; with the run they fix its noise, so a run is the same whenever it is
    made. Detections whose confidence falls under `least` go; a frame without detections (null conf) stays.
    """
    each = detections.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs))))
    key = F.concat_ws("|", "run", "video_id", *row)
    draw = lambda name: F.when(F.col("run") == 0, 0.0).otherwise(normal(F.concat(key, F.lit(name))))
    wide, tall = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    moved = {c: F.col(c) + edge * size * draw(c) for c, size in (("x1", wide), ("y1", tall), ("x2", wide), ("y2", tall))}
    rows = each.withColumns(moved | {"conf": F.col("conf") + confidence * draw("conf")})
    return rows.where(F.col("conf").isNull() | (F.col("conf") >= least))


def survival(events: DataFrame, runs: int, width: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Of all runs' events (video_id, run, label, start, end): the events of run 0 with `survival`, the share of noisy runs with such
    an event, and the events of noisy runs without one in run 0. Both by one join on time buckets of `width` seconds."""
    own = [c for c in ("video_id", "label", "start", "end")]
    base, noisy = events.where("run = 0").select(*own), events.where("run > 0").select(*own, "run")
    other = noisy.select("video_id", "label", "run", F.col("start").alias("s"), F.col("end").alias("e"))
    met = overlap_join(base, other, ["video_id", "label"], ("start", "end"), ("s", "e"), width, interval_iou((F.col("start"), F.col("end")), (F.col("s"), F.col("e"))) >= SAME)
    held = met.groupBy(*own).agg(F.count_distinct("run").alias("n"))
    kept = base.join(held, own, "left").select(*own, (F.coalesce("n", F.lit(0)) / runs).alias("survival"))
    extra = other.join(met.select("video_id", "label", "run", "s", "e").distinct(), ["video_id", "label", "run", "s", "e"], "left_anti")
    return kept, extra.select("video_id", "label", "run", F.col("s").alias("start"), F.col("e").alias("end"))


def stability(events: DataFrame, runs: int) -> DataFrame:
    """label, events (of run 0), mean_survival, fragile (events under FRAGILE) and noise_only (events of noisy runs alone, a run)."""
    kept, extra = survival(events, runs)
    of = kept.groupBy("label").agg(F.count("*").alias("events"), F.avg("survival").alias("mean_survival"), F.count_if(F.col("survival") < FRAGILE).alias("fragile"))
    only = extra.groupBy("label").agg((F.count("*") / runs).alias("noise_only"))
    return of.join(only, "label", "full").na.fill(0)
