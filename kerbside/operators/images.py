"""Detectors judged by image: recall of images with a class, false alarms by confidence and area, counts of a data set.

All thresholds are answered from one pass: an image's best confidence falls between two thresholds, and counts of such images
are summed from the top. No image meets the list of thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Confidences and areas (shares of the picture) that are judged, and runs of samples that make an alarm (fixed values).
CONFIDENCES, AREAS, LASTING = (0.25, 0.4, 0.5, 0.6), (0.0, 0.001, 0.005), (2, 3)


def reached(value: Column, steps: Sequence[float]) -> Column:
    """How many of the rising steps the value reaches; 0 for null."""
    out = F.lit(0)
    for i, step in enumerate(steps):
        out = F.when(value >= step, i + 1).otherwise(out)
    return out


def cumulated(counts: DataFrame, keys: Sequence[str], steps: Sequence[float]) -> DataFrame:
    """From counts (keys, level, n) one row for each key and step: the images that reach it. A key has len(steps) + 1 levels at most."""
    named = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("confidence"), F.lit(i + 1).alias("step")) for i, s in enumerate(steps)]))
    by_level = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("m"))
    rows = by_level.select(*keys, "m", named.alias("s")).select(*keys, "m", "s.*")
    above = F.aggregate(F.sequence("step", F.lit(len(steps))), F.lit(0).cast("bigint"), lambda total, k: total + F.coalesce(F.col("m")[k], F.lit(0)))
    return rows.select(*keys, "confidence", above.alias("images"))


def image_recall(truth: DataFrame, detections: DataFrame, confidences: Sequence[float] = CONFIDENCES) -> DataFrame:
    """cls, confidence, n (images that have the class) and images (of them, those with a detection of it of that confidence)."""
    best = detections.groupBy("image_id", "cls").agg(F.max("conf").alias("best"))
    images = truth.select("image_id", "cls").distinct().join(best, ["image_id", "cls"], "left")
    counts = images.groupBy("cls", reached(F.col("best"), confidences).alias("level")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("cls").agg(F.sum("n").alias("n"))
    return cumulated(counts, ["cls"], confidences).join(totals, "cls").select("cls", "confidence", "n", "images")


def best_by_area(frames: DataFrame, detections: DataFrame, areas: Sequence[float], most: float) -> DataFrame:
    """video_id, frame, and for each least area the frame's best confidence (null: none): a column for each area, in one aggregate."""
    best = detections.where(F.col("area") <= most).groupBy("video_id", "frame").agg(*[F.max(F.when(F.col("area") >= a, F.col("conf"))).alias(f"best{i}") for i, a in enumerate(areas)])
    return frames.select("video_id", "frame").join(best, ["video_id", "frame"], "left")


def false_alarms(frames: DataFrame, detections: DataFrame, confidences: Sequence[float] = CONFIDENCES, areas: Sequence[float] = AREAS, most: float = float("inf")) -> DataFrame:
    """video_id, area, confidence, frames (all of them) and images: frames with a detection at least so sure and large (and at most `most`)."""
    best = best_by_area(frames, detections, areas, most)
    each = best.select("video_id", F.inline(F.array(*[F.struct(F.lit(float(a)).alias("area"), F.col(f"best{i}").alias("best")) for i, a in enumerate(areas)])))
    counts = each.groupBy("video_id", "area", reached(F.col("best"), confidences).alias("level")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("video_id", "area").agg(F.sum("n").alias("frames"))
    return cumulated(counts, ["video_id", "area"], confidences).join(totals, ["video_id", "area"]).select("video_id", "area", "confidence", "frames", "images")


def alarm_runs(frames: DataFrame, detections: DataFrame, confidences: Sequence[float] = CONFIDENCES, lasting: Sequence[int] = LASTING, area: float = 0.001, most: float = float("inf")) -> DataFrame:
    """video_id, confidence, lasting and alarms: runs of successive frames with a detection that become so long. Only what occurs has rows.

    frame: successive whole numbers in a video. A frame counts for each confidence that it reaches, and for no other.
    """
    best = best_by_area(frames, detections, [area], most)
    hits = best.select("video_id", "frame", F.explode(F.slice(F.array(*[F.lit(float(c)) for c in confidences]), F.lit(1), reached(F.col("best0"), confidences))).alias("confidence"))
    run = F.col("frame") - F.row_number().over(Window.partitionBy("video_id", "confidence").orderBy("frame"))
    runs = hits.withColumn("_run", run).groupBy("video_id", "confidence", "_run").agg(F.count("*").alias("n"))
    each = runs.select("video_id", "confidence", "n", F.explode(F.array(*[F.lit(k) for k in lasting])).alias("lasting")).where(F.col("n") >= F.col("lasting"))
    return each.groupBy("video_id", "confidence", "lasting").agg(F.count("*").alias("alarms"))


def dataset_statistics(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """split, kind (images, negatives, or a box's class) and n."""
    counts = images.join(boxes.select("image_id").distinct().withColumn("_any", F.lit(1)), "image_id", "left").groupBy("split").agg(F.count("*").alias("images"), F.count_if(F.col("_any").isNull()).alias("negatives"))
    kinds = counts.select("split", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("images", "negatives")])))
    return kinds.unionByName(boxes.join(images.select("image_id", "split"), "image_id").groupBy("split", F.col("cls").cast("string").alias("kind")).agg(F.count("*").alias("n")))


def held_out(name: Column, seed: int, share: float = 0.1) -> Column:
    """Whether an image is held out: a share of all that the names' hashes fix, so that no list of names is drawn anywhere."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), name).cast("binary")), 1, 8), 16, 10).cast("double") < share * 4294967296.0
