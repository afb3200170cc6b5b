"""What a drawn video shows: the tracks that are there at a frame with their recent way, and the events as bars of a strip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.operators.temporal import stab_join

#: Seconds of a drawn way, and how far a track may be from a frame to be there and to be drawn (fixed values).
TRAIL, THERE, DRAWN = 2.0, 0.15, 0.2
#: Pixels of a strip, of its edge and of the lowest lane (fixed values).
STRIP, EDGE, LANE = 46, 3, 4


def drawn_tracks(frames: DataFrame, obs: DataFrame, scale: float = 1.0) -> DataFrame:
    """For each frame (video_id, t) and track that is there: tid, kind, its nearest box and its way over the last TRAIL seconds, in whole pixels.

    Frames are dealt to tracks by the tracks' spans; then a track's frames stand among its observations, and windows look at
    the neighbours and back over the trail. No observation meets another by a join.
    """
    spans = obs.groupBy("video_id", "tid").agg(F.min("t").alias("_from"), F.max("t").alias("_to"), F.min("kind").alias("kind"))
    spans = spans.withColumn("_from", F.col("_from") - THERE).withColumn("_to", F.col("_to") + THERE)
    probes = stab_join(frames.select("video_id", "t").distinct(), spans, ["video_id"], "t", ("_from", "_to"), 10.0)
    box = F.struct(F.col("t"), *[(F.col(c) * scale).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    point = F.struct((F.col("x") * scale).cast("int").alias("x"), (F.col("y") * scale).cast("int").alias("y"))
    seen = obs.select("video_id", "tid", "t", F.lit(False).alias("_probe"), F.lit(None).cast("string").alias("kind"), box.alias("_box"), point.alias("_point"))
    asked = probes.select("video_id", "tid", "t", F.lit(True).alias("_probe"), "kind", F.lit(None).cast(seen.schema["_box"].dataType).alias("_box"), F.lit(None).cast(seen.schema["_point"].dataType).alias("_point"))
    rows = seen.union(asked).withColumn("_us", F.round(F.col("t") * 1_000_000).cast("bigint"))
    own = Window.partitionBy("video_id", "tid")
    past, next_ = own.orderBy("_us", "_probe").rowsBetween(Window.unboundedPreceding, 0), own.orderBy("_us", F.col("_probe").desc()).rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_before", F.last("_box", ignorenulls=True).over(past)).withColumn("_after", F.first("_box", ignorenulls=True).over(next_))
    # collect_list leaves out the frames' own nulls; a trail is a few seconds of one track
    rows = rows.withColumn("trail", F.collect_list("_point").over(own.orderBy("_us").rangeBetween(-round(TRAIL * 1_000_000), 0))).where("_probe")
    before, after = F.col("_before"), F.col("_after")
    nearest = F.when(before.isNull(), after).when(after.isNull(), before).when(F.col("t") - before["t"] <= after["t"] - F.col("t"), before).otherwise(after)
    near = rows.withColumn("_n", nearest).where(F.abs(F.col("_n.t") - F.col("t")) <= DRAWN)
    return near.select("video_id", "t", "tid", "kind", *[F.col(f"_n.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], F.when(F.size("trail") > 1, F.col("trail")).otherwise(F.array().cast(rows.schema["trail"].dataType)).alias("trail"))


def strip(events: DataFrame, videos: DataFrame, width: int = 1280, height: int = STRIP) -> DataFrame:
    """A bar (x1, y1, x2, y2) for each event: a lane for each of the video's labels in their order, at least two pixels wide."""
    own = Window.partitionBy("video_id")
    rows = events.join(videos.select("video_id", "duration"), "video_id").withColumn("_lane", F.dense_rank().over(own.orderBy("label")) - 1)
    rows = rows.withColumn("_tall", F.greatest(F.lit(LANE), F.floor(F.lit(height - 2 * EDGE) / (F.max("_lane").over(own) + 1)))).withColumn("x1", (F.col("start") / F.col("duration") * width).cast("int"))
    y1 = EDGE + F.col("_lane") * F.col("_tall")
    return rows.select("video_id", "label", "start", "end", "x1", y1.cast("int").alias("y1"), F.greatest((F.col("end") / F.col("duration") * width).cast("int"), F.col("x1") + 2).alias("x2"), (y1 + F.col("_tall") - 1).cast("int").alias("y2"))
