"""JSON documents of ground truth and predictions, and text labels, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIDEO = "struct<duration:double, fps:double, events:array<array<string>>, risk:array<array<double>>>"


def _videos(spark: SparkSession, path: str, inner: str | None) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    kind = f"map<string, {VIDEO}>"
    parsed = F.from_json("value", f"struct<{inner}: {kind}>")[inner] if inner else F.from_json("value", kind)
    return text.select(F.explode(parsed).alias("video_id", "v")).select("video_id", "v.*")


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Videos (video_id, duration, fps) and events (video_id, ord, start, end, label) of {video: {duration, fps, events}}."""
    videos = _videos(spark, path, None)
    return videos.select("video_id", "duration", "fps"), _events(videos)


def read_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events and risk samples (video_id, ord, t, score) of {"videos": {video: {events, risk}}}."""
    videos = _videos(spark, path, "videos")
    risk = videos.select("video_id", F.posexplode("risk").alias("ord", "r")).select("video_id", "ord", F.col("r")[0].alias("t"), F.col("r")[1].alias("score"))
    return _events(videos), risk


def _events(videos: DataFrame) -> DataFrame:
    rows = videos.select("video_id", F.posexplode("events").alias("ord", "e"))
    return rows.select("video_id", "ord", F.col("e")[0].try_cast("double").alias("start"), F.col("e")[1].try_cast("double").alias("end"), F.col("e")[2].alias("label"))


def predictions_document(events: DataFrame, risk: DataFrame, team: str) -> DataFrame:
    """One row `value`: the document of a team's predictions, events to 3 places and risk to 4."""
    e = events.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(F.round("start", 3).alias("s"), F.round("end", 3).alias("e"), "label"))).alias("events"))  # one video's events
    r = risk.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("t", F.round("score", 4).alias("score")))).alias("risk"))
    body = F.struct(F.transform("events", lambda x: F.array(x["s"].cast("string"), x["e"].cast("string"), x["label"])).alias("events"), F.transform("risk", lambda x: F.array(x["t"], x["score"])).alias("risk"))
    return e.join(r, "video_id", "full").select(F.to_json(F.struct(F.lit(team).alias("team"), F.create_map("video_id", body).alias("videos"))).alias("value"))


def clean_label(text: Column) -> Column:
    """Boxes of a label text, one a line (class, centre x, y, width, height in shares): clamped to [0, 1]; empty ones go."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    numbers = F.transform(lines, lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda n: n.try_cast("double")))
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.filter(F.transform(numbers, lambda n: F.struct(n[0].cast("int").alias("cls"), *[clamp(n[i + 1]).alias(c) for i, c in enumerate(("x", "y", "w", "h"))])), lambda b: (b["w"] > 0) & (b["h"] > 0))
