"""Figures of whole videos for boards and final scores: counts by second, density, thinning, repairs of results, the alarm score."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators import evaluation as V

#: Shares of average precision, alarm F1 and warning time in the alarm score, and the seconds of warning that count in full (fixed values).
AP_SHARE, F1_SHARE, WARNING_SHARE, LEAD = 0.4, 0.4, 0.2, 10.0
#: Shares of the event score and the alarm score in the final one (fixed values).
EVENT_SHARE, ALARM_SHARE = 0.7, 0.3


def counts_per_second(obs: DataFrame, videos: DataFrame, kinds: list[str], tolerance: float = 0.1) -> DataFrame:
    """Tracks of each kind that are there at 0, 1, ... seconds of each video, as columns; seconds without tracks have zeros.

    Tracks are spread over the seconds that they last, so a video's tracks never meet all its seconds.
    """
    last = F.ceil(F.greatest(F.col("duration").cast("double"), F.lit(1.0))).cast("bigint") - 1
    spine = videos.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("second"))
    spans = obs.groupBy("video_id", "tid").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.min("kind").alias("kind"))
    spans = spans.withColumn("a", F.greatest(F.ceil(F.col("s") - tolerance - 1e-9), F.lit(0))).withColumn("b", F.floor(F.col("e") + tolerance + 1e-9)).where("a <= b")
    seen = spans.select("video_id", "kind", F.explode(F.sequence("a", "b")).alias("second")).groupBy("video_id", "second").pivot("kind", kinds).agg(F.count(F.lit(1)))
    return spine.join(seen, ["video_id", "second"], "left").select("video_id", "second", *[F.coalesce(F.col(k), F.lit(0)).cast("bigint").alias(k) for k in kinds])


def track_totals(obs: DataFrame) -> DataFrame:
    """Tracks of each kind over all videos."""
    return obs.select("video_id", "tid", "kind").distinct().groupBy("kind").agg(F.count("*").alias("n"))


def heatmap(obs: DataFrame, x: str, y: str, keys: list[str], cell: float = 4.0) -> DataFrame:
    """Samples in each square of `cell` pixels, and the logarithm that a picture shows."""
    at = [F.floor(F.col(c) / cell).cast("bigint").alias(n) for c, n in ((x, "cx"), (y, "cy"))]
    return obs.select(*keys, *at).groupBy(*keys, "cx", "cy").agg(F.count("*").alias("n")).withColumn("heat", F.log1p("n"))


def brightness(pixels: DataFrame, keys: list[str], frame: str, gray: str) -> DataFrame:
    """The median over frames of the frames' mean."""
    return pixels.groupBy(*keys, frame).agg(F.avg(gray).alias("v")).groupBy(*keys).agg(F.percentile("v", 0.5).alias("brightness"), F.count("*").alias("frames"))


def every(rows: Iterator[pd.DataFrame], keys: list[str], time: str, step: float) -> Iterator[pd.DataFrame]:
    """Rows at least `step` after the last one that was kept, of rows that come by key and time."""
    at, due = None, 0
    for part in rows:
        kept = []
        for n, (t, *key) in enumerate(zip(*(part[c].tolist() for c in (time, *keys)), strict=True)):
            if key != at or t >= due:
                at, due = key, t + step
                kept.append(n)
        yield part.iloc[kept]


def thinned(df: DataFrame, keys: list[str], time: str, step: float, *ties: str) -> DataFrame:
    """Greedy thinning: each key's first row, and then each first row `step` or more after the last kept one. Rows stream; no group is held."""
    return df.repartition(*keys).sortWithinPartitions(*keys, time, *ties).mapInPandas(lambda x: every(x, keys, time, step), df.schema)


def finite(value: Column) -> Column:
    """The number, or 0 if it is none or not finite."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def sanitised(events: DataFrame) -> DataFrame:
    """start, end, label and score made fit to show: finite times in order, labels of up to 40 characters, scores from 0 to 1. A null label is empty."""
    s, e = finite(F.col("start")), finite(F.col("end"))
    return events.withColumns({"start": F.least(s, e), "end": F.greatest(s, e), "label": F.coalesce(F.substring(F.col("label").cast("string"), 1, 40), F.lit("")), "score": F.least(F.greatest(finite(F.col("score")), F.lit(0.0)), F.lit(1.0))})


def coerced(raw: DataFrame, videos: DataFrame, labels: list[str]) -> DataFrame:
    """Raw events as valid predictions: numbers, known labels, times within the video, none that overlaps an earlier one of its label."""
    own = raw.withColumns({"start": F.col("start").try_cast("double"), "end": F.col("end").try_cast("double")}).join(videos.select("video_id", "duration"), "video_id")
    own = own.withColumn("end", F.when(F.col("end") > F.col("duration"), F.col("duration").cast("double")).otherwise(F.col("end"))).drop("duration")
    fit = F.col("label").isin(labels) & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & ~F.isnan("end")
    return V.drop_overlaps(own.where(fit).withColumns({"start": F.round("start", 3), "end": F.round("end", 3)}))


def within_budget(rows: DataFrame, videos: DataFrame, factor: float = 3.0) -> DataFrame:
    """Without the rows of videos whose processing took more than `factor` times their duration."""
    return rows.join(videos.where(F.col("seconds_taken") > factor * F.col("duration")).select("video_id"), "video_id", "left_anti")


def video_tiles(events: DataFrame, durations: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's number of events, events an hour and most frequent label (of equally frequent ones the first)."""
    kinds = events.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    top = kinds.groupBy(*keys).agg(F.sum("n").alias("n"), F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("top_label"))
    per_hour = F.coalesce(F.try_divide(F.col("n") * 3600.0, F.col("duration")), F.lit(0.0))
    return durations.join(top, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).select(*keys, "duration", "n", per_hour.alias("per_hour"), "top_label")


def alarm_score(curve: DataFrame, truth: DataFrame, level: float = 0.5, gap: float = 2.0) -> DataFrame:
    """One row: ap (chance-corrected), alarm precision, recall and F1, mean warning time and the score of them; score is null without accidents."""
    labelled = V.frame_labels(curve, truth).where("y is not null").withColumn("positive", F.col("y") == 1)
    ap = V.average_precision(labelled.withColumn("_one", F.lit(1)), ["_one"], "score", "positive").select(V.chance_corrected(F.col("ap"), F.col("positives") / F.col("n")).alias("ap"))
    starts = V.alarms(curve, level, gap).select("video_id", F.col("start").alias("t"), F.lit(0.0).alias("score"))
    found = V.frame_labels(starts, truth).where("y is not null").select("video_id", F.col("t").alias("start"))
    matched = V.alarm_matches(truth, found).where("accident is not null").agg(F.count("*").alias("accidents"), F.count("alarm").alias("matched"), F.sum(F.col("accident") - F.col("alarm")).alias("warned"))
    one = matched.join(F.broadcast(found.agg(F.count("*").alias("alarms"))), how="left").join(F.broadcast(ap), how="left")  # single rows
    p, r, f = V.f1(F.col("matched"), F.col("alarms") - F.col("matched"), F.col("accidents") - F.col("matched"))
    warned = F.coalesce(F.try_divide(F.col("warned"), F.col("accidents")), F.lit(0.0))
    one = one.select("accidents", "alarms", "matched", F.coalesce("ap", F.lit(0.0)).alias("ap"), p.alias("precision"), r.alias("recall"), f.alias("f1"), warned.alias("mean_warning"))
    return one.withColumn("score", F.when(F.col("accidents") > 0, AP_SHARE * F.col("ap") + F1_SHARE * F.col("f1") + WARNING_SHARE * F.least(F.lit(1.0), F.col("mean_warning") / LEAD)))


def final_score(event_score: Column, alarm: Column) -> Column:
    """Both scores; the event score alone where there are no accidents."""
    return F.when(alarm.isNull(), event_score).otherwise(EVENT_SHARE * event_score + ALARM_SHARE * alarm)
