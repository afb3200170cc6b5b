"""Scores of predicted events and risk curves against ground truth.

Events: (video_id, ord, start, end, label). Candidate pairs come from an interval join; the greedy one-to-one match is
one pass over rows sorted by video and label, so no group is held as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.functions.geometry import interval_iou
from kerbside.operators.temporal import overlap_join

KEYS = ["video_id", "label"]
THRESHOLDS = (0.3, 0.5, 0.7)


def f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 for a zero denominator."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def match_pairs(truth: DataFrame, predicted: DataFrame, keys: list[str], width: float = 60.0) -> DataFrame:
    """Pairs of overlapping events with their IoU. width: of a time bucket, about an event's length."""
    a = truth.select(*keys, F.col("ord").alias("i"), F.col("start").alias("s0"), F.col("end").alias("e0"))
    b = predicted.select(*keys, F.col("ord").alias("j"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    joined = overlap_join(a, b, keys, ("s0", "e0"), ("s1", "e1"), width, (F.col("s0") < F.col("e1")) & (F.col("s1") < F.col("e0")))
    return joined.withColumn("iou", interval_iou((F.col("s0"), F.col("e0")), (F.col("s1"), F.col("e1")))).select(*keys, "i", "j", "iou")


def greedy(pairs: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """One-to-one pairs of each key, of rows that come by key with the largest IoU first."""
    at, used_i, used_j = None, set(), set()
    for part in pairs:
        kept = []
        for n, (i, j, *key) in enumerate(zip(*(part[c].tolist() for c in ("i", "j", *keys)), strict=True)):
            if key != at:
                at, used_i, used_j = key, set(), set()
            if i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                kept.append(n)
        yield part.iloc[kept]


def matches(truth: DataFrame, predicted: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Pairs matched one to one, the largest IoU first; of equal ones the larger indices."""
    pairs = match_pairs(truth, predicted, keys).where(F.col("iou") >= threshold)
    return pairs.repartition(*keys).sortWithinPartitions(*keys, F.desc("iou"), F.desc("i"), F.desc("j")).mapInPandas(lambda x: greedy(x, keys), pairs.schema)


def event_scores(truth: DataFrame, predicted: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 per label and threshold, and over all labels (label null): one pass of grouping sets."""
    n_truth, n_predicted = (x.groupBy("label").agg(F.count("*").alias(n)) for x, n in ((truth, "nt"), (predicted, "np")))
    labels = n_truth.join(n_predicted, "label", "full").select("label", F.coalesce("nt", F.lit(0)).alias("nt"), F.coalesce("np", F.lit(0)).alias("np"))
    labels = labels.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hits = None
    for threshold in thresholds:
        found = matches(truth, predicted, threshold, KEYS).groupBy("label").agg(F.count("*").alias("tp")).withColumn("threshold", F.lit(threshold))
        hits = found if hits is None else hits.unionByName(found)
    counts = labels.join(hits, ["label", "threshold"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    pooled = counts.groupingSets([["label", "threshold"], ["threshold"]], "label", "threshold").agg(F.sum("tp").alias("tp"), F.sum(F.col("np") - F.col("tp")).alias("fp"), F.sum(F.col("nt") - F.col("tp")).alias("fn"))
    p, r, f = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return pooled.withColumns({"precision": p, "recall": r, "f1": f})


def macro_f1(scores: DataFrame) -> DataFrame:
    """The mean over labels of the mean over thresholds."""
    return scores.where("label is not null").groupBy("label").agg(F.avg("f1").alias("f1")).agg(F.avg("f1").alias("score"))


def average_precision(samples: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Average precision per key: equal scores are one step."""
    steps = samples.groupBy(*keys, score).agg(F.sum(F.col(positive).cast("bigint")).alias("tp"), F.count("*").alias("n"))
    own = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    steps = steps.withColumn("precision", F.sum("tp").over(own) / F.sum("n").over(own)).withColumn("positives", F.sum("tp").over(whole))
    gain = F.try_divide(F.col("tp").cast("double"), F.col("positives"))
    return steps.groupBy(*keys).agg(F.sum(F.coalesce(gain * F.col("precision"), F.lit(0.0))).alias("ap"), F.max("positives").alias("positives"), F.sum("n").alias("n"))


def chance_corrected(ap: Column, rate: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(ap - rate, 1 - rate), F.lit(0.0)))


def frame_labels(curve: DataFrame, truth: DataFrame, lead: float = 5.0) -> DataFrame:
    """Risk samples with y: null in an accident, 1 in the seconds before one, null around a near miss, else 0 - in this order."""
    t = F.col("t")
    near = truth.where(F.col("label").isin("accident", "near_miss")).select("video_id", "label", "start", "end")
    met = curve.join(near, "video_id", "left")
    is_accident = F.coalesce(F.col("label") == "accident", F.lit(False))
    during = is_accident & t.between(F.col("start"), F.col("end"))
    before = is_accident & (t >= F.col("start") - lead) & (t < F.col("start"))
    spared = F.coalesce(F.col("label") == "near_miss", F.lit(False)) & t.between(F.col("start") - lead, F.col("end"))
    flags = met.groupBy("video_id", "t", "score").agg(F.bool_or(during).alias("a"), F.bool_or(before).alias("b"), F.bool_or(spared).alias("c"))
    return flags.select("video_id", "t", "score", F.when(F.col("a"), None).when(F.col("b"), 1).when(F.col("c"), None).otherwise(0).alias("y"))


def alarms(curve: DataFrame, level: float = 0.5, gap: float = 2.0) -> DataFrame:
    """Starts of alarms: runs of consecutive samples at or above `level`, joined if less than `gap` apart (not at it)."""
    own = Window.partitionBy("video_id").orderBy("t")
    on = curve.withColumn("_i", F.row_number().over(own)).where(F.col("score") >= level)
    spans = on.withColumn("_run", F.col("_i") - F.row_number().over(own)).groupBy("video_id", "_run").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    near = Window.partitionBy("video_id").orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("end").over(near) >= gap).cast("int"), F.lit(1))
    return spans.withColumn("_new", new).withColumn("_k", F.sum("_new").over(near)).groupBy("video_id", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_k")


def match_alarms(rows: pd.DataFrame, lead: float = 10.0) -> pd.DataFrame:
    """Accidents in order of their starts, each with the earliest unused alarm in the `lead` seconds before it."""
    accidents, starts = sorted(rows.loc[rows.kind == "accident", "start"]), sorted(rows.loc[rows.kind == "alarm", "start"])
    out = []
    for a in accidents:
        hit = next((s for s in starts if a - lead <= s < a), None)
        if hit is not None:
            starts.remove(hit)
        out.append((rows.video_id.iloc[0], a, hit))
    return pd.DataFrame(out, columns=["video_id", "accident", "alarm"])


def alarm_matches(truth: DataFrame, found: DataFrame) -> DataFrame:
    both = truth.where("label = 'accident'").select("video_id", "start", F.lit("accident").alias("kind")).union(found.select("video_id", "start", F.lit("alarm").alias("kind")))
    return both.groupBy("video_id").applyInPandas(lambda x: match_alarms(x), "video_id string, accident double, alarm double")


def clean_events(events: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Drops events that overlap an earlier kept one of their label, of rows that come by key and time."""
    at, last = None, None
    for part in events:
        kept = []
        for n, (start, end, *key) in enumerate(zip(*(part[c].tolist() for c in ("start", "end", *KEYS)), strict=True)):
            if key != at or start >= last:
                at, last = key, end
                kept.append(n)
        yield part.iloc[kept]


def drop_overlaps(events: DataFrame) -> DataFrame:
    """Without events that overlap an earlier kept one of their label; of equal starts the one that was given first (`ord`) stays."""
    order = ["start", "ord"] if "ord" in events.columns else ["start", "end"]
    return events.repartition(*KEYS).sortWithinPartitions(*KEYS, *order).mapInPandas(clean_events, events.schema)


def violations(predicted: DataFrame, curve: DataFrame, videos: DataFrame, labels: list[str]) -> DataFrame:
    """(video_id, ord, problem) of everything that is wrong with a prediction."""
    own = Window.partitionBy(*KEYS).orderBy("start", "end")
    joined = predicted.withColumn("_next", F.lead("start").over(own)).join(videos.select("video_id", "duration"), "video_id", "left")
    tests = {
        "unknown label": ~F.col("label").isin(labels),
        "no interval": F.col("start").isNull() | F.col("end").isNull() | (F.col("end") <= F.col("start")),
        "outside the video": (F.col("start") < 0) | (F.col("end") > F.col("duration") + 1e-6),
        "overlap": F.col("_next") < F.col("end"),
        "unknown video": F.col("duration").isNull(),
    }
    bad = joined.select("video_id", "ord", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))).alias("problem"))
    steps = Window.partitionBy("video_id").orderBy("ord")
    jumps = curve.withColumn("_back", F.col("t") < F.lag("t").over(steps)).where("_back or score < 0 or score > 1 or score is null").select("video_id", "ord", F.when(F.col("_back"), "time goes back").otherwise("no score").alias("problem"))
    missing = videos.join(predicted.select("video_id").distinct(), "video_id", "left_anti").select("video_id", F.lit(None).cast("int").alias("ord"), F.lit("no prediction").alias("problem"))
    return bad.unionByName(jumps).unionByName(missing)
