"""Operators over ordered samples and over intervals: runs, merges, hysteresis, crossings and the final clean-up of events.

All take a DataFrame and the names of its key columns; every window is partitioned by the keys, so no operator sorts more
than one key's rows together, and none collects anything.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = Sequence[str]


def runs(df: DataFrame, keys: Keys, time: str, flag: Column | str, max_gap) -> DataFrame:
    """Maximal runs of true samples; gaps of up to `max_gap` (inclusive) between true samples are bridged. Adds n, the true samples."""
    hits = df.where(flag).select(*keys, F.col(time).alias("_t"))
    own = Window.partitionBy(*keys).orderBy("_t")
    new = F.coalesce((F.col("_t") - F.lag("_t").over(own) > max_gap).cast("int"), F.lit(1))
    return hits.withColumn("_new", new).withColumn("_run", F.sum("_new").over(own)).groupBy(*keys, "_run").agg(F.min("_t").alias("start"), F.max("_t").alias("end"), F.count("*").alias("n")).drop("_run")


def merge_segments(df: DataFrame, keys: Keys, gap=0, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals of a key that overlap or are at most `gap` apart become one."""
    own = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) - reach > gap).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(own)).groupBy(*keys, "_run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_run")


def enter_leave(df: DataFrame, keys: Keys, time: str, flag: Column | str) -> DataFrame:
    """Runs of consecutive true samples; a false sample between ends a run, however short the gap."""
    own = Window.partitionBy(*keys).orderBy(time)
    marked = df.withColumn("_i", F.row_number().over(own)).where(flag)
    return marked.withColumn("_run", F.col("_i") - F.row_number().over(own)).groupBy(*keys, "_run").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n")).drop("_run")


def hysteresis(keys: Keys, time: str, value: Column | str, enter, leave) -> Column:
    """True from a value of at least `enter` until one under `leave`; false before the first decision."""
    v = F.col(value) if isinstance(value, str) else value
    own = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    decided = F.when(v >= enter, True).when(v < leave, False)
    return F.coalesce(F.last(decided, ignorenulls=True).over(own), F.lit(False))


def crossings(df: DataFrame, keys: Keys, time: str, side: str, valid: Column | str = "true") -> DataFrame:
    """Changes of the sign of `side` between successive valid samples: t by linear interpolation, and the new sign."""
    rows = df.where(valid).select(*keys, F.col(time).alias("t0"), F.col(side).alias("s0"))
    own = Window.partitionBy(*keys).orderBy("t0")
    rows = rows.withColumn("t1", F.lead("t0").over(own)).withColumn("s1", F.lead("s0").over(own))
    changed = (F.col("s0") != 0) & (F.signum("s0") != F.signum("s1"))
    part = F.try_divide(F.col("s0"), F.col("s0") - F.col("s1"))
    return rows.where(changed).select(*keys, (F.col("t0") + (F.col("t1") - F.col("t0")) * part).alias("t"), F.signum("s1").cast("int").alias("new_sign"))


def trailing(keys: Keys, time_us: str, seconds: float):
    """A window over the samples of the last `seconds`, on integer microseconds (inclusive)."""
    return Window.partitionBy(*keys).orderBy(time_us).rangeBetween(-round(seconds * 1_000_000), 0)


def trailing_minimum(keys: Keys, time_us: str, value: str, seconds: float = 0.5, least_span: float = 0.25) -> Column:
    """The least value of the last `seconds`; 0 while these span less than `least_span`."""
    own = trailing(keys, time_us, seconds)
    span = F.col(time_us) - F.min(time_us).over(own)
    return F.when(span < round(least_span * 1_000_000), F.lit(0.0)).otherwise(F.min(value).over(own))


def decayed_peak(keys: Keys, time: str, value: str, half_life: float = 1.0) -> Column:
    """max(value now, previous result halved every `half_life`): a running maximum in the logarithm. Values must be positive."""
    own = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return F.pow(F.lit(2.0), F.max(F.log2(value) + F.col(time) / half_life).over(own) - F.col(time) / half_life)


def held(keys: Keys, time: str, flag: Column, n: int) -> Column:
    """Whether this sample and the next n - 1 are all true (false near the end of a key's samples)."""
    own = Window.partitionBy(*keys).orderBy(time).rowsBetween(0, n - 1)
    return (F.sum(flag.cast("int")).over(own) == n) & (F.count(F.lit(1)).over(own) == n)


def k_of_n(df: DataFrame, keys: Keys, time: str, flag: Column | str, k: int, n: int) -> DataFrame:
    """Adds `persistent`: at least k of the last n samples are true, this one too."""
    own = Window.partitionBy(*keys).orderBy(time).rowsBetween(-(n - 1), 0)
    f = F.expr(flag) if isinstance(flag, str) else flag
    return df.withColumn("persistent", f & (F.sum(f.cast("int")).over(own) >= k))


def per_label(values: Mapping[str, float], default: float, label: str = "label") -> Column:
    """A parameter by label."""
    out = F.lit(float(default))
    for name, value in values.items():
        out = F.when(F.col(label) == name, F.lit(float(value))).otherwise(out)
    return out


#: Merge gaps and least lengths by label, in seconds (fixed values).
MERGE_GAP = {"congestion": 5.0, "stopped_vehicle": 3.0, "jaywalking": 5.0, "failure_to_yield": 0.0}
LEAST_LENGTH = {"congestion": 75.0, "stopped_vehicle": 10.0}


def finalize(events: DataFrame, videos: DataFrame, merge_gap: Mapping[str, float] = MERGE_GAP, least_length: Mapping[str, float] = LEAST_LENGTH) -> DataFrame:
    """Clips events (video_id, label, start, end, tids) to the videos' duration, merges per label, drops short ones.

    The score starts anew at 1; tids are the sorted union over the raw events that overlap the merged one.
    """
    clipped = events.join(videos.select("video_id", "duration"), "video_id").withColumn("cs", F.greatest("start", F.lit(0.0))).withColumn("ce", F.least("end", "duration"))
    own = Window.partitionBy("video_id", "label").orderBy("cs", "ce")
    reach = F.max("ce").over(own.rowsBetween(Window.unboundedPreceding, -1))
    gap = per_label(merge_gap, 1.0)
    new = F.coalesce((F.col("cs") - reach > gap).cast("int"), F.lit(1))
    grouped = clipped.withColumn("_new", new).withColumn("_run", F.sum("_new").over(own))
    merged = grouped.groupBy("video_id", "label", "_run").agg(F.min("cs").alias("start"), F.max("ce").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tids")))).alias("tids"))  # an event's tracks are few
    return merged.where(F.col("end") - F.col("start") >= per_label(least_length, 0.5)).select("video_id", "start", "end", "label", F.lit(1.0).alias("score"), "tids")
