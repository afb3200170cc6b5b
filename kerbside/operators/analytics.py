"""Aggregates for dashboards and reports, on events, counts and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lighting(brightness: Column) -> Column:
    return F.when(brightness.isNull() | F.isnan(brightness.cast("double")), "-").when(brightness >= 110, "day").when(brightness >= 60, "dusk/overcast").otherwise("night")


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.5, "ALARM").when(score >= 0.25, "ELEVATED").otherwise("LOW")


def clock(seconds: Column) -> Column:
    """m:ss.d"""
    tenths = F.floor(seconds * 10).cast("bigint")
    return F.format_string("%d:%02d.%d", F.floor(tenths / 600).cast("bigint"), F.floor(tenths / 10).cast("bigint") % 60, tenths % 10)


def pretty(label: Column) -> Column:
    return F.upper(F.replace(label, F.lit("_"), F.lit(" ")))


def nice_step(raw: Column) -> Column:
    """The next of 1, 2, 5 or 10 times a power of ten."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    x = raw / unit
    return unit * F.when(x <= 1, 1).when(x <= 2, 2).when(x <= 5, 5).otherwise(10)


def heat_strip(events: DataFrame, keys: list[str], duration: Column, bins: int = 24) -> DataFrame:
    """How many events touch each of `bins` equal parts of a key's duration, and which labels."""
    first, last = (F.least(F.floor(F.col(c) / duration * bins), F.lit(bins - 1)).cast("int") for c in ("start", "end"))
    rows = events.select(*keys, "label", F.explode(F.sequence(first, F.greatest(first, last))).alias("bin"))
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))  # labels are few


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def alarm_share(curve: DataFrame, keys: list[str], level: float = 0.5) -> DataFrame:
    """The share of time that a step function (each sample until the next) is at or above a level."""
    step = F.lead("t").over(Window.partitionBy(*keys).orderBy("t")) - F.col("t")
    s = curve.withColumn("_dt", step)
    return s.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("score") >= level, F.col("_dt")).otherwise(0)), F.sum("_dt")), F.lit(0.0)).alias("share"))


def otsu_threshold(values: DataFrame, keys: list[str], value: str, least: int = 10, least_range: float = 8.0) -> DataFrame:
    """Otsu's threshold of each key's values on a scale of 256 steps; null with fewer than `least` values or too small a range."""
    spans = values.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    scaled = values.join(spans.where((F.col("n") >= least) & (F.col("hi") - F.col("lo") >= least_range)), keys).withColumn("q", F.floor((F.col(value) - F.col("lo")) * 255 / (F.col("hi") - F.col("lo"))))
    histogram = scaled.groupBy(*keys, "q").agg(F.count("*").alias("c"))
    own, whole = Window.partitionBy(*keys).orderBy("q").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    h = histogram.withColumn("w0", F.sum("c").over(own)).withColumn("s0", F.sum(F.col("c") * F.col("q")).over(own)).withColumn("w", F.sum("c").over(whole)).withColumn("s", F.sum(F.col("c") * F.col("q")).over(whole))
    d = F.col("s0") * F.col("w") - F.col("s") * F.col("w0")
    between = F.try_divide(d.cast("double") * d.cast("double"), (F.col("w0") * (F.col("w") - F.col("w0"))).cast("double"))
    best = h.groupBy(*keys).agg(F.max_by("q", F.struct(F.coalesce(between, F.lit(-1.0)), -F.col("q"))).alias("q"))
    return spans.join(best, keys, "left").select(*keys, F.col("q").alias("threshold_q"))
