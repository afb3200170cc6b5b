"""Queries on figures of whole videos and on repaired results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import boards as B
from kerbside.plans.derived import EVENTS, TRAJECTORIES, event_series, observed, videos
from kerbside.session import table

HOUR = 3_600_000_000


def counts_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.counts_per_second(observed(spark, sf_dir, True), videos(spark, sf_dir), ["car", "person"])


def track_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.track_totals(observed(spark, sf_dir, True))


def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.heatmap(observed(spark, sf_dir).withColumn("px", F.round(F.col("gx") * 10)).withColumn("py", F.round(F.col("gy") * 10)), "px", "py", ["video_id"], 40.0)
    return found.select("video_id", "cx", "cy", "n", F.round(F.col("heat") * 1000).cast("bigint").alias("heat1000"))


def brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days as frames, the values as grey levels."""
    rows = event_series(spark, sf_dir).where("value100 is not null").withColumn("day", F.floor(F.col("t_us") / (24 * HOUR)).cast("bigint"))
    return B.brightness(rows, ["user_id"], "day", "value100").select("user_id", F.floor(F.col("brightness") * 10 + 1e-4).cast("bigint").alias("brightness10"), "frames")


def greedy_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events at least a day apart."""
    return B.thinned(event_series(spark, sf_dir).select("user_id", "event_id", "t_us"), ["user_id"], "t_us", 24 * HOUR, "event_id").select("user_id", "t_us")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a careless writer's: text for numbers, some of them none or not finite, ends before starts, long labels."""
    v, i = F.col("value100"), F.col("event_id")
    start = F.when(i % 13 == 0, "nan").when(i % 13 == 1, "soon").otherwise((i % 2000).cast("string"))
    end = F.when(i % 17 == 0, "inf").otherwise((i % 2000 + F.coalesce(v % 60, F.lit(0)) - 20).cast("string"))
    return event_series(spark, sf_dir).select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("ord"), start.alias("start"), end.alias("end"), F.when(i % 5 == 0, F.repeat("event_type", 9)).otherwise(F.col("event_type")).alias("label"), (v / 10000).alias("score"))


def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = B.sanitised(_raw(spark, sf_dir))
    return x.select("ord", *[F.col(c).cast("bigint").alias(c) for c in ("start", "end")], "label", F.round(F.col("score") * 10000).cast("bigint").alias("score10000"))


def coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return B.coerced(raw, raw.select("video_id").distinct().withColumn("duration", F.lit(1900.0)), ["click", "purchase"]).select("video_id", "ord", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "label")


def user_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_series(spark, sf_dir)
    seconds = rows.groupBy("user_id").agg(((F.max("t_us") - F.min("t_us")) / 1_000_000).alias("duration"))
    return B.video_tiles(rows.withColumnRenamed("event_type", "label"), seconds, ["user_id"]).select("user_id", "n", F.floor(F.col("per_hour") * 1000 + 1e-6).cast("bigint").alias("per_1000_hours"), "top_label")


def alarm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' values as a risk curve in hours; a value of 90 and more is an accident of an hour."""
    curve = event_series(spark, sf_dir).where("value100 is not null").select(F.col("user_id").cast("string").alias("video_id"), (F.col("t_us") / HOUR).alias("t"), F.least(F.col("value100") / 10000, F.lit(1.0)).alias("score"))
    truth = curve.where("score >= 0.9").select("video_id", F.col("t").alias("start"), (F.col("t") + 1).alias("end"), F.lit("accident").alias("label"))
    one = B.alarm_score(curve, truth)
    return one.select("accidents", "alarms", "matched", *[F.round(F.col(c) * 10000).cast("bigint").alias(f"{c}10000") for c in ("ap", "f1", "mean_warning", "score")])


QUERIES = {
    "counts_per_second": counts_per_second, "track_totals": track_totals, "heatmap": heatmap, "brightness": brightness, "greedy_thinned": greedy_thinned,
    "sanitised": sanitised, "coerced_events": coerced, "user_tiles": user_tiles, "alarm_score": alarm_score,
}

_RAW = """rw AS (SELECT user_id::VARCHAR AS video_id, event_id AS ord, CASE WHEN event_id % 13 IN (0, 1) THEN 0 ELSE event_id % 2000 END AS s,
  CASE WHEN event_id % 17 = 0 THEN 0 ELSE event_id % 2000 + coalesce(value100 % 60, 0) - 20 END AS e, CASE WHEN event_id % 5 = 0 THEN repeat(event_type, 9) ELSE event_type END AS label, value100 FROM ev)"""

ORACLE_SQL = {
    "counts_per_second": f"""WITH {TRAJECTORIES}, sp AS (SELECT video_id, tid, any_value(segment) AS segment, min(t) AS s, max(t) AS e FROM obs GROUP BY ALL),
      k AS (SELECT v.video_id, r.k AS second FROM (SELECT DISTINCT video_id FROM obs) v, range(67) r(k))
      SELECT k.video_id, k.second, count(*) FILTER (sp.segment <> 'FURNITURE') AS car, count(*) FILTER (sp.segment = 'FURNITURE') AS person
      FROM k LEFT JOIN sp ON sp.video_id = k.video_id AND k.second BETWEEN sp.s - 0.1 - 1e-9 AND sp.e + 0.1 + 1e-9 GROUP BY ALL""",
    "track_totals": f"WITH {TRAJECTORIES} SELECT CASE WHEN segment = 'FURNITURE' THEN 'person' ELSE 'car' END AS kind, count(DISTINCT tid) AS n FROM obs GROUP BY ALL",
    "heatmap": f"WITH {TRAJECTORIES} SELECT video_id, floor(round(gx * 10) / 40)::BIGINT AS cx, floor(round(gy * 10) / 40)::BIGINT AS cy, count(*) AS n, round(ln(1 + count(*)) * 1000)::BIGINT AS heat1000 FROM obs GROUP BY ALL",
    "brightness": f"WITH {EVENTS}, d AS (SELECT user_id, t_us // {24 * HOUR} AS day, sum(value100) / count(*) AS v FROM ev WHERE value100 IS NOT NULL GROUP BY ALL) SELECT user_id, floor(quantile_cont(v, 0.5) * 10 + 1e-4)::BIGINT AS brightness10, count(*) AS frames FROM d GROUP BY user_id",
    "greedy_thinned": f"""WITH RECURSIVE {EVENTS}, k AS (SELECT user_id, min(t_us) AS t_us FROM ev GROUP BY user_id
      UNION ALL SELECT k.user_id, min(ev.t_us) AS t_us FROM k JOIN ev ON ev.user_id = k.user_id AND ev.t_us >= k.t_us + {24 * HOUR} GROUP BY k.user_id) SELECT user_id, t_us FROM k""",
    "sanitised": f"WITH {EVENTS}, {_RAW} SELECT ord, least(s, e)::BIGINT AS start, greatest(s, e)::BIGINT AS \"end\", label[1:40] AS label, CASE WHEN value100 IS NULL THEN 0 ELSE least(greatest(value100, 0), 10000) END::BIGINT AS score10000 FROM rw",
    "user_tiles": f"""WITH {EVENTS}, k AS (SELECT user_id, event_type, count(*) AS c FROM ev GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS r FROM k),
      u AS (SELECT user_id, count(*) AS n, (max(t_us) - min(t_us)) / 1e6 AS d FROM ev GROUP BY user_id)
      SELECT u.user_id, n, CASE WHEN d > 0 THEN floor(n * 3600.0::DOUBLE / d * 1000 + 1e-6)::BIGINT ELSE 0 END AS per_1000_hours, event_type AS top_label FROM u JOIN t ON t.user_id = u.user_id AND r = 1""",
}
