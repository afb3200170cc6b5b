"""Tables in the shape of the engine's, derived from the given ones by integer arithmetic, in Spark and in SQL.

Trajectories come from customers: one track each, 64 samples at 10 Hz. Every 17th drives against the rest, every 11th
stops for three seconds; others are people by their market segment. Positions are in tenths of a pixel, times in microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.kinematics import observations, usable
from kerbside.session import dealt, table

SAMPLES = 64


def trajectories(spark: SparkSession, sf_dir: str, kinds: bool = False) -> DataFrame:
    """Boxes of 80 x 50 (people 30 x 80): video_id, tid, kind, t_us, x1, y1, x2, y2."""
    people = (F.col("c_mktsegment") == "FURNITURE") if kinds else F.lit(False)
    rows = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 2).cast("string").alias("video_id"), F.col("c_custkey").cast("bigint").alias("tid"), F.when(people, "person").otherwise("car").alias("kind"))
    # a join rather than an explode: Spark takes an explode's rows for as many as the customers, and would broadcast all samples
    rows = dealt(rows, "tid").crossJoin(F.broadcast(spark.range(SAMPLES).select(F.col("id").cast("int").alias("k"))))
    tid, k = F.col("tid"), F.col("k")
    step = F.when(tid % 11 == 0, F.least(k, F.lit(20)) + F.greatest(k - 50, F.lit(0))).otherwise(k)
    rows = rows.withColumn("t_us", ((tid * 5) % 600 + k) * 100_000).withColumn("x10", F.when(tid % 17 == 0, 12800 - 200 * step).otherwise(200 * step)).withColumn("y10", 3900 + 270 * (tid % 2))
    half, tall = (F.when(F.col("kind") == "person", a).otherwise(b) for a, b in ((150, 400), (800, 500)))
    return rows.select("video_id", "tid", "kind", F.col("t_us").cast("bigint").alias("t_us"), ((F.col("x10") - half) / 10).alias("x1"), ((F.col("y10") - tall) / 10).alias("y1"), ((F.col("x10") + half) / 10).alias("x2"), (F.col("y10") / 10).alias("y2"))


def observed(spark: SparkSession, sf_dir: str, kinds: bool = False) -> DataFrame:
    return usable(observations(trajectories(spark, sf_dir, kinds)))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 2).cast("string").alias("video_id")).distinct().withColumn("duration", F.lit(67.0))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as irregular series: user_id, event_id, t_us (since 2024), event_type, value in hundredths."""
    us = F.timestampdiff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) if hasattr(F, "timestampdiff") else F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select("user_id", "event_id", us.alias("t_us"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("value100"), "props")


TRAJECTORIES = """
traj0 AS (SELECT c_nationkey % 2 AS video_id, c_custkey::BIGINT AS tid, k, c_mktsegment AS segment,
  CASE WHEN c_custkey % 11 = 0 THEN least(k, 20) + greatest(k - 50, 0) ELSE k END AS step FROM customer, range(64) r(k)),
traj AS (SELECT video_id::VARCHAR AS video_id, tid, ((tid * 5) % 600 + k) * 100000 AS t_us,
  (CASE WHEN tid % 17 = 0 THEN 12800 - 200 * step ELSE 200 * step END) / 10.0::DOUBLE AS gx, (3900 + 270 * (tid % 2)) / 10.0::DOUBLE AS gy, segment FROM traj0),
fit0 AS (SELECT *, regr_slope(gx, t_us / 1e6) OVER w AS vx, avg(gx) OVER w AS mx, avg(t_us / 1e6) OVER w AS mt, avg(gy) OVER w AS y
  FROM traj WINDOW w AS (PARTITION BY video_id, tid ORDER BY t_us RANGE BETWEEN 300001 PRECEDING AND 300001 FOLLOWING)),
obs AS (SELECT video_id, tid, t_us, t_us / 1e6 AS t, gx, gy, mx + vx * (t_us / 1e6 - mt) AS x, y, vx, 0.0 AS vy, abs(vx) AS speed, sqrt(8900.0) AS size, abs(vx) / sqrt(8900.0) AS rel_speed, segment FROM fit0)
"""

EVENTS = "ev AS (SELECT user_id, event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t_us, event_type, round(value * 100)::BIGINT AS value100, props FROM events)"
