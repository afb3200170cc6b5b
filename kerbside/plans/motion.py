"""Queries on trajectories: kinematics, the grid model and the flow rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import scene as S
from kerbside.operators.kinematics import causal_fit, heading_bin
from kerbside.plans.derived import TRAJECTORIES, observed, videos
from kerbside.rules import Context
from kerbside.rules.flow import against_traffic, wrong_way
from kerbside.session import settled


def _round(c, scale: int = 1):
    return F.round(F.col(c) * scale).cast("bigint") if isinstance(c, str) else F.round(c * scale).cast("bigint")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_cells(observed(spark, sf_dir))


def local_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).select("video_id", "tid", "t_us", _round("x", 100).alias("x100"), _round("y", 100).alias("y100"), _round("vx", 100).alias("vx100"), _round("rel_speed", 1000).alias("rel1000"))


def causal_fit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causal_fit(observed(spark, sf_dir)).select("video_id", "tid", "t_us", _round("fx", 100).alias("x100"), _round("fvx", 100).alias("vx100"), _round("fsize", 100).alias("size100"))


def heading_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).where("speed >= 25").groupBy("video_id", heading_bin(F.col("vx"), F.col("vy")).alias("b")).agg(F.count("*").alias("n"))


def visits_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grid(cells(spark, sf_dir)).select("video_id", "r", "c", "visits", _round("dwell", 10).alias("dwell10"))


def heading_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.heading_votes(cells(spark, sf_dir))


def road_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.road(S.grid(cells(spark, sf_dir)))


def direction_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.direction_share(S.heading_votes(cells(spark, sf_dir))).select("video_id", "r", "c", "b", _round("votes", 9).alias("votes9"), _round("share", 10000).alias("share10000"))


def scene_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first video's grid with the second's as a prior of half its weight."""
    g = S.grid(cells(spark, sf_dir))
    own, prior = (g.where(F.col("video_id") == v).withColumn("video_id", F.lit("0")) for v in ("0", "1"))
    return S.blend(own, prior, S.CELL, ("visits",), 0.5).select("r", "c", _round("visits", 2).alias("visits2"))


def dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dominant_direction(S.heading_votes(cells(spark, sf_dir)))


def context(spark: SparkSession, sf_dir: str) -> Context:
    return Context(settled(observed(spark, sf_dir)), videos(spark, sf_dir))  # read several times by a rule


def against(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_traffic(context(spark, sf_dir)).where("against").groupBy("video_id", "tid").agg(F.count("*").alias("n"))


def wrong_way_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrong_way(context(spark, sf_dir))
    return found.select("video_id", F.element_at("tids", 1).alias("tid"), _round("start", 1000).alias("start_ms"), _round("end", 1000).alias("end_ms"), "label")


QUERIES = {
    "wrong_way": wrong_way_events,
    "local_fit": local_fit,
    "causal_fit": causal_fit_query,
    "heading_bins": heading_bins,
    "visits_dwell": visits_dwell,
    "heading_votes": heading_votes,
    "road_cells": road_cells,
    "direction_share": direction_share,
    "scene_blend": scene_blend,
    "dominant_direction": dominant,
    "against_traffic": against,
}

CELLS = "cells AS (SELECT *, least(greatest(trunc(y / 720 * 27)::INT, 0), 26) AS r, least(greatest(trunc(x / 1280 * 48)::INT, 0), 47) AS c, (CASE WHEN vx >= 0 THEN 0 ELSE 4 END) AS b FROM obs)"
VOTES = "votes AS (SELECT video_id, r, c, b, count(DISTINCT tid) AS votes FROM cells WHERE speed >= 25 GROUP BY ALL)"
GRID = "grid AS (SELECT video_id, r, c, count(DISTINCT CASE WHEN speed >= 25 THEN tid END) AS visits, sum(CASE WHEN speed < 25 THEN 1 ELSE 0 END)::BIGINT AS dwell10 FROM cells GROUP BY ALL)"
SHARE = """
lattice AS (SELECT r.r, c.c FROM range(27) r(r), range(48) c(c)),
near AS (SELECT v.video_id, l.r, l.c, v.b, sum(v.votes)::BIGINT AS votes9 FROM lattice l, range(-1, 2) a(dr), range(-1, 2) d(dc), votes v
  WHERE v.r = least(greatest(l.r + dr, 0), 26) AND v.c = least(greatest(l.c + dc, 0), 47) GROUP BY ALL),
total AS (SELECT video_id, r, c, sum(votes9)::BIGINT AS total9 FROM near GROUP BY ALL),
share AS (SELECT t.video_id, t.r, t.c, kb::INT AS b, t.total9 AS votes9,
  (SELECT coalesce(sum(n.votes9 * CASE WHEN n.b = kb THEN 2 ELSE 1 END), 0) FROM near n WHERE n.video_id = t.video_id AND n.r = t.r AND n.c = t.c AND (n.b = kb OR (n.b + 1) % 8 = kb OR (n.b + 7) % 8 = kb)) / (4.0 * t.total9) AS share
  FROM total t, range(8) k(kb))
"""
BASE = f"WITH {TRAJECTORIES}, {CELLS}"
AGAINST = """
flags AS (SELECT c.* FROM cells c JOIN share s ON s.video_id = c.video_id AND s.r = c.r AND s.c = c.c AND s.b = c.b WHERE c.rel_speed >= 0.4 AND s.votes9 >= 135 AND s.share <= 0.04)
"""

ORACLE_SQL = {
    "local_fit": f"WITH {TRAJECTORIES} SELECT video_id, tid, t_us, round(x * 100)::BIGINT AS x100, round(y * 100)::BIGINT AS y100, round(vx * 100)::BIGINT AS vx100, round(rel_speed * 1000)::BIGINT AS rel1000 FROM obs",
    "causal_fit": f"""WITH {TRAJECTORIES}, f AS (SELECT video_id, tid, t_us, count(*) OVER w AS n, coalesce(regr_slope(gx, t) OVER w, 0) AS v, avg(gx) OVER w AS mx, avg(t) OVER w AS mt, t
      FROM obs WINDOW w AS (PARTITION BY video_id, tid ORDER BY t_us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW))
      SELECT video_id, tid, t_us, CASE WHEN n >= 4 THEN round((mx + v * (t - mt)) * 100)::BIGINT END AS x100, CASE WHEN n >= 4 THEN round(v * 100)::BIGINT END AS vx100, CASE WHEN n >= 4 THEN round(sqrt(8900.0) * 100)::BIGINT END AS size100 FROM f""",
    "heading_bins": f"{BASE} SELECT video_id, b::INT AS b, count(*) AS n FROM cells WHERE speed >= 25 GROUP BY ALL",
    "visits_dwell": f"{BASE}, {GRID} SELECT * FROM grid",
    "heading_votes": f"{BASE}, {VOTES} SELECT video_id, r, c, b::INT AS b, votes FROM votes",
    "road_cells": f"{BASE}, {GRID} SELECT DISTINCT video_id, (r + dr)::INT AS r, (c + dc)::INT AS c FROM grid, range(-1, 2) a(dr), range(-1, 2) d(dc) WHERE visits >= 3 AND r + dr BETWEEN 0 AND 26 AND c + dc BETWEEN 0 AND 47",
    "direction_share": f"{BASE}, {VOTES}, {SHARE} SELECT video_id, r::INT AS r, c::INT AS c, b, votes9, round(share * 10000)::BIGINT AS share10000 FROM share",
    "scene_blend": f"{BASE}, {GRID} SELECT r, c, sum(visits * CASE WHEN video_id = '0' THEN 2 ELSE 1 END)::BIGINT AS visits2 FROM grid GROUP BY r, c",
    "dominant_direction": f"{BASE}, {VOTES} SELECT video_id, r, c, b::INT AS b, (b * 2 // 8)::INT AS direction FROM (SELECT *, row_number() OVER (PARTITION BY video_id, r, c ORDER BY votes DESC, b) AS k FROM votes) WHERE k = 1",
    "against_traffic": f"{BASE}, {VOTES}, {SHARE}, {AGAINST} SELECT video_id, tid, count(*) AS n FROM flags GROUP BY ALL",
    "wrong_way": f"""{BASE}, {VOTES}, {SHARE}, {AGAINST},
      gaps AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY video_id, tid ORDER BY t) <= 1.0 THEN 0 ELSE 1 END AS fresh FROM flags),
      numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id, tid ORDER BY t) AS run FROM gaps),
      found AS (SELECT video_id, tid, min(t) AS s, max(t) AS e, arg_min(x, t) AS x0, arg_max(x, t) AS x1 FROM numbered GROUP BY video_id, tid, run),
      ends AS (SELECT video_id, tid, max(t) AS last FROM obs GROUP BY ALL)
      SELECT video_id, tid, round(s * 1000)::BIGINT AS start_ms, round((CASE WHEN last - e < 1.0 THEN last ELSE e END) * 1000)::BIGINT AS end_ms, 'wrong_way' AS label
      FROM found JOIN ends USING (video_id, tid) WHERE e - s >= 2.5 AND abs(x1 - x0) >= 2 * sqrt(8900.0)""",
}
