"""The rules on small videos of twelve customers each, with a drawn layout and signals that change every 15 seconds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import scene as S
from kerbside.operators.kinematics import observations, usable
from kerbside.operators.pairs import candidate_pairs, pair_series
from kerbside.plans.derived import TRAJECTORIES, trajectories
from kerbside.plans.scripted import scripted
from kerbside.rules import RULES, Context, Layout, conflicts, crossing, flow, junction, pedestrians, stationary  # noqa: F401  they register their rules
from kerbside.session import settled

GROUP = 12
#: Rules that straight ways don't bring out: these have the scripted videos as well.
SCRIPTED = ("accident", "congestion", "failure_to_yield", "illegal_u_turn", "jaywalking", "near_miss", "stop_line", "stopped_vehicle")


def _box(x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


LAYOUT = Layout(
    crossings=[_box(300, 380, 360, 430)],
    stop_lines=[{"name": "stop", "a": (640, 370), "b": (640, 440), "approach_sign": 1, "signal": "lamp"}],
    solid_lines=[[(500, 380), (510, 440)]],
    intersection=_box(700, 370, 900, 440),
    prohibited_turns=[{"from": _box(100, 380, 200, 440), "to": _box(400, 380, 480, 440)}],
    carriageways=[{"name": "west", "poly": _box(0, 380, 600, 400)}, {"name": "east", "poly": _box(0, 405, 600, 430)}],
    road_areas=[_box(0, 370, 1280, 440)],
)


def small_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectories(spark, sf_dir, True).withColumn("video_id", F.floor(F.col("tid") / GROUP).cast("string"))
    return usable(observations(rows))


def context(spark: SparkSession, sf_dir: str) -> Context:
    obs = settled(small_videos(spark, sf_dir))  # read several times by a rule
    videos = trajectories(spark, sf_dir).select(F.floor(F.col("tid") / GROUP).cast("string").alias("video_id")).distinct().withColumn("duration", F.lit(67.0))
    ticks = videos.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(66))).alias("k"))
    signals = ticks.select("video_id", F.lit("lamp").alias("signal"), F.col("k").cast("double").alias("t"), ((F.floor(F.col("k") / 15) + F.col("video_id").cast("int")) % 2 == 1).alias("red"))
    # all people are smoke as well: of each, the first box of a second
    first = obs.where("kind = 'person'").groupBy("video_id", "tid", F.round("t").alias("at")).agg(F.min_by(F.struct("x1", "y1", "x2", "y2"), "t").alias("box"))
    boxes = first.select("video_id", F.col("at").alias("t"), "box.*", F.lit(0.8).alias("conf"), F.lit(1).alias("cls"))
    return Context(obs, videos, LAYOUT, signals=signals, fire=(ticks.select("video_id", F.col("k").cast("double").alias("t")), boxes))


def _query(label: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = context(spark, sf_dir)
        if label == "road_obstacle":  # every seventh person is an animal; all videos show one road, which few vehicles of a single one don't teach
            seen = S.grid(ctx.vehicles.withColumn("video_id", F.lit("all"))).drop("video_id")
            animals = F.when((F.col("kind") == "person") & (F.col("tid") % 7 == 0), "animal").otherwise(F.col("kind"))
            ctx = replace(ctx, obs=ctx.obs.withColumn("kind", animals), prior=(ctx.videos.select("video_id").crossJoin(seen), ctx.votes))
        own = RULES[label](ctx).select("video_id", F.round(F.col("start") * 1000).cast("bigint").alias("start_ms"), F.round(F.col("end") * 1000).cast("bigint").alias("end_ms"), "label", F.array_join("tids", ",").alias("tids"))
        return own.unionByName(scripted(label)(spark, sf_dir)) if label in SCRIPTED else own

    return query


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_pairs(small_videos(spark, sf_dir))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned pairs: samples, least distance in thousandths of a size."""
    obs = settled(small_videos(spark, sf_dir))  # read several times by a rule
    rows = pair_series(obs, candidate_pairs(obs))
    return rows.groupBy("video_id", "a", "b").agg(F.count("*").alias("n"), F.round(F.min("t") * 10).cast("bigint").alias("start10"), F.round(F.max("t") * 10).cast("bigint").alias("end10"))


QUERIES = {f"rule_{label}": _query(label) for label in sorted(RULES) if label != "wrong_way"} | {"candidate_pairs": pairs, "pair_series": series}

_SMALL = f"""{TRAJECTORIES}, small AS (SELECT (tid // {GROUP})::VARCHAR AS video_id, tid, t_us, t, x, y, CASE WHEN segment = 'FURNITURE' THEN sqrt(7300.0) ELSE sqrt(8900.0) END AS size FROM obs),
sp AS (SELECT video_id, tid, min(t) AS s, max(t) AS e, min(x) AS l, max(x) AS r, min(y) AS u, max(y) AS d, max(size) AS z FROM small GROUP BY ALL),
pr AS (SELECT p.video_id, p.tid AS a, q.tid AS b FROM sp p JOIN sp q ON p.video_id = q.video_id AND (p.s < q.s OR (p.s = q.s AND p.tid < q.tid)) AND q.s <= p.e - 0.5
  AND sqrt(pow(greatest(0, q.l - p.r, p.l - q.r), 2) + pow(greatest(0, q.u - p.d, p.u - q.d), 2)) <= 4 * greatest(p.z, q.z))"""

ORACLE_SQL = {"candidate_pairs": f"WITH {_SMALL} SELECT video_id, a, b FROM pr"}
