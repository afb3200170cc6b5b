"""Small videos in which customers play scenes: twelve of them a video, each with a part by its key, and a scene by the video's number.

The parts are paths through points (t, x, y) at 10 Hz, moved in time by the video's number; who has no part drives down a side
street. Every rule has a scene that it is about, under one layout, so that a run of all rules has events of every label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import scene as S
from kerbside.operators.kinematics import observations, usable
from kerbside.rules import RULES, Context, Layout, conflicts, crossing, flow, junction, pedestrians, run_rules, stationary  # noqa: F401  they register their rules
from kerbside.session import dealt, settled, table

CAST, DURATION = 12, 120.0
STREET, SIDE = 500.0, 1000.0
#: The label that each scene is about, by the scene's number.
SCENES = ("accident", "near_miss", "congestion", "illegal_u_turn", "jaywalking", "stop_line", "failure_to_yield", "stopped_vehicle", "wrong_way", "red_light", "illegal_turn", "road_obstacle")
CAR, PERSON, ANIMAL, SMOKE = ("car", 80.0, 50.0), ("person", 30.0, 80.0), ("animal", 40.0, 30.0), ("smoke", 120.0, 150.0)


def area(x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


LAYOUT = Layout(
    crossings=[area(430, 100, 570, 180)],
    stop_lines=[{"name": "near", "a": (600, 360), "b": (400, 360), "approach_sign": 1, "signal": "lamp"}],
    solid_lines=[[(1060, 0), (1060, 300), (1060, 700)]],
    intersection=area(400, 420, 600, 560),
    prohibited_turns=[{"from": area(1100, 100, 1200, 200), "to": area(1100, 450, 1200, 550)}],
    carriageways=[{"name": "street", "poly": area(430, 0, 570, 720)}, {"name": "down", "poly": area(300, 100, 400, 600)}, {"name": "up", "poly": area(700, 100, 800, 600)}],
    road_areas=[area(430, 0, 570, 720)],
)
#: (scene, part, what, points)
PARTS = [
    (0, 1, CAR, [(0, STREET, 200), (3, STREET, 350), (4, STREET, 375), (14, STREET, 377)]),
    (0, 2, CAR, [(0, STREET, -400), (4, STREET, 341), (14, STREET, 342)]),
    (1, 1, CAR, [(0, STREET, 500), (10, STREET, 500)]),
    (1, 2, CAR, [(0, STREET, -250), (1.5, STREET, 200), (1.75, STREET, 265.6), (2, STREET, 312.5), (2.25, STREET, 340.6), (2.5, STREET, 350), (10, STREET, 365)]),
    *[(2, k, CAR, [(10, STREET, 90 + 80 * k), (95, STREET, 96 + 80 * k)]) for k in range(8)],
    (3, 1, CAR, [(0, 350, 100), (4, 350, 560), (6, 550, 650), (8, 750, 560), (12, 750, 100)]),
    (4, 1, ("person", 20.0, 50.0), [(15, 400, 260), (19.8, 640, 260)]),
    (5, 1, CAR, [(10, STREET, 0), (13.2, STREET, 384), (25, STREET, 384), (28, STREET, 720)]),
    (6, 0, PERSON, [(6, 470, 140), (14, 530, 140)]),
    *[(6, k, CAR, [(2 * k, x, 0), (2 * k + 6, x, 720)]) for k in range(1, CAST) for x in ((460, 490, 515, 540)[k % 4],)],
    (7, 1, CAR, [(5, STREET, 0), (8, STREET, 330), (20.5, STREET, 330), (23.5, STREET, 720)]),
    (8, 1, CAR, [(10, STREET, 700), (15.5, STREET, 40)]),
    (9, 1, CAR, [(10, STREET, 0), (16, STREET, 720)]),
    (10, 1, CAR, [(2, 1150, 0), (8, 1150, 720)]),
    (10, 2, CAR, [(2, 1000, 100), (6, 1140, 500)]),
    (11, 1, ANIMAL, [(20, 480, 300), (24, 520, 340)]),
    (11, 2, SMOKE, [(30, 470, 300), (48, 470, 300)]),
]


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes (video_id, tid, kind, t_us, x1 ... y2) and each video's `scene`."""
    legs = [(scene, part, kind, wide, tall, float(a[0]), float(b[0]), float(a[1]), float(b[1]), float(a[2]), float(b[2]), i == len(way) - 2) for scene, part, (kind, wide, tall), way in PARTS for i, (a, b) in enumerate(zip(way[:-1], way[1:], strict=True))]
    own = spark.createDataFrame(legs, "scene int, part int, kind string, wide double, tall double, t0 double, t1 double, x0 double, x1 double, y0 double, y1 double, ends boolean")
    tid = F.col("c_custkey")
    cast = table(spark, sf_dir, "customer").select(tid.cast("bigint").alias("tid"), F.floor(tid / CAST).alias("video"), (tid % CAST).cast("int").alias("part"))
    cast = cast.withColumn("scene", (F.col("video") % len(SCENES)).cast("int"))
    legs = dealt(cast, "tid").join(F.broadcast(own), ["scene", "part"], "left")  # a script of a few dozen rows
    idle = {"kind": F.lit("car"), "wide": F.lit(80.0), "tall": F.lit(50.0), "t0": 3.0 * F.col("part"), "t1": 3.0 * F.col("part") + 6, "x0": F.lit(SIDE), "x1": F.lit(SIDE), "y0": F.lit(0.0), "y1": F.lit(720.0), "ends": F.lit(True)}
    legs = legs.select("video", "scene", "tid", *[F.coalesce(c, v).alias(c) for c, v in idle.items()])
    first, last = F.round(F.col("t0") * 10).cast("int"), F.round(F.col("t1") * 10).cast("int")
    rows = legs.withColumn("k", F.explode(F.sequence(first, last - F.when(F.col("ends"), 0).otherwise(1))))
    share = (F.col("k") - first) / (last - first)
    x, y = F.col("x0") + (F.col("x1") - F.col("x0")) * share, F.col("y0") + (F.col("y1") - F.col("y0")) * share
    tick = F.col("k") + F.col("video") * 7 % 20
    return rows.select(F.format_string("s%d", F.col("video")).alias("video_id"), "scene", "tid", "kind", (tick * 100_000).cast("bigint").alias("t_us"), (x - F.col("wide") / 2).alias("x1"), (y - F.col("tall")).alias("y1"), (x + F.col("wide") / 2).alias("x2"), y.alias("y2"))


def scripted_context(spark: SparkSession, sf_dir: str) -> Context:
    """All scenes under LAYOUT, with the traffic of all of them as the prior: it's one place."""
    boxes = scenes(spark, sf_dir)
    obs = settled(usable(observations(boxes.where("kind <> 'smoke'").drop("scene"))))  # read several times by a rule
    videos = boxes.select("video_id").distinct().withColumn("duration", F.lit(DURATION))
    cells = S.with_cells(obs.where("is_vehicle")).withColumn("video_id", F.lit("all"))
    grids = tuple(videos.select("video_id").crossJoin(F.broadcast(settled(g.drop("video_id")))) for g in (S.grid(cells), S.heading_votes(cells)))  # one place's cells
    ticks = videos.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(int(DURATION) - 1))).alias("t")).withColumn("t", F.col("t").cast("double"))
    signals = ticks.select("video_id", F.lit("lamp").alias("signal"), "t", (F.col("t") % 60).between(5, 29).alias("red"))
    smoke = boxes.where("kind = 'smoke' and t_us % 1000000 = 0").select("video_id", (F.col("t_us") / 1_000_000).alias("t"), "x1", "y1", "x2", "y2", F.lit(0.8).alias("conf"), F.lit(1).alias("cls"))
    return Context(obs, videos, LAYOUT, grids, signals, (ticks, smoke))


def shown(found: DataFrame) -> DataFrame:
    return found.select("video_id", F.round(F.col("start") * 1000).cast("bigint").alias("start_ms"), F.round(F.col("end") * 1000).cast("bigint").alias("end_ms"), "label", F.array_join("tids", ",").alias("tids"))


def scripted(label: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: shown(RULES[label](scripted_context(spark, sf_dir)))


def all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final events of all rules on the scripted videos, in one plan."""
    return shown(run_rules(scripted_context(spark, sf_dir)))


QUERIES = {"all_rules": all_rules}
#: Rules on pairs, chains and signals aren't SQL; tests/test_scripted.py holds each rule against its scenes.
ORACLE_SQL: dict[str, str] = {}
