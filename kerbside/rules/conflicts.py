"""Rules on pairs of road users: accident and near_miss. Both read one table of aligned pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.operators.kinematics import heading_change
from kerbside.operators.pairs import PAIR, candidate_pairs, pair_series, paths_meet, time_to_collision
from kerbside.operators.sequences import held
from kerbside.operators.temporal import asof
from kerbside.rules import Context, events, rule

TRACK = ["video_id", "tid"]
US = 1_000_000


def conflict_series(ctx: Context) -> DataFrame:
    users = ctx.obs.where("is_vehicle or kind = 'person'")
    return pair_series(users, candidate_pairs(users)).where("is_vehicle_a or is_vehicle_b")


def around(ctx: Context) -> DataFrame:
    """Each observation with what its track does within seconds of it: frames on microseconds, one sort for all."""
    own = Window.partitionBy(*TRACK).orderBy("t_us")
    span = lambda lo, hi: own.rangeBetween(round(lo * US), round(hi * US))
    rel = F.col("rel_speed")
    rows = ctx.obs.withColumn("track_end", F.max("t").over(Window.partitionBy(*TRACK)))
    rows = rows.withColumn("drop", F.max(rel).over(span(-0.5, 0)) - F.min(rel).over(span(0, 1.0)))
    stands = (F.max(rel).over(span(0, 3.0)) < 0.15) & (F.col("t") + 3.0 <= F.col("track_end"))
    rows = rows.withColumn("_stop", F.when(stands, F.col("t"))).withColumn("stop_at", F.min("_stop").over(span(0, 4.0))).drop("_stop")
    n, most, least = (f.over(span(-1.0, 1.0)) for f in (F.count("*"), F.max("size"), F.min("size")))
    return rows.withColumn("stable", (n >= 3) & (most / F.greatest(least, F.lit(1.0)) <= 1.4))


def at_pair_time(rows: DataFrame, tracks: DataFrame, t: str, values: tuple[str, ...], most: float = 1.5) -> DataFrame:
    """Values of both tracks of a pair at a time: of the nearest observation, if it is not too far."""
    for k in "ab":
        side = tracks.select("video_id", F.col("tid").alias(k), F.col("t").alias("_t"), *[F.col(v).alias(f"{v}_{k}") for v in values])
        rows = asof(rows, side, ["video_id", k], t, "_t").where(F.abs(F.col("_t") - F.col(t)) <= most).drop("_t")
    return rows


@rule("accident")
def accident(ctx: Context, contact: float = 0.15, near: float = 0.5, approach: float = 1.2, drop: float = 1.2, together: float = 1.2) -> DataFrame:
    """A contact after an approach, with a sudden loss of speed, after which both stand still close together; the first of each pair."""
    own = Window.partitionBy(*PAIR).orderBy((F.col("t") * US).cast("bigint"))
    series = ctx.conflicts.withColumn("approach", F.max("closing_rel").over(own.rangeBetween(-round(1.5 * US), -1)))
    hits = series.where((F.col("iou") >= contact) & (F.col("dist_rel") <= near) & (F.col("approach") >= approach)).select(*PAIR, "t")
    known = at_pair_time(hits, around(ctx), "t", ("drop", "stop_at", "stable"))
    crash = known.where(F.col("stable_a") & F.col("stable_b") & (F.greatest("drop_a", "drop_b") >= drop) & F.col("stop_at_a").isNotNull() & F.col("stop_at_b").isNotNull())
    crash = crash.withColumn("stop", F.greatest("stop_at_a", "stop_at_b")).select(*PAIR, "t", "stop")
    after = crash.join(series.select(*PAIR, F.col("t").alias("_t"), "dist_rel"), PAIR).where(F.col("_t").between(F.col("stop"), F.col("stop") + 3.0))
    close = after.groupBy(*PAIR, "t", "stop").agg(F.max("dist_rel").alias("apart")).where(F.col("apart") <= together)
    first = close.groupBy(*PAIR).agg(F.min_by(F.struct("t", "stop"), "t").alias("s")).select(*PAIR, F.col("s.t").alias("start"), F.col("s.stop").alias("stop"))
    return events(first.withColumn("end", F.least(F.greatest("stop", F.col("start") + 1.0), F.col("start") + 30.0)), "accident", F.array(F.col("a").cast("bigint"), F.col("b").cast("bigint")))


def evasive(ctx: Context, brake: float = 2.5, swerve: float = math.radians(35)) -> DataFrame:
    """Vehicle observations that begin to brake hard (within 0.4 s) or to swerve (within 1 s)."""
    v = ctx.obs.where("is_vehicle").select(*TRACK, "t", "rel_speed", "vx", "vy")
    both = v
    for name, ahead in (("b", 0.4), ("s", 1.0)):  # the observations nearest to these times, by a sort and a look at the neighbours
        there = v.select(*TRACK, F.col("t").alias("_t"), F.struct(F.col("t").alias("_t"), F.col("rel_speed").alias("_rel"), F.col("vx").alias("_vx"), F.col("vy").alias("_vy")).alias(name))
        both = asof(both.withColumn("_at", F.col("t") + ahead), there, TRACK, "_at", "_t").drop("_t", "_at")
    braking = (F.col("b._t") > F.col("t")) & (F.try_divide(F.col("rel_speed") - F.col("b._rel"), F.col("b._t") - F.col("t")) >= brake)
    swerving = (F.col("rel_speed") > 0.5) & (heading_change(F.col("vx"), F.col("vy"), F.col("s._vx"), F.col("s._vy")) >= swerve)
    return both.select(*TRACK, "t", F.coalesce(braking, F.lit(False)).alias("brakes"), F.coalesce(swerving, F.lit(False)).alias("swerves"))


@rule("near_miss")
def near_miss(ctx: Context, contact: float = 0.12, soon: float = 1.2, clear: float = 1.5, most_seconds: float = 8.0) -> DataFrame:
    """A collision course held for two samples, with an evasive move and no contact."""
    series = ctx.conflicts
    untouched = series.groupBy(*PAIR).agg(F.max("iou").alias("m"), F.max("t").alias("last")).where(F.col("m") < contact)
    meet = (time_to_collision(F.col("dist_rel"), F.col("closing_rel")) < soon) & paths_meet(soon)
    risky = series.withColumn("risky", held(PAIR, "t", meet, 2)).where("risky").groupBy(*PAIR).agg(F.min("t").alias("danger")).join(untouched.select(*PAIR, "last"), PAIR)
    moves = evasive(ctx)
    onsets = None
    for k in "ab":
        side = risky.join(moves.withColumnRenamed("tid", k), ["video_id", k]).where((F.col("t") >= F.col("danger") - 1.0) & (F.col("t") <= F.col("danger") + 1.5))
        found = side.groupBy(*PAIR, "danger", "last").agg(F.count("*").alias("n"), F.min(F.when(F.col("brakes"), F.col("t"))).alias("brake"), F.min(F.when(F.col("swerves"), F.col("t"))).alias("swerve")).where("n >= 3")
        found = found.select(*PAIR, "danger", "last", F.coalesce("brake", "swerve").alias("onset")).where("onset is not null")
        onsets = found if onsets is None else onsets.unionByName(found)
    started = onsets.groupBy(*PAIR, "danger", "last").agg(F.min("onset").alias("start"))
    stable = at_pair_time(started, around(ctx), "start", ("stable",)).where("stable_a and stable_b")
    over = stable.join(series.select(*PAIR, "t", "closing_rel", "dist_rel"), PAIR, "left")
    free = F.when((F.col("t") > F.col("danger")) & (F.col("closing_rel") < 0) & (F.col("dist_rel") > clear), F.col("t"))
    ended = over.groupBy(*PAIR, "start", "last").agg(F.min(free).alias("free")).withColumn("stop", F.coalesce("free", F.least("last", F.col("start") + most_seconds)))
    found = ended.where(F.col("stop") - F.col("start") > 0.3).withColumn("end", F.least("stop", F.col("start") + most_seconds))
    return events(found, "near_miss", F.array(F.col("a").cast("bigint"), F.col("b").cast("bigint")))
