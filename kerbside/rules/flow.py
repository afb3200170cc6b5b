"""Rules on the flow of traffic: wrong_way and congestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geometry import any_of, inside, polygon
from kerbside.operators import scene as S
from kerbside.operators.kinematics import heading_bin
from kerbside.operators.sequences import runs
from kerbside.operators.temporal import asof
from kerbside.rules import Context, events, rule

TRACK = ["video_id", "tid"]


def track_ends(obs: DataFrame) -> DataFrame:
    return obs.groupBy(*TRACK).agg(F.min("t").alias("track_start"), F.max("t").alias("track_end"), F.percentile("size", 0.5).alias("median_size"))


def at_time(rows: DataFrame, obs: DataFrame, t: str, **columns: str) -> DataFrame:
    """The track's observation nearest to `t` (the earlier of two), its columns under new names. Rows of tracks without observations go."""
    seen = obs.select(*TRACK, F.col("t").alias("_t"), *[F.col(c).alias(n) for n, c in columns.items()])
    return asof(rows, seen, TRACK, t, "_t").where("_t IS NOT NULL").select(*rows.columns, *columns)


def lane_road(ctx: Context, x, y):
    """On a carriageway (if any is drawn), and neither in the junction nor on a crossing."""
    layout = ctx.layout
    ok = any_of([inside(x, y, polygon(c["poly"])) for c in layout.carriageways]) if layout.carriageways else F.lit(True)
    if layout.intersection:
        ok = ok & ~inside(x, y, polygon(layout.intersection))
    return ok & ~any_of([inside(x, y, polygon(p)) for p in layout.crossings])


def against_traffic(ctx: Context, least_votes: float = 15, most_share: float = 0.04, least_speed: float = 0.4) -> DataFrame:
    """Vehicle observations with `against`: hardly anyone moves there as this one does."""
    share = S.direction_share(ctx.votes).withColumnRenamed("share", "way_share")
    rows = ctx.vehicles.withColumn("b", heading_bin(F.col("vx"), F.col("vy"))).join(share, ["video_id", "r", "c", "b"], "left")
    votes, part = F.coalesce("votes", F.lit(0.0)), F.coalesce("way_share", F.lit(0.0))
    against = (F.col("rel_speed") >= least_speed) & (votes >= least_votes) & (part <= most_share) & lane_road(ctx, F.col("x"), F.col("y"))
    return rows.withColumn("against", against)


@rule("wrong_way")
def wrong_way(ctx: Context, least_seconds: float = 2.5, least_sizes: float = 2.0) -> DataFrame:
    """Runs against the traffic over a real distance; a run that ends within a second of its track lasts to its end."""
    rows = against_traffic(ctx)
    found = runs(rows, TRACK, "t", "against", 1.0).where(F.col("end") - F.col("start") >= least_seconds).select(*TRACK, "start", "end")
    found = at_time(at_time(found, ctx.vehicles, "start", x0="x", y0="y"), ctx.vehicles, "end", x1="x", y1="y")
    within = found.join(ctx.vehicles.select(*TRACK, "t", "size"), TRACK).where(F.col("t").between(F.col("start"), F.col("end")))
    sized = within.groupBy(*found.columns).agg(F.percentile("size", 0.5).alias("size"))
    far = sized.where(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= least_sizes * F.col("size"))
    ended = far.join(track_ends(ctx.vehicles), TRACK).withColumn("end", F.when(F.col("track_end") - F.col("end") < 1.0, F.col("track_end")).otherwise(F.col("end")))
    return events(ended, "wrong_way")


def seconds(videos: DataFrame, step: float = 1.0) -> DataFrame:
    """The instants 0, step, ... of each video."""
    return videos.select("video_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration") / step).cast("int"))).alias("k")).select("video_id", (F.col("k") * step).alias("at"))


def active(obs: DataFrame, videos: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Tracks at each whole second while they last: (video_id, tid, kind, at). Seconds come from each track's own span."""
    spans = obs.groupBy(*TRACK, "kind").agg(F.min("t").alias("a"), F.max("t").alias("b")).join(videos.select("video_id", "duration"), "video_id")
    first, last = F.greatest(F.ceil(F.col("a") - tolerance), F.lit(0)), F.least(F.floor(F.col("b") + tolerance), F.floor(F.col("duration")))
    return spans.where(first <= last).select(*TRACK, "kind", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("at")).withColumn("at", F.col("at").cast("double"))


@rule("congestion")
def congestion(ctx: Context, least: int = 6, slow: float = 0.25, share: float = 0.7) -> DataFrame:
    """Seconds in which at least `least` vehicles of one direction are there and 70 % of them are slow; long runs of such seconds."""
    on_road = ctx.vehicles.join(S.driven(ctx.grid), ["video_id", "r", "c"], "left_semi")
    way = S.dominant_direction(ctx.votes).select("video_id", "r", "c", "direction")
    there = at_time(active(on_road, ctx.videos), on_road, "at", rel="rel_speed", r="r", c="c")
    grouped = there.join(way, ["video_id", "r", "c"], "left").withColumn("direction", F.coalesce("direction", F.lit(0)))
    full = grouped.groupBy("video_id", "direction", "at").agg(F.count("*").alias("n"), F.avg((F.col("rel") < slow).cast("double")).alias("p")).where((F.col("n") >= least) & (F.col("p") >= share))
    found = runs(full, ["video_id", "direction"], "at", "true", 3.0).withColumn("end", F.col("end") + 1.0)
    return events(found, "congestion", F.array().cast("array<bigint>"))
