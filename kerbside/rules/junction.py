"""Rules on zones and lines drawn in the scene: U-turns, turns, markings, red lights, stop lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.functions.geometry import any_of, inside, polygon, polyline_side, signed_side, within_extent
from kerbside.operators.sequences import enter_leave, runs
from kerbside.operators.temporal import asof
from kerbside.rules import Context, events, rule
from kerbside.rules.flow import TRACK, at_time, track_ends


def passes(ctx: Context, rows: DataFrame, poly, least_seconds: float = 0.0) -> DataFrame:
    found = enter_leave(rows.withColumn("_in", inside(F.col("x"), F.col("y"), polygon(poly))), TRACK, "t", "_in")
    return found.where(F.col("end") - F.col("start") >= least_seconds).select(*TRACK, "start", "end")


def first_of_track(df: DataFrame, *order: str) -> DataFrame:
    own = Window.partitionBy(*TRACK).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")


@rule("illegal_u_turn")
def u_turn(ctx: Context, least_speed: float = 0.3, most_gap: float = 25.0, most_cosine: float = -0.5) -> DataFrame:
    """A pass over one carriageway, then over another in about the opposite direction, not where U-turns are allowed."""
    layout, v = ctx.layout, ctx.vehicles
    if len(layout.carriageways) < 2:
        return ctx.empty()
    parts = [passes(ctx, v, c["poly"], 1.0).withColumn("name", F.lit(c["name"])) for c in layout.carriageways]
    moving = v.where(F.col("rel_speed") >= least_speed).select(*TRACK, "t", "vx", "vy")
    mean = reduce(DataFrame.unionByName, parts).join(moving, TRACK).where(F.col("t").between(F.col("start"), F.col("end"))).groupBy(*TRACK, "name", "start", "end").agg(F.count("*").alias("n"), F.avg("vx").alias("vx"), F.avg("vy").alias("vy"))
    mean = mean.where((F.col("n") >= 3) & (F.hypot("vx", "vy") >= 1e-6))
    a, b = (mean.select(*TRACK, *[F.col(c).alias(f"{c}_{s}") for c in ("name", "start", "end", "vx", "vy")]) for s in "ab")
    cosine = (F.col("vx_a") * F.col("vx_b") + F.col("vy_a") * F.col("vy_b")) / (F.hypot("vx_a", "vy_a") * F.hypot("vx_b", "vy_b"))
    pairs = a.join(b, TRACK).where((F.col("name_a") != F.col("name_b")) & (F.col("start_b") - F.col("end_a")).between(0.0, most_gap) & (cosine <= most_cosine))
    turned = pairs.withColumn("middle", (F.col("end_a") + F.col("start_b")) / 2)
    turned = at_time(turned.select(*TRACK, "start_a", "end_a", "start_b", "middle"), v, "middle", mx="x", my="y")
    turned = turned.where(~any_of([inside(F.col("mx"), F.col("my"), polygon(p)) for p in layout.u_turn_allowed]))
    found = first_of_track(turned, "start_a", "start_b").join(track_ends(v), TRACK)
    return events(found.withColumn("start", F.col("end_a")).withColumn("end", F.least(F.col("start_b") + 1.0, F.col("track_end"))), "illegal_u_turn")


@rule("illegal_turn")
def illegal_turn(ctx: Context, within: float = 20.0, lasts: float = 2.0) -> DataFrame:
    """Leaving one zone and entering the other of a prohibited move within 20 s; the first time of each track and move."""
    parts = []
    for move in ctx.layout.prohibited_turns:
        a = passes(ctx, ctx.vehicles, move["from"]).select(*TRACK, F.col("end").alias("left"))
        b = passes(ctx, ctx.vehicles, move["to"]).select(*TRACK, F.col("start").alias("entered"), F.col("end").alias("gone"))
        pairs = a.join(b, TRACK).where(F.col("entered").between(F.col("left"), F.col("left") + within))
        parts.append(first_of_track(pairs, "left", "entered").withColumn("start", F.col("left")).withColumn("end", F.least("gone", F.col("entered") + lasts)))
    return events(reduce(DataFrame.unionByName, parts), "illegal_turn") if parts else ctx.empty()


def line_crossings(rows: DataFrame, side: str, valid) -> DataFrame:
    """Changes of the side's sign between successive valid samples, with the interpolated time, and size and speed of the nearer sample."""
    own = Window.partitionBy(*TRACK).orderBy("t")
    r = rows.where(valid).withColumns({"s1": F.lead(side).over(own), "t1": F.lead("t").over(own), "size1": F.lead("size").over(own), "speed1": F.lead("speed").over(own)})
    hit = r.where((F.col(side) != 0) & (F.signum(side) != F.signum("s1")))
    hit = hit.withColumn("at", F.col("t") + (F.col("t1") - F.col("t")) * F.try_divide(F.col(side), F.col(side) - F.col("s1"))).withColumn("new_sign", F.signum("s1").cast("int"))
    before = F.col("at") - F.col("t") <= F.col("t1") - F.col("at")
    return hit.withColumns({"size_at": F.when(before, F.col("size")).otherwise(F.col("size1")), "speed_at": F.when(before, F.col("speed")).otherwise(F.col("speed1"))})


@rule("solid_line_crossing")
def solid_line(ctx: Context, most_seconds: float = 8.0) -> DataFrame:
    """From where the box begins to cross a solid line until it has crossed by half its width."""
    parts = []
    for line in ctx.layout.solid_lines:
        rows = ctx.vehicles.withColumn("p", polyline_side(F.col("x"), F.col("y"), line)).withColumn("side", F.col("p.side"))
        hits = line_crossings(rows, "side", F.col("p.on")).select(*TRACK, "at", "new_sign", "size", "speed")
        half = 0.25 * F.col("size")
        hits = hits.withColumn("half", half).withColumn("start", F.greatest(F.lit(0.0), F.col("at") - half / F.greatest("speed", F.lit(1.0))))
        later = hits.join(rows.select(*TRACK, "t", F.col("side").alias("later_side")), TRACK)
        past = F.when((F.col("t") > F.col("at")) & (F.col("later_side") * F.col("new_sign") >= F.col("half")), F.col("t"))
        ended = later.groupBy(*hits.columns).agg(F.min(past).alias("past")).join(track_ends(ctx.vehicles), TRACK)
        end = F.coalesce("past", F.least("track_end", F.col("at") + F.col("half") / F.greatest("speed", F.lit(1.0))))
        parts.append(ended.withColumn("end", F.least(end, F.col("start") + most_seconds)))
    return events(reduce(DataFrame.unionByName, parts), "solid_line_crossing") if parts else ctx.empty()


def with_signal(rows: DataFrame, signals: DataFrame, signal: str, at: str) -> DataFrame:
    """Adds red, red_for and green_at of a signal at the time `at`.

    The state is that of the first sample at or after the time (the last one, if there is none); red_for counts from
    the last sample up to it that isn't red; green_at is the first such sample at or after the time.
    """
    s = signals.where(F.col("signal") == signal).select("video_id", F.col("t").alias("_t"), F.col("red").alias("red"))
    own = Window.partitionBy("video_id").orderBy("_t")
    off = F.when(~F.col("red"), F.col("_t"))
    s = s.withColumn("_off", F.coalesce(F.last(off, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.min("_t").over(Window.partitionBy("video_id"))))
    s = s.withColumn("_green", F.first(off, ignorenulls=True).over(own.rowsBetween(0, Window.unboundedFollowing))).withColumn("_here", F.col("_t")).drop("_t")
    found = asof(rows, s, ["video_id"], at, "_here", "forward", clamp=True).where("red IS NOT NULL")
    found = found.withColumn("red_for", F.when(F.col("red"), F.col(at) - F.col("_off")).otherwise(0.0))
    # after the last sample there is no next green
    return found.withColumn("green_at", F.when(F.col("_here") >= F.col(at), F.col("_green"))).drop("_off", "_green", "_here")


def stop_line_sides(rows: DataFrame, line: dict) -> DataFrame:
    """Adds past (how far beyond the line, in the direction of travel) and extent."""
    a, b = line["a"], line["b"]
    margin = 10.0 / max(1e-9, ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5)
    side = signed_side(F.col("x"), F.col("y"), a, b)
    return rows.withColumn("past", side * (-line["approach_sign"])).withColumn("extent", within_extent(F.col("x"), F.col("y"), a, b, margin))


def line_passes(ctx: Context, line: dict) -> DataFrame:
    """Forward crossings of a stop line with the signal's state when the vehicle's front crosses."""
    rows = stop_line_sides(ctx.vehicles, line)
    hits = line_crossings(rows, "past", F.col("extent")).where("past < 0 and speed_at >= 20")
    hits = hits.select(*TRACK, "at", (F.col("at") - 0.5 * F.col("size_at") * 0.7 / F.greatest("speed_at", F.lit(1.0))).alias("front"))
    return with_signal(hits, ctx.signals, line["signal"], "front")


def distrusted(found: DataFrame, least_passes: int = 8, most_red: float = 0.25, red_for: float = 1.0) -> DataFrame:
    """Videos in which a signal is contradicted by drivers: of many passes, over a quarter when it has been red for a second."""
    n = found.groupBy("video_id").agg(F.count("*").alias("n"), F.avg((F.col("red_for") >= red_for).cast("double")).alias("p"))
    return n.where((F.col("n") >= least_passes) & (F.col("p") > most_red)).select("video_id")


@rule("red_light")
def red_light(ctx: Context, red_for: float = 1.0, to_green: float = 2.0, most_seconds: float = 20.0) -> DataFrame:
    if ctx.signals is None:
        return ctx.empty()
    parts = []
    for line in ctx.layout.stop_lines:
        found = line_passes(ctx, line)
        found = found.join(distrusted(found), "video_id", "left_anti")
        ran = found.where((F.col("red_for") >= red_for) & (F.col("green_at").isNull() | (F.col("green_at") - F.col("front") >= to_green)))
        rows = ran.join(track_ends(ctx.vehicles), TRACK)
        end = F.least("track_end", F.col("at") + most_seconds)
        if ctx.layout.intersection:
            zone = ctx.vehicles.withColumn("_in", inside(F.col("x"), F.col("y"), polygon(ctx.layout.intersection))).select(*TRACK, "t", "_in")
            near = rows.join(zone, TRACK).where(F.col("t") >= F.col("at"))
            entered = near.groupBy(*TRACK, "at").agg(F.min(F.when(F.col("_in"), F.col("t"))).alias("entered"))
            left = near.join(entered, [*TRACK, "at"]).where((F.col("t") > F.col("entered")) & ~F.col("_in")).groupBy(*TRACK, "at").agg(F.min("t").alias("exit"))
            rows = rows.join(left, [*TRACK, "at"], "left")
            end = F.coalesce("exit", end)
        parts.append(rows.withColumn("start", F.greatest(F.lit(0.0), F.col("front"))).withColumn("end", end))
    return reduce(DataFrame.unionByName, [events(p, "red_light") for p in parts]) if parts else ctx.empty()


@rule("stop_line")
def stop_line(ctx: Context, slow: float = 0.08, least_seconds: float = 2.0, most_seconds: float = 120.0) -> DataFrame:
    """Standing beyond a stop line on red, outside the junction."""
    if ctx.signals is None:
        return ctx.empty()
    parts = []
    for line in ctx.layout.stop_lines:
        rows = stop_line_sides(ctx.vehicles, line)
        beyond = (F.col("past") > 0) & (F.col("past") < 1.5 * F.col("size")) & F.col("extent") & (F.col("rel_speed") < slow)
        if ctx.layout.intersection:
            beyond = beyond & ~inside(F.col("x"), F.col("y"), polygon(ctx.layout.intersection))
        found = runs(rows.withColumn("_beyond", beyond), TRACK, "t", "_beyond", 0.5).where(F.col("end") - F.col("start") >= least_seconds).select(*TRACK, "start", "end")
        known = with_signal(found, ctx.signals, line["signal"], "start").where("red")
        known = known.join(distrusted(line_passes(ctx, line)), "video_id", "left_anti").join(ctx.videos.select("video_id", "duration"), "video_id")
        parts.append(known.withColumn("end", F.least(F.coalesce("green_at", "duration"), F.col("start") + most_seconds)))
    return reduce(DataFrame.unionByName, [events(p, "stop_line") for p in parts]) if parts else ctx.empty()
