"""Rules on things that stand or burn: stopped_vehicle, road_obstacle, fire_smoke."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.functions.geometry import area, inside_fraction, iou
from kerbside.operators import scene as S
from kerbside.operators.sequences import runs
from kerbside.rules import Context, events, rule
from kerbside.rules.flow import TRACK
from kerbside.rules.pedestrians import BOX, on_road

STILL = "video_id string, start double, end double, x double, y double, size double, moved boolean, tids array<bigint>"


def chain_stops(stops: pd.DataFrame, most_gap: float = 6.0, most_distance: float = 0.5) -> pd.DataFrame:
    """Joins a video's stops, in the order of their starts, to the first chain at the same place; a chain's place never moves."""
    chains: list[dict] = []
    for s in stops.sort_values(["start", "tid"]).to_dict("records"):
        for c in chains:
            if np.hypot(s["x"] - c["x"], s["y"] - c["y"]) < most_distance * max(c["size"], s["size"]) and -1.0 <= s["start"] - c["end"] <= most_gap:
                c["end"] = max(c["end"], s["end"])
                c["tids"].add(s["tid"])
                break
        else:
            chains.append(s | {"tids": {s["tid"]}})
    names = ["video_id", "start", "end", "x", "y", "size", "moved", "tids"]
    return pd.DataFrame([{k: sorted(c[k]) if k == "tids" else c[k] for k in names} for c in chains], columns=names)


def stops(ctx: Context, slow: float = 0.08, moving: float = 0.4, rate: float = 10.0) -> DataFrame:
    """Times in which a vehicle stands: its mean place, median size, and whether it had moved for a second before."""
    own = Window.partitionBy(*TRACK).orderBy("t")
    rows = ctx.vehicles.withColumn("_moved", F.sum((F.col("rel_speed") >= moving).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs(rows, TRACK, "t", F.col("rel_speed") < slow, 1.0).select(*TRACK, "start", "end")
    within = found.join(rows.select(*TRACK, "t", "x", "y", "size", "_moved"), TRACK).where(F.col("t").between(F.col("start"), F.col("end")))
    return within.groupBy(*TRACK, "start", "end").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.percentile("size", 0.5).alias("size"), (F.min_by("_moved", "t") / rate >= 1.0).alias("moved"))


@rule("stopped_vehicle")
def stopped_vehicle(ctx: Context, least_seconds: float = 10.0, neighbour: float = 2.5) -> DataFrame:
    """A vehicle that had moved stands on the road, and not in a queue with others."""
    # a video's stops: of the vehicles that stood there
    chains = stops(ctx).groupBy("video_id").applyInPandas(lambda found: chain_stops(found), STILL)
    chains = S.with_cells(chains, ctx.width, ctx.height).withColumn("id", F.xxhash64("video_id", "start", "x", "y", "tids"))
    long = chains.where((F.col("end") - F.col("start") >= least_seconds) & F.col("moved")).join(S.road(ctx.grid), ["video_id", "r", "c"], "left_semi")
    other = chains.select("video_id", *[F.col(c).alias(f"o_{c}") for c in ("start", "end", "x", "y", "id")])
    queueing = long.join(S.queue_zone(ctx.grid), ["video_id", "r", "c"], "left_semi").join(other, "video_id")
    beside = (F.col("o_id") != F.col("id")) & (F.hypot(F.col("o_x") - F.col("x"), F.col("o_y") - F.col("y")) < neighbour * F.col("size"))
    together = F.least("o_end", "end") - F.greatest("o_start", "start") > 0.5 * (F.col("end") - F.col("start"))
    queued = queueing.where(beside & together).select("id").distinct()
    alone = long.join(queued, "id", "left_anti").join(ctx.videos.select("video_id", "duration"), "video_id")
    return events(alone.withColumn("end", F.when(F.col("duration") - F.col("end") < 1.5, F.col("duration")).otherwise(F.col("end"))), "stopped_vehicle", F.col("tids"))


@rule("road_obstacle")
def road_obstacle(ctx: Context, least_seconds: float = 5.0, before: float = 4.0) -> DataFrame:
    """Animals on the road for a second or more, and lasting changes of the picture there."""
    animals = on_road(ctx, ctx.cells.where("kind = 'animal'"))
    found = events(runs(animals, TRACK, "t", "on_road", 1.0).where(F.col("end") - F.col("start") >= 1.0), "road_obstacle")
    if ctx.pixels is None:
        return found
    lasting = runs(changed_frames(ctx), ["video_id"], "t", F.lit(True), 3.0).where(F.col("end") - F.col("start") >= least_seconds)
    return found.unionByName(events(lasting.withColumn("start", F.greatest(F.lit(0.0), F.col("start") - before)), "road_obstacle", F.array().cast("array<bigint>")))


def around(picture: np.ndarray, f: np.ufunc, beyond) -> np.ndarray:
    """f over each pixel's 3 x 3 neighbourhood; `beyond` stands outside the picture."""
    height, width = picture.shape
    wide = np.pad(picture, 1, constant_values=beyond)
    return f.reduce([wide[y : y + height, x : x + width] for y in range(3) for x in range(3)])


def has_blob(pixels: set[tuple[int, int]], width: int, height: int, least: float, most: float) -> bool:
    """Whether, after an opening by 3 x 3, a connected part covers a share between `least` and `most` of the picture."""
    on = np.zeros((height, width), bool)
    x, y = np.array([*pixels], int).reshape(-1, 2).T
    on[y, x] = True
    on = around(around(on, np.logical_and, True), np.logical_or, False)
    nobody = width * height
    label = np.where(on, np.arange(nobody).reshape(height, width), nobody)
    while True:  # each part's least place spreads: to the neighbours, and to whoever has a neighbour's place
        new = np.where(on, around(label, np.minimum, nobody), nobody)
        new = np.where(on, np.append(new.ravel(), nobody)[new], nobody)
        if (new == label).all():
            break
        label = new
    sizes = np.unique(label[on], return_counts=True)[1] / (width * height)
    return bool(((sizes >= least) & (sizes <= most)).any())


def changed_frames(ctx: Context, threshold: float = 28.0, window: int = 8, least: float = 0.0006, most: float = 0.05, light: float = 0.15) -> DataFrame:
    """Frames (video_id, t) whose last `window` + 1 frames differ from the whole video by a blob on the road, away from users.

    Not judged are videos of under 2 * window frames and times whose mean brightness is more than `light` off the video's typical one.
    """
    pixels, w, h = ctx.pixels
    own, image = Window.partitionBy("video_id", "px", "py").orderBy("t"), lambda *keys: Window.partitionBy("video_id", *keys)
    norm = lambda c, over: (F.col(c) - F.avg(c).over(over)) / (F.stddev_pop(c).over(over) + 1e-6) * 40 + 128
    luma = pixels.groupBy("video_id", "t").agg(F.avg("gray").alias("luma"))
    frames = image().orderBy("t")
    luma = luma.withColumns({"i": F.row_number().over(frames), "n": F.count("*").over(image()), "now": F.avg("luma").over(frames.rowsBetween(-window, 0)), "typical": F.percentile("luma", F.lit(0.5)).over(image())})
    judged = luma.where((F.col("i") > window) & (F.col("n") >= 2 * window) & (F.abs(F.col("now") - F.col("typical")) <= light * F.col("typical"))).select("video_id", "t")
    whole = pixels.groupBy("video_id", "px", "py").agg(F.percentile("gray", F.lit(0.5)).alias("g")).withColumn("ref", norm("g", image())).drop("g")
    short = pixels.withColumn("g", F.percentile("gray", F.lit(0.5)).over(own.rowsBetween(-window, 0))).join(judged, ["video_id", "t"]).withColumn("short", norm("g", image("t")))
    moved = short.join(whole, ["video_id", "px", "py"]).where(F.abs(F.col("short") - F.col("ref")) > threshold).select("video_id", "t", "px", "py")
    placed = moved.withColumn("x", F.col("px") * (ctx.width / w)).withColumn("y", F.col("py") * (ctx.height / h))
    there = on_road(ctx, S.with_cells(placed, ctx.width, ctx.height)).where("on_road").select("video_id", "t", "px", "py").withColumn("_slot", F.floor(F.col("t") / window))
    users = ctx.obs.select("video_id", F.col("t").alias("ut"), *[(F.col(c) * k).cast("int").alias(f"u{c}") for c, k in zip(BOX, (w / ctx.width, h / ctx.height) * 2, strict=True)])
    users = users.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("ut") / window) - 1, F.floor(F.col("ut") / window) + 1)))
    covered = (F.abs(F.col("t") - F.col("ut")) <= window) & F.col("px").between(F.col("ux1"), F.col("ux2")) & F.col("py").between(F.col("uy1"), F.col("uy2"))
    free = there.join(users.withColumnsRenamed({"video_id": "_v", "_slot": "_s"}), (F.col("video_id") == F.col("_v")) & (F.col("_slot") == F.col("_s")) & covered, "left_anti")

    def blobs(frame: pd.DataFrame) -> pd.DataFrame:
        hit = has_blob(set(zip(frame.px.tolist(), frame.py.tolist(), strict=True)), w, h, least, most)
        return frame.loc[:, ["video_id", "t"]].head(int(hit))

    # a group is one picture
    return free.groupBy("video_id", "t").applyInPandas(blobs, "video_id string, t double")


@rule("fire_smoke")
def fire_smoke(ctx: Context, confidence: float = 0.6, areas: tuple[float, float] = (0.001, 0.5), least_seconds: float = 3.0) -> DataFrame:
    """Fire or smoke boxes seen in 3 of the last 4 samples at about the same place."""
    if ctx.fire is None:
        return ctx.empty()
    samples, boxes = ctx.fire
    box = [F.col(c).cast("double") for c in BOX]
    share = area(box) / (ctx.width * ctx.height)
    fit = boxes.where((F.col("conf") >= confidence) & share.between(*areas) & F.col("cls").isin(0, 1)).select("video_id", "t", "cls", *[x.alias(c) for x, c in zip(box, BOX, strict=True)])
    # fire on a vehicle is its lights
    v = ctx.vehicles.select("video_id", F.col("t").alias("vt"), *[F.col(c).cast("double").alias(f"v{c}") for c in BOX])
    lit = fit.where("cls = 0").join(v, "video_id").where(F.abs(F.col("t") - F.col("vt")) <= 0.5).where(inside_fraction([F.col(c) for c in BOX], [F.col(f"v{c}") for c in BOX]) >= 0.5).select("video_id", "t", "cls", *BOX).distinct()
    fit = fit.join(lit, ["video_id", "t", "cls", *BOX], "left_anti")
    own = Window.partitionBy("video_id").orderBy("t")
    numbered = samples.select("video_id", "t").withColumn("k", F.row_number().over(own)).withColumn("step", F.col("t") - F.lag("t").over(own))
    now = fit.join(numbered.select("video_id", "t", "k"), ["video_id", "t"])
    past = now.select("video_id", "cls", F.col("k").alias("pk"), *[F.col(c).alias(f"p{c}") for c in BOX])
    seen = now.join(past, ["video_id", "cls"]).where((F.col("pk") <= F.col("k")) & (F.col("pk") >= F.col("k") - 3) & (iou([F.col(c) for c in BOX], [F.col(f"p{c}") for c in BOX]) > 0.05))
    burning = seen.groupBy("video_id", "t", "cls").agg(F.count_distinct("pk").alias("n")).where("n >= 3").select("video_id", "t").distinct()
    step = numbered.groupBy("video_id").agg(F.coalesce(F.percentile("step", 0.5), F.lit(1.0)).alias("step"))
    flagged = burning.join(step, "video_id").withColumn("_gap", F.col("step") * 3)
    gap = F.coalesce((F.col("t") - F.lag("t").over(own) > F.col("_gap")).cast("int"), F.lit(1))
    found = flagged.withColumn("_run", gap).withColumn("_run", F.sum("_run").over(own)).groupBy("video_id", "_run", "step").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    found = found.join(ctx.videos.select("video_id", "duration"), "video_id").withColumn("start", F.greatest(F.lit(0.0), F.col("start") - 2 * F.col("step")))
    found = found.withColumn("end", F.when(F.col("duration") - F.col("end") < 2 * F.col("step"), F.col("duration")).otherwise(F.col("end")))
    return events(found.where(F.col("end") - F.col("start") >= least_seconds), "fire_smoke", F.array().cast("array<bigint>"))
