"""Signal states from lamp scores: Otsu's threshold per lamp, and phases without flicker."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_PHASE = 5.0
#: The share of a lamp box's pixels under its score, and the pixels of a tile's side.
LIT_SHARE, TILE = 0.97, 64


def split(values: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Values as 256 steps of their range, and the last step of the lower part when they are split best; None for few values or a small range."""
    if len(values) < 10 or np.ptp(values) < 8:
        return None
    q = ((values - values.min()) / np.ptp(values) * 255).astype(int)
    n = np.bincount(q, minlength=256).astype(float)
    w, s = n.cumsum(), (n * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[-1] * w - s * w[-1]) ** 2 / (w * (w[-1] - w))
    return q, int(np.argmax(np.where(np.isfinite(between), between, -1)))


def otsu(values: np.ndarray) -> float | None:
    """The threshold that splits values best, as a value: where the lower part's last step begins."""
    found = split(values)
    return None if found is None else float(values.min() + found[1] / 255 * np.ptp(values))


def lit(values: np.ndarray) -> np.ndarray | None:
    """Which values lie above the best split's last lower step; None as in `split`."""
    found = split(values)
    return None if found is None else found[0] > found[1]


def least_phases(t: np.ndarray, on: np.ndarray, least: float = LEAST_PHASE) -> np.ndarray:
    """Flips the shortest inner run under `least` seconds, from its first sample to its last (the first of equals), until there is none."""
    on = on.copy()
    while len(on):
        starts = np.flatnonzero(np.append(True, on[1:] != on[:-1]))
        if len(starts) < 3:
            break
        length = t[starts[2:] - 1] - t[starts[1:-1]]
        k = int(np.argmin(length))
        if length[k] >= least:
            break
        on[starts[k + 1] : starts[k + 2]] ^= True
    return on


def classify(rows: pd.DataFrame) -> pd.DataFrame:
    """One signal's states from its scores (video_id, signal, lamp, t, score): red and not green; nothing if red can't be told."""
    red = rows[rows.lamp == "red"].sort_values("t")
    on = lit(red.score.to_numpy(float))
    if on is None:
        return pd.DataFrame({"video_id": pd.Series(dtype=str), "signal": pd.Series(dtype=str), "t": pd.Series(dtype=float), "red": pd.Series(dtype=bool)})
    green = rows[rows.lamp == "green"].sort_values("t")
    other = lit(green.score.to_numpy(float))
    if other is not None and len(green) == len(red):
        on = on & ~other
    return pd.DataFrame({"video_id": red.video_id, "signal": red.signal, "t": red.t, "red": least_phases(red.t.to_numpy(float), on)})


def signal_states(scores: DataFrame) -> DataFrame:
    """(video_id, signal, t, red) of all signals; groups are one signal's samples in one video."""
    return scores.groupBy("video_id", "signal").applyInPandas(lambda rows: classify(rows), "video_id string, signal string, t double, red boolean")


def red_since(states: DataFrame) -> DataFrame:
    """Adds red_for: how long the signal has been red at each sample."""
    from pyspark.sql.window import Window

    own = Window.partitionBy("video_id", "signal").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    off = F.last(F.when(~F.col("red"), F.col("t")), ignorenulls=True).over(own)
    return states.withColumn("red_for", F.when(F.col("red"), F.col("t") - F.coalesce(off, F.first("t").over(own))).otherwise(0.0))


def lamp_scores(pixels: DataFrame, boxes: DataFrame, side: int = TILE) -> DataFrame:
    """video_id, signal, lamp, t and score of each lamp in each frame: how strong its colour is in its box.

    pixels: video_id, t, px, py, red, green, blue (0 to 255; of the boxes' resolution, such as sources.layouts.placed_lamps gives);
    boxes: video_id, signal, lamp, x1, y1, x2, y2 (x2 and y2 outside). The colour is red less the larger of the others, or
    green less red, nothing below 0; the score is its 97th percentile, 0 for a box without pixels. Pixels meet boxes by tiles, and a
    box's pixels are counted by value first, so a group has 256 rows at most.
    """
    frames = pixels.select("video_id", "t").distinct()
    tiles = lambda a, b: F.sequence(F.floor(F.greatest(F.col(a), F.lit(0)) / side).cast("int"), F.floor(F.greatest(F.col(b) - 1, F.lit(0)) / side).cast("int"))
    real = boxes.where((F.col("x2") > F.greatest(F.col("x1"), F.lit(0))) & (F.col("y2") > F.greatest(F.col("y1"), F.lit(0))))
    dealt = real.withColumn("_tx", F.explode(tiles("x1", "x2"))).withColumn("_ty", F.explode(tiles("y1", "y2")))
    placed = pixels.withColumn("_tx", F.floor(F.col("px") / side).cast("int")).withColumn("_ty", F.floor(F.col("py") / side).cast("int"))
    met = placed.join(dealt, ["video_id", "_tx", "_ty"]).where((F.col("px") >= F.col("x1")) & (F.col("px") < F.col("x2")) & (F.col("py") >= F.col("y1")) & (F.col("py") < F.col("y2")))
    colour = F.when(F.col("lamp") == "red", F.col("red") - F.greatest("green", "blue")).otherwise(F.col("green") - F.col("red"))
    counts = met.select("video_id", "signal", "lamp", "t", F.greatest(colour, F.lit(0)).alias("v")).groupBy("video_id", "signal", "lamp", "t", "v").agg(F.count("*").alias("n"))
    scores = counts.groupBy("video_id", "signal", "lamp", "t").agg(F.percentile("v", LIT_SHARE, F.col("n")).alias("score"))
    every = frames.join(boxes.select("video_id", "signal", "lamp").distinct(), "video_id")
    return every.join(scores, ["video_id", "signal", "lamp", "t"], "left").na.fill(0.0, ["score"])
