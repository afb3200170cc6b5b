"""Noise and survival, lamp scores, recall and alarms by image, overlays and other risk settings against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import images as I
from kerbside.operators import overlay as O
from kerbside.operators import risk as R
from kerbside.operators import stability as N
from kerbside.operators.kinematics import ground
from kerbside.operators.signals import lamp_scores, signal_states

BOX = "video_id string, tid bigint, t_us bigint, x1 double, y1 double, x2 double, y2 double, conf double"


def test_noise_is_fixed_by_the_row(spark):
    rows = [("v", i % 5, i * 100_000, 100.0, 50.0, 180.0, 100.0, 0.9) for i in range(2000)] + [("v", None, 1, None, None, None, None, None)]
    df = spark.createDataFrame(rows, BOX)
    key = lambda r: (r["run"], r["tid"] or -1, r["t_us"])
    one, two = (sorted(N.noisy_runs(x, 3, "tid", "t_us").collect(), key=key) for x in (df, df.repartition(7).orderBy(F.desc("t_us"))))
    assert one == two and len(one) == 4 * len(rows)
    assert all(r["x1"] == 100.0 and r["conf"] == 0.9 for r in one if r["run"] == 0 and r["conf"])
    for name, size, sigma in (("x1", 80, 0.01), ("y2", 50, 0.01), ("conf", 1, 0.02)):
        d = np.array([(r[name] - {"x1": 100, "y2": 100, "conf": 0.9}[name]) / size for r in one if r["run"] and r["conf"]])
        assert abs(d.mean()) < sigma / 15 and abs(d.std() / sigma - 1) < 0.04
    runs = [[r["x1"] for r in one if r["run"] == k and r["conf"]] for k in (1, 2)]
    assert abs(np.corrcoef(*runs)[0, 1]) < 0.1
    assert N.noisy_runs(df.withColumn("conf", F.lit(0.25)), 1, "tid", "t_us").where("run = 1").count() < 1200


def test_survival(spark):
    schema = "video_id string, run int, label string, start double, end double"
    base = [("v", 0, "a", 0.0, 10.0), ("v", 0, "a", 100.0, 101.0), ("w", 0, "b", 5.0, 9.0)]
    noisy = [("v", 1, "a", 3.0, 10.0), ("v", 2, "a", 8.0, 20.0), ("v", 2, "b", 0.0, 10.0), ("v", 1, "a", 0.0, 9.0), ("w", 1, "b", 5.0, 9.0), ("w", 2, "b", 5.5, 9.0), ("w", 2, "b", 200.0, 201.0)]
    kept, extra = N.survival(spark.createDataFrame(base + noisy, schema), 2)
    assert sorted((r["video_id"], r["start"], r["survival"]) for r in kept.collect()) == [("v", 0.0, 0.5), ("v", 100.0, 0.0), ("w", 5.0, 1.0)]
    assert sorted((r["video_id"], r["label"], r["start"]) for r in extra.collect()) == [("v", "a", 8.0), ("v", "b", 0.0), ("w", "b", 200.0)]
    table = {r["label"]: tuple(r)[1:] for r in N.stability(spark.createDataFrame(base + noisy, schema), 2).collect()}
    assert table == {"a": (2, 0.25, 2, 0.5), "b": (1, 1.0, 0, 1.0)}


def test_lamp_scores_and_states(spark):
    rng = np.random.default_rng(1)
    pixels, frames = [], {}
    for t in range(60):
        picture = rng.integers(0, 90, (40, 150, 3))
        picture[5:15, 100:110] = (230, 40, 30) if t // 20 % 2 == 0 else (60, 50, 40)
        picture[20:30, 100:110] = (40, 220, 60) if t // 20 % 2 else (50, 60, 40)
        frames[t] = picture
        pixels += [("v", float(t), x, y, *map(int, picture[y, x])) for y in range(0, 40) for x in range(95, 150)] if t % 1 == 0 else []
    boxes = [("v", "main", "red", 98, 3, 112, 17), ("v", "main", "green", 98, 18, 112, 32), ("v", "edge", "red", 140, -9, 400, 6), ("v", "none", "red", 120, 10, 120, 20)]
    table = spark.createDataFrame(pixels, "video_id string, t double, px int, py int, red int, green int, blue int").repartition(4).cache()
    scores = lamp_scores(table, spark.createDataFrame(boxes, "video_id string, signal string, lamp string, x1 int, y1 int, x2 int, y2 int"), 16)
    got = {(r["signal"], r["lamp"], r["t"]): r["score"] for r in scores.collect()}
    assert len(got) == 4 * 60
    for _, signal, lamp, x1, y1, x2, y2 in boxes:
        for t, picture in frames.items():
            crop = picture[max(y1, 0) : y2, max(x1, 0) : x2]
            colour = crop[..., 0] - crop[..., 1:].max(2) if lamp == "red" else crop[..., 1] - crop[..., 0]
            assert got[signal, lamp, float(t)] == pytest.approx(np.percentile(np.clip(colour, 0, None), 97) if colour.size else 0.0)
    states = {r["t"]: r["red"] for r in signal_states(scores.where("signal = 'main'")).collect()}
    assert [states[float(t)] for t in (0, 19, 20, 39, 40, 59)] == [True, True, False, False, True, True]


def test_image_recall_and_false_alarms(spark):
    rng = random.Random(5)
    truth = [(i, c) for i in range(80) for c in (0, 1) if rng.random() < 0.5]
    found = [(i, rng.randint(0, 1), rng.choice((0.1, 0.25, 0.39, 0.4, 0.6, 0.9))) for i in range(80) for _ in range(rng.randint(0, 3))]
    got = {(r["cls"], r["confidence"]): (r["n"], r["images"]) for r in I.image_recall(spark.createDataFrame(truth, "image_id int, cls int"), spark.createDataFrame(found, "image_id int, cls int, conf double")).collect()}
    for c in (0, 1):
        own = [i for i, k in truth if k == c]
        for step in I.CONFIDENCES:
            assert got[c, step] == (len(own), sum(any(j == i and k == c and v >= step for j, k, v in found) for i in own))
    frames = [("v", f) for f in range(40)] + [("quiet", f) for f in range(5)]
    boxes = [("v", f, rng.choice((0.2, 0.3, 0.5, 0.7)), rng.choice((0.0005, 0.002, 0.01, 0.7))) for f in range(40) for _ in range(rng.randint(0, 2))]
    f, b = spark.createDataFrame(frames, "video_id string, frame int"), spark.createDataFrame(boxes, "video_id string, frame int, conf double, area double")
    got = {(r["video_id"], r["area"], r["confidence"]): (r["frames"], r["images"]) for r in I.false_alarms(f, b, most=0.5).collect()}
    for a in I.AREAS:
        for step in I.CONFIDENCES:
            assert got["v", a, step] == (40, len({x for _, x, v, z in boxes if v >= step and a <= z <= 0.5})) and got["quiet", a, step] == (5, 0)
    got = {(r["confidence"], r["lasting"]): r["alarms"] for r in I.alarm_runs(f, b).collect()}
    for step in I.CONFIDENCES:
        for k in I.LASTING:
            run = n = 0
            for x in range(40):
                run = run + 1 if any(y == x and v >= step and z >= 0.001 for _, y, v, z in boxes) else 0
                n += run == k
            assert got.get((step, k), 0) == n
    names = spark.range(20000).select(F.concat(F.lit("p"), "id").alias("name"))
    assert abs(names.where(I.held_out(F.col("name"), 3)).count() - 2000) < 200


def test_drawn_tracks(spark):
    obs = [("v", 1, "car", k / 10, 10.0 * k, 5.0, 10.0 * k + 8, 9.0, 10.0 * k + 4, 9.0) for k in range(40) if not 15 <= k < 22] + [("v", 2, "person", 9.0, 1.0, 1.0, 2.0, 2.0, 1.5, 2.0)]
    rows = spark.createDataFrame(obs, "video_id string, tid bigint, kind string, t double, x1 double, y1 double, x2 double, y2 double, x double, y double")
    times = [0.0, 0.06, 1.5, 1.85, 3.9, 4.04, 4.2, 8.84, 8.86, 9.1]
    got = {(r["t"], r["tid"]): r for r in O.drawn_tracks(spark.createDataFrame([("v", t) for t in times], "video_id string, t double"), rows, 2.0).collect()}
    want = {}
    for t in times:
        for tid in (1, 2):
            own = [o for o in obs if o[1] == tid]
            near = min(own, key=lambda o: (abs(o[3] - t), o[3]))
            if own[0][3] - 0.15 <= t <= own[-1][3] + 0.15 and abs(near[3] - t) <= 0.2:
                trail = [(int(o[8] * 2), int(o[9] * 2)) for o in own if t - 2 <= o[3] <= t]
                want[t, tid] = (int(near[4] * 2), trail if len(trail) > 1 else [])
    assert {k: (r["x1"], [(p["x"], p["y"]) for p in r["trail"]]) for k, r in got.items()} == want and (1.85, 1) not in want and (8.86, 2) in want


def test_strip(spark):
    events = [("v", 0.0, 50.0, "b"), ("v", 10.0, 10.1, "a"), ("v", 20.0, 30.0, "c"), ("w", 0.0, 1.0, "z")]
    got = sorted(tuple(r) for r in O.strip(spark.createDataFrame(events, "video_id string, start double, end double, label string"), spark.createDataFrame([("v", 100.0), ("w", 2.0)], "video_id string, duration double"), 200).select("video_id", "label", "x1", "y1", "x2", "y2").collect())
    assert got == [("v", "a", 20, 3, 22, 15), ("v", "b", 0, 16, 100, 28), ("v", "c", 40, 29, 60, 41), ("w", "z", 0, 3, 100, 42)]


def test_calibration(spark):
    """A step's risk is that of a video with these frames alone; other middles move the scores and not the hazards."""
    rows = [("v", tid, "car", k * 100_000, x - 40, 350.0, x + 40, 400.0) for tid, at, v in ((1, 0, 170), (2, 1100, -160), (3, 300, 20)) for k in range(40) for x in (at + v * k / 10,)]
    obs = ground(spark.createDataFrame(rows, "video_id string, tid bigint, kind string, t_us bigint, x1 double, y1 double, x2 double, y2 double"))
    percent, of = R.calibration(obs, [1, 2], [R.MIDDLE, 3.0])
    of = {(r["step"], r["middle"]): r for r in of.collect()}
    for step in (1, 2):
        alone = [r["score"] for r in R.risk_curve(obs.where(F.col("t_us") % (100_000 * step) == 0)).collect()]
        got = of[step, R.MIDDLE]
        assert (got["most"], got["p50"], got["video_id"]) == (pytest.approx(max(alone)), pytest.approx(float(np.median(alone))), "v")
        assert of[step, 3.0]["most"] > got["most"] and got["alarms"] == int(max(alone) >= 0.5)
    assert sorted(r["step"] for r in percent.collect()) == [1, 2] and all(r["p50"] <= r["p90"] <= r["p99"] <= r["p999"] for r in percent.collect())
    held = {r["t_us"]: r["score"] for r in R.held_scores(obs.select("video_id", "t_us").distinct(), R.risk_curve(obs.where("t_us % 300000 = 0"))).collect()}
    sparse = {r["t_us"]: r["score"] for r in R.risk_curve(obs.where("t_us % 300000 = 0")).collect()}
    assert all(held[t] == sparse[t // 300_000 * 300_000] for t in held)
