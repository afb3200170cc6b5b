"""Operators against small expectations and plain loops."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.functions import geometry as G
from kerbside.operators import analytics as A
from kerbside.operators import evaluation as V
from kerbside.operators import sequences as Q
from kerbside.operators import signals, tracking
from kerbside.operators.kinematics import ground, majority_class, observations
from kerbside.operators.pairs import hazard
from kerbside.operators.risk import MIDDLE, WIDTH, risk_curve
from kerbside.operators.temporal import asof
from kerbside.sources.documents import clean_label, read_ground_truth, read_predictions
from kerbside.streaming.tracks import session_stream, track_stream


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_runs_bridge_gaps(spark):
    t = [i / 2 for i in range(20)]
    rows = [("v", x, x < 2 or 2.5 <= x < 4 or x >= 8) for x in t]
    got = Q.runs(table(spark, rows, "k string, t double, f boolean"), ["k"], "t", "f", 1.0).collect()
    assert sorted((r["start"], r["end"]) for r in got) == [(0, 3.5), (8, 9.5)]


def test_finalize(spark):
    rows = [("v", 1.0, 5.0, "jaywalking", [1]), ("v", 4.0, 8.0, "jaywalking", [2]), ("v", 20.0, 20.2, "jaywalking", [3]), ("v", 3.0, 6.0, "accident", [4]), ("v", 8.0, 15.0, "near_miss", [5])]
    events = table(spark, rows, "video_id string, start double, end double, label string, tids array<bigint>")
    got = Q.finalize(events, table(spark, [("v", 10.0)], "video_id string, duration double")).collect()
    assert sorted((r["label"], r["start"], r["end"], tuple(r["tids"])) for r in got) == [("accident", 3, 6, (4,)), ("jaywalking", 1, 8, (1, 2)), ("near_miss", 8, 10, (5,))]


def test_merge_and_enter_leave(spark):
    got = Q.merge_segments(table(spark, [("v", 5, 6), ("v", 1, 2), ("v", 1, 3)], "k string, start int, end int"), ["k"]).collect()
    assert sorted((r["start"], r["end"]) for r in got) == [(1, 3), (5, 6)]
    flags = table(spark, [("v", i, bool(x)) for i, x in enumerate([0, 1, 1, 0, 1, 1])], "k string, t int, f boolean")
    assert sorted((r["start"], r["end"]) for r in Q.enter_leave(flags, ["k"], "t", "f").collect()) == [(1, 2), (4, 5)]


def test_hysteresis(spark):
    df = table(spark, [("v", i, float(x)) for i, x in enumerate([26, 25, 3, 12, 23.9, 24, 4.1, 3.9, 23])], "k string, t int, x double")
    got = df.withColumn("s", Q.hysteresis(["k"], "t", "x", 24, 4)).orderBy("t").collect()
    assert [r["s"] for r in got] == [True, True, False, False, False, True, True, False, False]


def test_crossings(spark):
    df = table(spark, [("v", t / 10, 40 + 4.0 * t - 100) for t in range(40)], "k string, t double, s double")
    [r] = Q.crossings(df, ["k"], "t", "s").collect()
    assert r["t"] == pytest.approx(1.5) and r["new_sign"] in (0, 1)


def test_local_fit_is_exact_on_lines(spark):
    rows = [("v", 1, "car", t * 100_000, 3 + 2.0 * t - 40, 7 - 0.4 * t - 50, 3 + 2.0 * t + 40, 7 - 0.4 * t) for t in range(30)] + [("v", 2, "car", 0, 0.0, 0.0, 10.0, 10.0), ("v", 2, "car", 500_000, 10.0, 0.0, 20.0, 10.0), ("v", 3, "car", 0, 0.0, 0.0, 10.0, 10.0)]
    got = observations(table(spark, rows, "video_id string, tid bigint, kind string, t_us bigint, x1 double, y1 double, x2 double, y2 double")).collect()
    assert all(abs(r["vx"] - 20) < 1e-6 and abs(r["vy"] + 4) < 1e-6 and abs(r["x"] - r["gx"]) < 1e-6 for r in got if r["tid"] == 1)
    assert {round(r["vx"], 6) for r in got if r["tid"] == 2} == {20.0} and [r["vx"] for r in got if r["tid"] == 3] == [0.0]


def test_majority_class_prefers_the_first_seen(spark):
    rows = [("v", 1, c, t) for t, c in enumerate([2, 7, 7, 2, 5])]
    [r] = majority_class(table(spark, rows, "video_id string, tid int, cls int, t_us bigint")).collect()
    assert r["cls"] == 2


def test_asof_directions(spark):
    left, right = table(spark, [("k", float(t)) for t in (0, 1.5, 3, 9)], "k string, t double"), table(spark, [("k", 1.0, 1), ("k", 2.0, 2), ("k", 2.0, 3), ("k", 5.0, 4)], "k string, u double, i int")
    for direction, clamp, want in (("nearest", False, [1, 1, 2, 4]), ("forward", False, [1, 2, 4, None]), ("backward", False, [None, 1, 2, 4]), ("forward", True, [1, 2, 4, 4])):
        got = asof(left, right, ["k"], "t", "u", direction, "i", clamp).orderBy("t").collect()
        assert [r["i"] for r in got] == want, direction


def test_polygons_include_their_outline(spark):
    poly = G.polygon([(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)])
    points = [(5, 0, True), (10, 5, True), (5, 5, True), (5, 6, False), (1, 1, True), (11, 5, False), (2, 9, False), (1, 8, True)]
    df = table(spark, [(float(x), float(y), w) for x, y, w in points], "x double, y double, w boolean")
    got = df.select("w", G.inside(F.col("x"), F.col("y"), poly).alias("i"), G.polygon_distance(F.col("x"), F.col("y"), poly).alias("d"), G.polyline_side(F.col("x"), F.col("y"), [(0, 0), (100, 0), (100, 100)]).alias("p")).collect()
    assert all(r["i"] == r["w"] for r in got)
    assert all((r["d"] >= 0) == r["w"] or abs(r["d"]) < 1e-9 for r in got)
    m = [2.0, 0.0, 3.0, 0.0, 2.0, -1.0]
    inverse = G.invert_affine(m)
    [r] = df.limit(1).select(G.affine(*G.affine(F.lit(4.0), F.lit(7.0), m), inverse)[0].alias("x")).collect()
    assert r["x"] == pytest.approx(4)
    assert G.registration_accepted(m, 50) is False and G.registration_accepted([1, 0, 5, 0, 1, 5], 50) and not G.registration_accepted([1, 0, 5, 0, 1, 5], 39)


def test_iou(spark):
    df = table(spark, [(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 15.0, 10.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    a, b = [F.col(c) for c in "abcd"], [F.col(c) for c in "efgh"]
    r = df.select(G.iou(a, b).alias("i"), G.inside_fraction(a, b).alias("f")).first()
    assert r["i"] == pytest.approx(1 / 3) and r["f"] == pytest.approx(0.5)


def test_pair_hazard(spark):
    cases = [(300, 0, 100, 0, -100, 0, 0.5, 99), (300, 0, 100, 0, 100, 0, 0, 0), (300, 0, -100, 0, 100, 0, 0, 0), (300, 120, 100, 0, -100, 0, 0, 0), (600, 0, 30, 0, -30, 0, 0, 0.5)]
    rows = [(0.0, 0.0, float(c[2]), float(c[3]), 80.0, float(c[0]), float(c[1]), float(c[4]), float(c[5]), 80.0, float(c[6]), float(c[7])) for c in cases]
    names = ["x1", "y1", "vx1", "vy1", "size1", "x2", "y2", "vx2", "vy2", "size2"]
    df = table(spark, rows, ", ".join(f"{n} double" for n in [*names, "lo", "hi"]))
    for r in df.select("lo", "hi", hazard({n: F.col(n) for n in names}).alias("h")).collect():
        assert r["lo"] <= r["h"] <= r["hi"]


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (4, 2), (2, 5), (5, 5)):
        value = rng.random((n, m))
        got = sum(value[a, b] for a, b in tracking.assign(value))
        k = min(n, m)
        best = max(sum(value[r, c] for r, c in zip(rows, cols, strict=True)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert got == pytest.approx(best)


def detections(n=20, gap=()):
    rows = []
    for t in range(n):
        if t not in gap:
            for d, (x, v) in enumerate(((0, 5), (300, -5))):
                rows.append(("v", t / 10, d, x + v * t, 100.0, x + v * t + 80.0, 150.0, 0.9, 2))
    return rows


DETECTION = "video_id string, t double, det_idx int, x1 double, y1 double, x2 double, y2 double, conf double, cls int"


@pytest.mark.parametrize("gap", [(), (7, 8)])
def test_tracker_keeps_ids(spark, gap):
    got = tracking.track(table(spark, [(*r[:3], *map(float, r[3:7]), *r[7:]) for r in detections(gap=gap)], DETECTION)).collect()
    ids = {}
    for r in got:
        ids.setdefault(r["tid"], []).append(r["x1"])
    assert sorted(ids) == [1, 2] and sorted(len(x) for x in ids.values()) == [20 - len(gap)] * 2


def test_tracker_speed_follows_the_new_motion():
    """Of the newest motion's speed 0.6 count, of the one before 0.4."""
    tracker = tracking.Tracker()
    for t, x in ((0.0, 0.0), (0.1, 4.0), (0.2, 6.0)):
        tracker.update(np.array([[x, 0.0, x + 80, 50.0]]), np.array([0.9]), t)
    assert tracker.speed[0, 0] == pytest.approx(0.6 * 20 + 0.4 * (0.6 * 40))


def test_tracker_in_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = [(*r[:3], *map(float, r[3:7]), *r[7:]) for r in detections()]
    for k in range(2):
        part = [r for r in rows if (r[1] >= 1.0) == bool(k)]
        table(spark, part, DETECTION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DETECTION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = track_stream(stream).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r["t"], r["tid"], r["x1"])
    assert sorted(map(key, spark.table("tracked").collect())) == sorted(map(key, tracking.track(table(spark, rows, DETECTION)).collect()))


def test_sessions_of_a_stream(spark, tmp_path):
    for k, seconds in enumerate(([0, 5, 9], [40, 41], [500])):
        spark.createDataFrame([("v", s) for s in seconds], "k string, s long").selectExpr("k", "timestamp_seconds(s) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    query = session_stream(stream, ["k"], "ts", "10 seconds").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("sessions").selectExpr("unix_timestamp(start) AS a", "unix_timestamp(end) AS b", "n").collect()
    assert sorted(map(tuple, got)) == [(0, 9, 3), (40, 41, 2)]


def test_signal_phases():
    t = np.arange(0, 90, 0.5)
    red = (t // 15).astype(int) % 2 == 1
    assert signals.least_phases(t, red ^ ((t >= 20) & (t < 21.5))).tolist() == red.tolist()
    assert signals.otsu(np.full(50, 50.0)) is None
    # a phase lasts from its first sample to its last: 50 samples at 10 Hz are 4.9 s, 51 are 5
    t = np.arange(300) / 10
    assert [signals.least_phases(t, (t >= 10) & (t < 10 + n / 10 - 0.01)).sum() for n in (50, 51)] == [0, 51]
    for seed in range(5):
        rng = np.random.default_rng(seed)
        values = np.concatenate((rng.normal(20, 4, 300), rng.normal(120, 4, 300)))
        assert signals.lit(values).tolist() == [False] * 300 + [True] * 300
    t = np.arange(0, 90, 0.5)
    cut = signals.otsu(np.where(red, 120.0, 20.0) + np.random.default_rng(0).normal(0, 3, len(t)))
    assert 25 < cut < 115


def test_risk_curve_against_a_loop(spark):
    rng = random.Random(1)
    rows = []
    for tid in range(4):
        x, v = 100.0 + 300 * tid, rng.uniform(-150, 150)
        for k in range(30):
            x += v / 10
            rows.append(("v", tid, "car", k * 100_000, x - 40, 350.0, x + 40, 400.0))
    obs = ground(table(spark, rows, "video_id string, tid bigint, kind string, t_us bigint, x1 double, y1 double, x2 double, y2 double"))
    got = {r["t_us"]: r["score"] for r in risk_curve(obs).collect()}
    size, history, previous, recent, score, last = math.hypot(80, 50), {}, {}, [], 0.0, 0.0
    for k in range(30):
        t = k / 10
        h, states = 0.0, {}
        for tid in range(4):
            own = history.setdefault(tid, [])
            own.append((t, rows[tid * 30 + k][4] + 40))
            own[:] = [p for p in own if t - p[0] <= 1.0 + 1e-9]
            if len(own) >= 4:
                ts, xs = np.array(own).T
                slope, at = np.polyfit(ts - t, xs, 1)
                states[tid] = at, slope
        for a, b in itertools.combinations(sorted(states), 2):
            (p, v), (q, w) = states[a], states[b]
            if max(abs(v), abs(w)) / size < 0.8 or abs(q - p) > 6 * size or abs(w - v) < 1e-3:
                continue
            closing, at = -(q - p) * (w - v) / (abs(q - p) + 1e-6) / size, -(q - p) / (w - v)
            if closing >= 0.5 and 0 < at < 3:
                h = max(h, closing**2 / (2 * max(abs(q - p) / size - 1, 0.25)))
        for tid, (_, v) in states.items():
            rel = abs(v) / size
            if tid in previous and previous[tid][0] >= 0.8 and t > previous[tid][1]:
                h = max(h, (previous[tid][0] - rel) / (t - previous[tid][1]))
            previous[tid] = rel, t
        recent = [(u, x) for u, x in [*recent, (t, h)] if t - u <= 0.5 + 1e-9]
        held = min(x for _, x in recent) if t - recent[0][0] >= 0.25 - 1e-9 else 0.0
        score = max(1 / (1 + math.exp(-(held - MIDDLE) / WIDTH)), score * 0.5 ** (t - last))
        last = t
        assert got[k * 100_000] == pytest.approx(score, abs=1e-5), k


EVENT = "video_id string, ord int, start double, end double, label string"


def test_scores_of_perfect_and_empty_predictions(spark):
    truth = table(spark, [("a", 0, 5.0, 8.0, "red_light"), ("a", 1, 20.0, 26.0, "accident"), ("b", 0, 10.0, 13.0, "red_light")], EVENT)
    perfect = V.event_scores(truth, truth).collect()
    assert all(r["f1"] == 1 for r in perfect) and len(perfect) == 9
    assert all(r["f1"] == 0 and r["tp"] == 0 for r in V.event_scores(truth, truth.limit(0)).collect())
    assert V.macro_f1(V.event_scores(truth, truth)).first()["score"] == 1


def test_greedy_takes_the_larger_indices_of_equals(spark):
    truth = table(spark, [("a", 0, 0.0, 10.0, "x"), ("a", 1, 0.0, 10.0, "x")], EVENT)
    [r] = V.matches(truth, table(spark, [("a", 0, 0.0, 10.0, "x")], EVENT), 0.5, V.KEYS).collect()
    assert (r["i"], r["j"]) == (1, 0)


def test_alarms_merge_below_the_gap_only(spark):
    on = [0, 1, 2, 4, 7]
    curve = table(spark, [("v", t / 1.0, 0.9 if t in on else 0.1) for t in range(10)], "video_id string, t double, score double")
    assert sorted(r["start"] for r in V.alarms(curve).collect()) == [0, 4, 7]
    accidents = table(spark, [("v", 0, 9.0, 10.0, "accident"), ("v", 1, 9.5, 10.0, "accident")], EVENT)
    got = V.alarm_matches(accidents, V.alarms(curve)).orderBy("accident").collect()
    assert [r["alarm"] for r in got] == [0, 4]


def test_frame_labels(spark):
    truth = table(spark, [("v", 0, 10.0, 12.0, "accident"), ("v", 1, 14.0, 16.0, "near_miss")], EVENT)
    curve = table(spark, [("v", float(t), 0.0) for t in (3, 5, 9, 10, 12, 13, 17)], "video_id string, t double, score double")
    got = {r["t"]: r["y"] for r in V.frame_labels(curve, truth).collect()}
    assert got == {3: 0, 5: 1, 9: 1, 10: None, 12: None, 13: None, 17: 0}


def test_average_precision(spark):
    rows = table(spark, [("k", s, y) for s, y in ((0.9, True), (0.8, False), (0.8, True), (0.1, False))], "k string, s double, y boolean")
    assert V.average_precision(rows, ["k"], "s", "y").first()["ap"] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_documents(spark, tmp_path):
    (tmp_path / "truth.json").write_text(json.dumps({"a.mp4": {"duration": 60.0, "fps": 25.0, "events": [[5, 8, "red_light"], [20, 26, "accident"]]}}))
    videos, events = read_ground_truth(spark, str(tmp_path / "truth.json"))
    assert videos.first()["duration"] == 60 and [(r["ord"], r["start"], r["label"]) for r in events.orderBy("ord").collect()] == [(0, 5, "red_light"), (1, 20, "accident")]
    (tmp_path / "p.json").write_text(json.dumps({"team": "t", "videos": {"a.mp4": {"events": [[1, 2, "x"]], "risk": [[0.0, 0.1], [0.1, 0.2]]}}}))
    events, risk = read_predictions(spark, str(tmp_path / "p.json"))
    assert events.first()["end"] == 2 and [r["score"] for r in risk.orderBy("ord").collect()] == [0.1, 0.2]
    [r] = table(spark, [("0 0.5 0.5 0.2 1.4\n\n1 0.1 0.1 0 0.2",)], "t string").select(clean_label(F.col("t")).alias("b")).collect()
    assert len(r["b"]) == 1 and r["b"][0]["h"] == 1


def test_small_formats(spark):
    df = table(spark, [(75.26, 0.5, 130.0)], "s double, r double, b double")
    r = df.select(A.clock(F.col("s")).alias("c"), A.risk_level(F.col("r")).alias("l"), A.lighting(F.col("b")).alias("g"), A.nice_step(F.lit(23.0)).alias("n"), A.pretty(F.lit("wrong_way")).alias("p")).first()
    assert tuple(r) == ("1:15.2", "ALARM", "day", 50.0, "WRONG WAY")
