"""Figures for boards, repaired results and the alarm score, against plain loops."""

from __future__ import annotations

import math
import os
import random

import pytest

from kerbside.operators import boards as B
from kerbside.plans import registry

SF = "/root/testdata/sf0.001"


def test_counts_have_all_seconds_and_both_ends(spark):
    obs = spark.createDataFrame([("a", 1, "car", 1.1), ("a", 1, "car", 2.9), ("a", 2, "bus", 2.2), ("a", 2, "bus", 2.8), ("a", 3, "car", 3.12)], "video_id string, tid long, kind string, t double")
    videos = spark.createDataFrame([("a", 4.5), ("b", 0.2)], "video_id string, duration double")
    got = {(r["video_id"], r["second"]): (r["car"], r["bus"]) for r in B.counts_per_second(obs, videos, ["car", "bus"]).collect()}
    assert got == {("a", 0): (0, 0), ("a", 1): (1, 0), ("a", 2): (1, 0), ("a", 3): (1, 0), ("a", 4): (0, 0), ("b", 0): (0, 0)}


def test_thinning_starts_anew_with_each_key(spark):
    rows = [(k, t, i) for i, (k, t) in enumerate([("x", 0), ("x", 4), ("x", 5), ("x", 9), ("x", 10), ("x", 10), ("y", 3), ("y", 7), ("y", 8)])]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    assert sorted(tuple(r) for r in B.thinned(df, ["k"], "t", 5, "i").collect()) == [("x", 0, 0), ("x", 5, 2), ("x", 10, 4), ("y", 3, 6), ("y", 8, 8)]
    assert B.thinned(df.limit(0), ["k"], "t", 5).collect() == []


def test_sanitised(spark):
    rows = [("9", "4", "x" * 50, "1.5"), ("nan", "inf", None, None), ("-inf", "2", "b", "-3"), ("no", "3", "c", "0.25")]
    got = [tuple(r) for r in B.sanitised(spark.createDataFrame(rows, "start string, end string, label string, score string")).collect()]
    assert got == [(4.0, 9.0, "x" * 40, 1.0), (0.0, 0.0, "", 0.0), (0.0, 2.0, "b", 0.0), (0.0, 3.0, "c", 0.25)]


def test_budget_and_final_score(spark):
    videos = spark.createDataFrame([("a", 10.0, 30.0), ("b", 10.0, 30.1)], "video_id string, duration double, seconds_taken double")
    assert [r["video_id"] for r in B.within_budget(videos.select("video_id"), videos).collect()] == ["a"]
    both = spark.createDataFrame([(0.5, 0.9), (0.5, None)], "e double, a double")
    got = [r[0] for r in both.select(B.final_score(both.e, both.a)).collect()]
    assert got == pytest.approx([0.62, 0.5])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_coerced_query_is_a_loop(spark):
    from kerbside.plans.boards import _raw

    def number(x):
        try:
            return float(x)
        except ValueError:
            return None

    rows = []
    for r in _raw(spark, SF).collect():
        s, e = number(r["start"]), number(r["end"])
        if s is None or e is None or math.isnan(s) or r["label"] not in ("click", "purchase"):
            continue
        e = min(e, 1900.0)
        if 0 <= s < e:
            rows.append((r["video_id"], r["label"], s, e, r["ord"]))
    want, last = [], {}
    for v, label, s, e, _ in sorted(rows, key=lambda r: (*r[:3], r[4])):  # of equal starts the one given first
        if s >= last.get((v, label), 0.0):
            want.append((v, label, int(s), int(e)))
            last[v, label] = e
    got = sorted((r["video_id"], r["label"], r["start"], r["end"]) for r in registry.QUERIES["coerced_events"](spark, SF).collect())
    assert want and got == sorted(want)


def plain_alarm_score(curves, accidents):
    """curves: {video: [(t, score)]}, accidents: {video: [(start, end)]}."""

    def label(v, t):
        if any(s <= t <= e for s, e in accidents.get(v, ())):
            return None
        return int(any(s - 5 <= t < s for s, _ in accidents.get(v, ())))

    samples = [(score, label(v, t)) for v, c in curves.items() for t, score in c if label(v, t) is not None]
    positives = sum(y for _, y in samples)
    ap = 0.0
    for level in {s for s, _ in samples}:
        above = [y for s, y in samples if s >= level]
        ap += sum(y for s, y in samples if s == level) / max(positives, 1) * sum(above) / len(above)
    rate = positives / len(samples)
    ap = max(0.0, (ap - rate) / (1 - rate)) if rate < 1 else 0.0
    alarms = matched = 0
    warned = 0.0
    for v, c in curves.items():
        starts, end, on = [], None, False
        for t, score in sorted(c):
            if score >= 0.5:
                if not on and (end is None or t - end >= 2):
                    starts.append(t)
                end = t
            on = score >= 0.5
        starts = [t for t in starts if label(v, t) is not None]
        alarms += len(starts)
        for s, _ in sorted(accidents.get(v, ())):
            fit = [t for t in starts if s - 10 <= t < s]
            if fit:
                starts.remove(min(fit))
                matched += 1
                warned += s - min(fit)
    n = sum(map(len, accidents.values()))
    p, r = (matched / alarms if alarms else 0.0), matched / n
    f1 = 2 * p * r / (p + r) if p + r else 0.0
    return 0.4 * ap + 0.4 * f1 + 0.2 * min(1.0, warned / n / 10), alarms, matched


@pytest.mark.parametrize("seed", range(3))
def test_alarm_score_is_a_loop(spark, seed):
    rng = random.Random(seed)
    curves = {v: [(t / 2, rng.choice((0.1, 0.2, 0.3, 0.4, 0.6, 0.9)) if rng.random() < 0.4 else 0.05) for t in range(120)] for v in "abc"}
    accidents = {v: [(x, x + 4.0) for x in sorted(rng.sample(range(12, 55, 8), 2))] for v in "ab"}
    curve = spark.createDataFrame([(v, t, s) for v, c in curves.items() for t, s in c], "video_id string, t double, score double")
    truth = spark.createDataFrame([(v, float(s), e, "accident") for v, a in accidents.items() for s, e in a], "video_id string, start double, end double, label string")
    [got] = B.alarm_score(curve, truth).collect()
    want, alarms, matched = plain_alarm_score(curves, accidents)
    assert (got["alarms"], got["matched"]) == (alarms, matched) and got["score"] == pytest.approx(want)
    [none] = B.alarm_score(curve, truth.limit(0)).collect()
    assert none["score"] is None and none["accidents"] == 0
