"""Queries on orders as events take all orders: against plain loops on the smallest tables."""

from __future__ import annotations

import os
from collections import defaultdict

import pytest

from kerbside.plans import registry
from kerbside.plans.series import intervals

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def orders(spark):
    return intervals(spark, SF).collect()


@pytest.fixture(scope="module")
def truth(orders):
    """(customer, label): true (ord, start, end) and predicted ones."""
    groups = defaultdict(lambda: ([], []))
    for r in orders:
        if r["end"] > r["start"]:
            o, s, e = r["order"], r["start"], r["end"]
            groups[str(r["cust"]), r["flag"]][0].append((o, s, e))
            if o % 3 and e + o % 17 > s + o % 40:
                groups[str(r["cust"]), r["flag"]][1].append((o, s + o % 40, e + o % 17))
    return groups


def pairs(truth, least):
    for key, (a, b) in truth.items():
        for i, s0, e0 in a:
            for j, s1, e1 in b:
                both = min(e0, e1) - max(s0, s1)
                if both > 0 and both / (e0 - s0 + e1 - s1 - both) >= least:
                    yield key, i, j, both / (e0 - s0 + e1 - s1 - both)


def greedy(truth, least):
    used, out = set(), set()
    for (video, label), i, j, _ in sorted(pairs(truth, least), key=lambda p: (p[3], p[1], p[2]), reverse=True):
        if ("i", i) not in used and ("j", j) not in used:
            used |= {("i", i), ("j", j)}
            out.add((video, label, i, j))
    return out


def test_match_candidates(spark, truth):
    want = defaultdict(list)
    for (_, label), i, _, x in pairs(truth, 0.5):
        want[label].append((i, int(x * 1000 + 1e-6)))
    got = {r["label"]: (r["pairs"], r["truths"], r["iou1000"]) for r in registry.QUERIES["match_candidates"](spark, SF).collect()}
    assert got == {k: (len(v), len({i for i, _ in v}), sum(x for _, x in v)) for k, v in want.items()}


def test_scores_and_matches(spark, truth):
    assert {tuple(r) for r in registry.QUERIES["greedy_matches"](spark, SF).collect()} == greedy(truth, 0.5)
    n, m = (sum(len(g[k]) for g in truth.values()) for k in (0, 1))
    got = {r["threshold10"]: (r["tp"], r["fp"], r["fn"]) for r in registry.QUERIES["event_scores"](spark, SF).where("label = 'all'").collect()}
    hits = {k: len(greedy(truth, k / 10)) for k in (3, 5, 7)}
    assert got == {k: (x, m - x, n - x) for k, x in hits.items()}


def test_without_overlaps(spark, truth):
    want = set()
    for (video, label), (_, b) in truth.items():
        last = None
        for o, s, e in sorted(b, key=lambda x: (x[1], x[0])):  # of equal starts the one given first
            if last is None or s >= last:
                want.add((video, label, s, e))
                last = e
    got = [tuple(r) for r in registry.QUERIES["without_overlaps"](spark, SF).collect()]
    spans = {(v, k, o): (v, k, s, e) for (v, k), (_, b) in truth.items() for o, s, e in b}
    assert {spans[x] for x in got} == want and len(got) == len(want)


def test_finalize(spark, orders):
    want, groups = [], defaultdict(list)
    for r in orders:
        groups[str(r["cust"]), r["flag"]].append((max(r["start"], 0), min(r["end"], 2000)))
    for (video, label), spans in groups.items():
        runs = []
        for s, e in sorted(spans):
            if runs and s - runs[-1][1] <= {"A": 5, "N": 0}.get(label, 1):
                runs[-1] = [runs[-1][0], max(runs[-1][1], e), runs[-1][2] + 1]
            else:
                runs.append([s, e, 1])
        want += [(video, s, e, label, n) for s, e, n in runs if e - s >= (30 if label == "A" else 0.5)]
    assert sorted(tuple(r) for r in registry.QUERIES["finalize"](spark, SF).collect()) == sorted(want)


def test_heat_strip(spark, orders):
    want = defaultdict(list)
    for r in orders:
        if 0 <= r["start"] <= 2600 and r["end"] <= 2600:
            a, b = (min(int(r[k] / 2600 * 24), 23) for k in ("start", "end"))
            for k in range(a, max(a, b) + 1):
                want[r["cust"], k].append(r["flag"])
    got = {(r["cust"], r["bin"]): (r["n"], r["labels"]) for r in registry.QUERIES["heat_strip"](spark, SF).collect()}
    assert got == {k: (len(v), ",".join(sorted(set(v)))) for k, v in want.items()}


def test_violations_of_curves_and_videos(spark, truth, tmp_path):
    """Bad scores, times that go back, orders of unknown customers and customers without predictions are reported."""
    for t in ("orders", "lineitem"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    gone = min(int(v) for (v, _), (_, b) in truth.items() if b)
    customers.where(f"c_custkey <> {gone}").write.parquet(str(tmp_path / "customer.parquet"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    bad = "CASE WHEN event_id % 100 = 1 THEN NULL WHEN event_id % 100 = 2 THEN -value - 1 ELSE value END"
    late = "CASE WHEN event_id % 100 = 3 THEN ts + INTERVAL 400 DAYS ELSE ts END"
    events.selectExpr("event_id", "user_id", f"{late} AS ts", "event_type", f"{bad} AS value", "props").write.parquet(str(tmp_path / "events.parquet"))
    rows = events.select("event_id", "user_id").orderBy("user_id", "event_id").collect()
    back = sum(a["user_id"] == b["user_id"] and a["event_id"] % 100 == 3 and b["event_id"] % 100 != 3 for a, b in zip(rows, rows[1:]))
    scoreless = sum(b["event_id"] % 100 in (1, 2) and not (i and rows[i - 1]["user_id"] == b["user_id"] and rows[i - 1]["event_id"] % 100 == 3) for i, b in enumerate(rows))
    predicted = {v: sum(len(g[1]) for (w, _), g in truth.items() if w == v) for v, _ in truth}
    got = {r["problem"]: r["n"] for r in registry.QUERIES["violations"](spark, str(tmp_path)).collect()}
    assert (got["time goes back"], got["no score"]) == (back, scoreless) and back and scoreless
    assert got["unknown video"] == predicted[str(gone)]
    assert got["no prediction"] == sum(not predicted.get(str(r["c_custkey"])) for r in customers.collect() if r["c_custkey"] != gone)
