"""Layouts and priors from files, zones as a table, and contexts from raw tables."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_rules import context, found, path, stream

from kerbside.functions.geometry import inside, polygon
from kerbside.operators import scene as S
from kerbside.operators import zones as Z
from kerbside.operators.kinematics import observations
from kerbside.plans.contexts import build_context
from kerbside.rules.crossing import failure_to_yield
from kerbside.sources import layouts as L

SQUARE = [[100, 100], [300, 100], [300, 300], [100, 300]]
BENT = [[50.0, 60.0], [400.0, 20.0], [220.0, 150.0], [390.0, 330.0], [30.0, 280.0]]
FULL = {
    "crossings": [BENT, SQUARE], "refuges": [SQUARE], "intersection": SQUARE, "road_areas": [BENT], "solid_lines": [[[0, 0], [5, 5], [9, 5]]],
    "carriageways": [{"name": "east", "poly": SQUARE}], "prohibited_turns": [{"from": SQUARE, "to": BENT}], "u_turn_allowed": [], "no_u_turn": [BENT],
    "stop_lines": [{"name": "near", "line": [[10, 20], [30, 40]], "approach_sign": -1, "signal": "main"}], "signals": {"main": {"red": [10, 20, 21, 30], "green": [10, 32, 21, 42]}}, "_comment": "drawn",
}


@pytest.fixture(scope="module")
def drawn(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("layouts")
    for name, document in (("full", FULL), ("few", {"crossings": [SQUARE], "intersection": None}), ("none", {})):
        (folder / f"{name}.json").write_text(json.dumps(document, indent=1))
    return L.read_layouts(spark, str(folder))


def test_layouts_are_read_together(drawn):
    rows = {(r["layout_id"], r["zone_type"], r["zone_no"]): r for r in L.zones(drawn).collect()}
    assert sorted(rows) == sorted([("few", "crossing", 0)] + [("full", t, n) for t, n in (("crossing", 0), ("crossing", 1), ("refuge", 0), ("intersection", 0), ("road_area", 0), ("carriageway", 0), ("turn_from", 0), ("turn_to", 0), ("no_u_turn", 0))])
    assert rows["full", "carriageway", 0]["name"] == "east" and [[p["x"], p["y"]] for p in rows["full", "turn_to", 0]["poly"]] == BENT
    stop, solid = (next(r for r in L.lines(drawn).collect() if r["line_type"] == t) for t in ("stop_line", "solid_line"))
    assert (stop["name"], stop["approach_sign"], stop["signal"], len(stop["poly"])) == ("near", -1, "main", 2) and len(solid["poly"]) == 3
    assert sorted((r["lamp"], r["x1"], r["y2"]) for r in L.lamp_boxes(drawn).collect()) == [("green", 10, 42), ("red", 10, 30)]


def test_literal_layout(drawn):
    one = L.literal_layout(drawn, "full")
    assert one.crossings == [[tuple(p) for p in BENT], [tuple(map(float, p)) for p in SQUARE]] and one.stop_lines[0]["a"] == (10, 20) and one.prohibited_turns[0]["to"][1] == (400, 20)
    none = L.literal_layout(drawn, "none")
    assert none == type(none)()


def test_placed(spark, drawn):
    m = [0.9, -0.1, 12.0, 0.1, 0.9, -7.0]
    videos = spark.createDataFrame([("a", "full", m), ("b", "full", None), ("c", "few", m)], "video_id string, layout_id string, m array<double>")
    rows = {(r["video_id"], r["zone_type"], r["zone_no"]): [(p["x"], p["y"]) for p in r["poly"]] for r in L.placed(L.zones(drawn), videos).collect()}
    assert rows["b", "crossing", 0] == [tuple(p) for p in BENT]
    want = [(np.float32(0.9 * x - 0.1 * y + 12), np.float32(0.1 * x + 0.9 * y - 7)) for x, y in BENT]
    assert rows["a", "crossing", 0] == [(float(x), float(y)) for x, y in want] and ("c", "crossing", 0) in rows
    lamps = {(r["video_id"], r["lamp"]): (r["x1"], r["y1"], r["x2"], r["y2"]) for r in L.placed_lamps(L.lamp_boxes(drawn), videos).collect()}
    grown, cx, cy = (0.9**2 + 0.1**2) ** 0.5, 0.9 * 15.5 - 0.1 * 25 + 12, 0.1 * 15.5 + 0.9 * 25 - 7
    assert lamps["b", "red"] == (10, 20, 21, 30) and lamps["a", "red"] == tuple(round(v) for v in (cx - 5.5 * grown, cy - 5 * grown, cx + 5.5 * grown, cy + 5 * grown))
    full = {(r["video_id"], r["lamp"]): r["x2"] for r in L.placed_lamps(L.lamp_boxes(drawn), videos, 0.5).collect()}
    assert full["b", "red"] == 42


def test_points_in_zones_are_those_of_literal_zones(spark, drawn):
    videos = spark.createDataFrame([("a", "full", None), ("c", "few", [1.0, 0.0, 40.0, 0.0, 1.0, 0.0])], "video_id string, layout_id string, m array<double>")
    zones = L.placed(L.zones(drawn), videos)
    rng = random.Random(4)
    points = [(v, i, *p) for v in "ac" for i, p in enumerate([(100.0, 100.0), (300.0, 200.0), (299.9, 300.0), (220.0, 150.0), (304.0, 96.0), (176.0, 176.0), (-5.0, 3.0)] + [(rng.uniform(-50, 450), rng.uniform(-50, 400)) for _ in range(600)])]
    table = spark.createDataFrame(points, "video_id string, i int, x double, y double")
    got = sorted((r["video_id"], r["zone_type"], r["zone_no"], r["i"]) for r in Z.in_zones(table, Z.zone_cells(zones)).collect())
    want = []
    for z in zones.collect():
        hit = table.where(F.col("video_id") == z["video_id"]).where(inside(F.col("x"), F.col("y"), polygon([(p["x"], p["y"]) for p in z["poly"]])))
        want += [(z["video_id"], z["zone_type"], z["zone_no"], r["i"]) for r in hit.collect()]
    assert got == sorted(want) and len({t for _, t, _, _ in got}) == 8
    edge = Z.zone_cells(zones.where("zone_type = 'crossing'")).groupBy("edge").count().collect()
    assert {r["edge"] for r in edge} == {True, False}


def test_warped_by_video(spark):
    """Against a loop over cells; a null map leaves all in place."""
    rng = random.Random(2)
    grid = {(r, c): float(rng.randint(1, 90)) for r in range(S.ROWS) for c in range(S.COLS) if rng.random() < 0.4}
    table = spark.createDataFrame([("s", r, c, v) for (r, c), v in grid.items()], "scene_id string, r int, c int, visits double")
    m = (1.04, -0.03, 61.0, 0.03, 1.04, -44.0)
    videos = spark.createDataFrame([("a", "s", list(m)), ("b", "s", None), ("x", "other", None)], "video_id string, scene_id string, m array<double>")
    got = {(r["video_id"], r["r"], r["c"]): r["visits"] for r in S.warped_by_video(table, videos, (), ("visits",)).collect()}
    back = np.linalg.inv(np.array([[m[0], m[1], m[2] * 48 / 1280], [m[3], m[4], m[5] * 27 / 720], [0, 0, 1]]))
    want = {("b", r, c): v for (r, c), v in grid.items()}
    for r in range(S.ROWS):
        for c in range(S.COLS):
            x, y, _ = back @ (c, r, 1)
            if (int(np.floor(y + 0.5)), int(np.floor(x + 0.5))) in grid:
                want["a", r, c] = grid[int(np.floor(y + 0.5)), int(np.floor(x + 0.5))]
    assert got == want


SCHEMA = "video_id string, tid bigint, kind string, t_us bigint, x1 double, y1 double, x2 double, y2 double"


def test_prior_goes_to_disk_and_back(spark, tmp_path):
    cells = S.with_cells(observations(spark.createDataFrame(stream(8), SCHEMA)))
    videos = spark.createDataFrame([("v", "s", [1.0, 0.0, 80.0, 0.0, 1.0, 0.0])], "video_id string, scene_id string, m array<double>")
    grid, votes = S.prior_of(cells, videos)
    L.write_prior(grid, votes, str(tmp_path / "prior"))
    again = L.read_prior(spark, str(tmp_path / "prior"))
    own = {(r["r"], r["c"]): r["visits"] for r in S.grid(cells).collect()}
    assert {(r["r"], r["c"] + 3): r["visits"] for r in again[0].collect()} == own and again[1].count() > 0  # 80 pixels are three cells
    assert L.read_prior(spark, str(tmp_path / "nothing"))[0].count() == 0


def test_context_from_raw_tables(spark, tmp_path):
    """A short video knows its street from the prior alone, at the place where its camera sees it; lamp scores become states."""
    seen_before = S.with_cells(observations(spark.createDataFrame(stream(40, 420.0, 1.5), SCHEMA)))
    scene = spark.createDataFrame([("v", "s", None)], "video_id string, scene_id string, m array<double>")
    prior = S.prior_of(seen_before, scene)
    shift = [1.0, 0.0, 80.0, 0.0, 1.0, 0.0]
    videos = spark.createDataFrame([("v", 60.0, "s", shift)], "video_id string, duration double, scene_id string, m array<double>")
    lamps = spark.createDataFrame([("v", "main", lamp, float(t), (90.0 if (t // 20 % 2 == 0) == (lamp == "red") else 10.0)) for t in range(60) for lamp in ("red", "green")] + [("v", "odd", "green", float(t), 5.0) for t in range(60)], "video_id string, signal string, lamp string, t double, score double")
    (tmp_path / "one.json").write_text(json.dumps({"crossings": [[[350, 300], [490, 300], [490, 400], [350, 400]]], "road_areas": [[[350, 0], [490, 0], [490, 720], [350, 720]]]}))
    layout = L.literal_layout(L.read_layouts(spark, str(tmp_path / "one.json")), "one")
    placed = type(layout)(crossings=[[(x + 80, y) for x, y in layout.crossings[0]]], road_areas=[[(x + 80, y) for x, y in layout.road_areas[0]]])
    cars = [r for r in stream(6, 500.0, 2.0)]
    walker = path(1, (2, 470, 350), (14, 530, 350), kind="person", wide=30.0, tall=80.0)
    ctx = build_context(spark.createDataFrame(cars + walker, SCHEMA), videos, prior, placed, lamps)
    grid = {(r["r"], r["c"]): r["visits"] for r in ctx.grid.collect()}
    assert max(v for (_, c), v in grid.items() if c == 18) > 40  # 500 pixels: 40 of the prior and its own
    assert found(failure_to_yield(ctx)) and found(failure_to_yield(context(spark, cars + walker, None, placed))) == []
    states = {(r["signal"], r["t"]): r["red"] for r in ctx.signals.collect()}
    assert states["main", 5.0] and not states["main", 30.0] and not any(s == "odd" for s, _ in states)
