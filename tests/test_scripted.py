"""Every rule on the scripted videos of the given customers: its own scenes have its events at the scripted times, no other scene has more than the script implies."""

from __future__ import annotations

import os
from collections import defaultdict

import pytest

from kerbside.plans import registry, scripted
from kerbside.rules import RULES, run_rules

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")

#: Of each label: the scene, the first and last second of its start and its end in the script's time, and scenes that have it by the way.
EXPECTED = {
    "accident": ("accident", (3.5, 4.6), (4.5, 6.0), ()),
    "near_miss": ("near_miss", (1.0, 2.6), (9.0, 10.6), ()),
    "congestion": ("congestion", (10, 11), (95, 97), ()),
    "illegal_u_turn": ("illegal_u_turn", (4.1, 4.9), (8.1, 9.1), ()),
    "jaywalking": ("jaywalking", (15.5, 17.0), (17.5, 19.0), ()),
    "stop_line": ("stop_line", (13.0, 14.5), (28.0, 30.1), ("accident", "near_miss", "congestion")),
    "failure_to_yield": ("failure_to_yield", (6.0, 15.5), (7.0, 16.5), ()),
    "stopped_vehicle": ("stopped_vehicle", (7.5, 9.0), (19.5, 21.6), ("stop_line",)),
    "wrong_way": ("wrong_way", (10.0, 13.0), (13.0, 15.6), ()),
    "red_light": ("red_light", (12.4, 13.0), (14.4, 15.0), ("stopped_vehicle", "stop_line")),
    "illegal_turn": ("illegal_turn", (3.0, 4.0), (5.5, 7.0), ()),
    "solid_line_crossing": ("illegal_turn", (3.0, 4.0), (3.5, 5.5), ()),
    "road_obstacle": ("road_obstacle", (19.9, 21.5), (22.5, 24.1), ()),
    "fire_smoke": ("road_obstacle", (29, 31), (46, 48.5), ()),
}


@pytest.fixture(scope="module")
def ctx(spark):
    return scripted.scripted_context(spark, SF)


def scene_of(video: str) -> tuple[str, float]:
    number = int(video[1:])
    return scripted.SCENES[number % len(scripted.SCENES)], number * 7 % 20 / 10


@pytest.mark.parametrize("label", sorted(RULES))
def test_rule_has_its_scenes(ctx, label):
    scene, starts, ends, others = EXPECTED[label]
    videos = {r["video_id"] for r in ctx.videos.collect()}
    found = defaultdict(list)
    for r in RULES[label](ctx).collect():
        found[r["video_id"]].append((r["start"], r["end"]))
    own = {v for v in videos if scene_of(v)[0] == scene}
    whole = {v for v in own if v != max(videos, key=lambda x: int(x[1:]))}  # the last video may lack parts
    assert whole <= set(found) and len(whole) >= 9
    assert {scene_of(v)[0] for v in found} <= {scene, *others}
    for v in whole:
        later = scene_of(v)[1]
        for start, end in found[v]:
            assert starts[0] <= start - later <= starts[1] and (ends[0] <= end - later <= ends[1] or label == "stop_line" and end == 30.0), (v, start - later, end - later)


def test_all_rules_in_one_run(ctx, spark):
    failed = {}
    found = run_rules(ctx, failed=failed).collect()
    assert not failed and {r["label"] for r in found} == set(RULES) and all(r["score"] == 1.0 and r["start"] < r["end"] <= 120 for r in found)
    some = run_rules(ctx, ["road_obstacle", "solid_line_crossing"]).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in found if r["label"] in ("road_obstacle", "solid_line_crossing"))


def test_a_failing_rule_costs_no_other(ctx, monkeypatch):
    def broken(_):
        raise ValueError("no plan")

    monkeypatch.setitem(RULES, "accident", broken)
    failed = {}
    assert run_rules(ctx, ["accident", "road_obstacle"], failed).count() > 0 and list(failed) == ["accident"]
    with pytest.raises(ValueError):
        run_rules(ctx, ["accident"])


def test_registered_rules_have_rows(spark):
    assert registry.QUERIES["rule_jaywalking"](spark, SF).where("label = 'jaywalking'").count() > 0
