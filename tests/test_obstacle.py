"""Static changes of the picture as road obstacles, and animals in the registered query."""

from __future__ import annotations

import os

import numpy as np
import pytest
from test_rules import context, found, path, stream

from kerbside.plans import registry
from kerbside.rules.stationary import has_blob, road_obstacle

W, H = 64, 36


def pictures(spark, place=(30, 19), times=range(20, 45), bright=range(0), seconds=80):
    """A striped picture with a light square of 4 x 4 at `place` during `times`."""
    x, y = place
    rows = [("v", float(t), px, py, float(60 + 10 * ((px + py) % 5) + (120 if t in times and x <= px < x + 4 and y <= py < y + 4 else 0) + (60 if t in bright else 0))) for t in range(seconds) for px in range(W) for py in range(H)]
    return spark.createDataFrame(rows, "video_id string, t double, px int, py int, gray double").repartition(4, "px").cache(), W, H


@pytest.mark.parametrize(("more", "user", "n"), [({}, False, 1), ({"place": (4, 19)}, False, 0), ({"times": range(20, 22)}, False, 0), ({}, True, 0), ({"bright": range(18, 55)}, False, 0)])
def test_static_change(spark, more, user, n):
    cars = stream(x=640)
    rows = stream(1, x=640) + (path(1, (15, 640, 420), (60, 641, 420), kind="person", wide=160.0, tall=120.0) if user else [])
    got = found(road_obstacle(context(spark, rows, cars, pixels=pictures(spark, **more))))
    assert len(got) == n
    if n:
        [(start, end, tids)] = got
        assert (start, end, tids) == (20.0, 48.0, ())  # 5 of 9 frames from 24 to 48, less 4 seconds


def test_blobs():
    square = {(x, y) for x in range(3) for y in range(3)}
    assert has_blob(square, W, H, 0.0006, 0.05) and not has_blob(square, 10, 10, 0.0006, 0.05)
    assert not has_blob({(x, 5) for x in range(40)}, W, H, 0.0006, 0.05)


def test_blobs_against_a_search():
    """Random pictures: opened, then parts by a search from each pixel."""
    rng = np.random.default_rng(3)
    for n in range(40):
        w, h = int(rng.integers(4, 30)), int(rng.integers(4, 20))
        pixels = {(int(x), int(y)) for y, x in np.argwhere(rng.random((h, w)) < (0.8, 0.93)[n % 2])}
        near = lambda p: [(p[0] + dx, p[1] + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if 0 <= p[0] + dx < w and 0 <= p[1] + dy < h]  # noqa: B023, E731
        left, sizes = {q for p in pixels if all(x in pixels for x in near(p)) for q in near(p)}, []
        while left:
            part, todo = set(), [left.pop()]
            while todo:
                p = todo.pop()
                part.add(p)
                new = left.intersection(near(p))
                left -= new
                todo += new
            sizes.append(len(part) / (w * h))
        for least, most in ((0.0, 0.1), (0.05, 0.3), (0.5, 1.0)):
            assert has_blob(pixels, w, h, least, most) == any(least <= x <= most for x in sizes)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the given tables")
def test_registered_query_has_rows(spark):
    assert registry.QUERIES["rule_road_obstacle"](spark, "/root/testdata/sf0.01").count() > 0
