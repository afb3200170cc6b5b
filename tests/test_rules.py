"""Rules on a made street that runs down the picture at x = 500: paths through points (t, x, y) at 10 Hz, on both sides of the thresholds."""

from __future__ import annotations

import numpy as np
import pytest

from kerbside.operators import scene as S
from kerbside.operators.kinematics import observations, usable
from kerbside.rules import Context, Layout
from kerbside.rules.conflicts import accident, near_miss
from kerbside.rules.crossing import failure_to_yield
from kerbside.rules.flow import congestion, wrong_way
from kerbside.rules.junction import illegal_turn, red_light, solid_line, stop_line, u_turn
from kerbside.rules.pedestrians import jaywalking
from kerbside.rules.stationary import fire_smoke, road_obstacle, stopped_vehicle

SCHEMA = "video_id string, tid bigint, kind string, t_us bigint, x1 double, y1 double, x2 double, y2 double"


STREET, PACE = 500.0, 120.0


def path(tid, *points, kind="car", wide=80.0, tall=50.0):
    times = [round(t * 10) for t, _, _ in points]
    rows = []
    for tick in range(times[0], times[-1] + 1):
        x, y = (float(np.interp(tick, times, [p[i] for p in points])) for i in (1, 2))
        rows.append(("v", tid, kind, tick * 100_000, x - wide / 2, y - tall, x + wide / 2, y))
    return rows


def person(tid, *points):
    return path(tid, *points, kind="person", wide=30.0, tall=80.0)


def stream(n=30, x=STREET, every=2.0, first=1000):
    """Cars down the street, one after the other."""
    return [row for i in range(n) for row in path(first + i, (i * every, x, 0), (i * every + 720 / PACE, x, 720))]


def context(spark, rows, prior=None, layout=Layout(), duration=120.0, **more):
    obs = usable(observations(spark.createDataFrame(rows, SCHEMA))).cache()
    grids = None
    if prior is not None:
        cells = S.with_cells(usable(observations(spark.createDataFrame(prior, SCHEMA))))
        grids = S.grid(cells), S.heading_votes(cells)
    return Context(obs, spark.createDataFrame([("v", duration)], "video_id string, duration double"), layout, grids, **more)


def found(df):
    return sorted((round(r["start"], 2), round(r["end"], 2), tuple(r["tids"])) for r in df.collect())


def area(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_wrong_way(spark):
    base = stream(60, every=1.0)
    up = path(7, (40, STREET, 700), (45.5, STREET, 40))
    brief = path(8, (40, STREET, 600), (42, STREET, 360))  # under 2.5 s
    [(start, end, tids)] = found(wrong_way(context(spark, base + up + brief, base)))
    assert start < 41.5 and end == 45.5 and tids == (7,)
    assert found(wrong_way(context(spark, base, base))) == []


def test_u_turn(spark):
    ways = [{"name": "down", "poly": area(300, 100, 400, 600)}, {"name": "up", "poly": area(700, 100, 800, 600)}]
    turn = lambda wait: path(1, (0, 350, 100), (4, 350, 560), (6, 550, 650), (6 + wait, 550, 650), (8 + wait, 750, 560), (12 + wait, 750, 100))
    [(start, end, _)] = found(u_turn(context(spark, turn(0), layout=Layout(carriageways=ways))))
    assert 4.1 < start < 4.9 and 8.1 < end < 9.1
    assert found(u_turn(context(spark, turn(24), layout=Layout(carriageways=ways)))) == []
    assert found(u_turn(context(spark, turn(0), layout=Layout(carriageways=ways, u_turn_allowed=[area(450, 550, 650, 719)])))) == []
    assert found(u_turn(context(spark, path(1, (0, 350, 0), (6, 350, 720)), layout=Layout(carriageways=ways)))) == []


@pytest.mark.parametrize(("leaves", "n"), [(20.5, 1), (16.5, 0)])
def test_stopped_vehicle(spark, leaves, n):
    rows = stream(x=STREET + 20) + path(1, (5, STREET, 0), (8, STREET, 330), (leaves, STREET, 330), (leaves + 3, STREET, 720))
    got = found(stopped_vehicle(context(spark, rows)))
    assert len(got) == n
    if n:
        assert abs(got[0][0] - 8) < 1.2 and abs(got[0][1] - leaves) < 1.2


def test_jaywalking(spark):
    cars = [row for k, x in enumerate((460.0, 500.0, 540.0)) for row in stream(x=x, first=1000 + 100 * k)]
    [(start, _, tids)] = found(jaywalking(context(spark, cars + person(3, (15, 400, 360), (19.8, 640, 360)))))
    assert 15 <= start <= 18 and tids == (3,)
    assert found(jaywalking(context(spark, cars + person(3, (15, 900, 100), (25, 900, 600))))) == []
    halves = person(4, (15, 400, 360), (17.4, 520, 360)) + person(9, (17.6, 528, 364), (19.8, 640, 364))
    [(_, _, tids)] = found(jaywalking(context(spark, cars + halves)))
    assert tids == (4, 9)


def test_accident(spark):
    front = path(1, (0, STREET, 200), (3, STREET, 350), (4, STREET, 375), (14, STREET, 377))
    into = path(2, (0, STREET, -400), (4, STREET, 341), (14, STREET, 342))
    ctx = context(spark, front + into)
    [(start, _, tids)] = found(accident(ctx))
    assert 3.5 < start < 4.6 and tids == (1, 2)
    assert found(near_miss(ctx)) == []


HARD = [(0, -250), (1.5, 200), (1.75, 265.6), (2.0, 312.5), (2.25, 340.6), (2.5, 350), (10, 365)]  # 3.2 sizes/s2, and on at a walk (a standing box has no heading)
SOFT = [(0, -300), (1.5, 150), (1.9, 255), (2.3, 330), (2.7, 375), (3.1, 396), (3.9, 410), (10, 425)]  # 2 sizes/s2, and on at a walk


@pytest.mark.parametrize(("way", "n"), [(HARD, 1), (SOFT, 0)])
def test_near_miss(spark, way, n):
    ctx = context(spark, path(1, (0, STREET, 500), (10, STREET, 500)) + path(2, *[(t, STREET, y) for t, y in way]))
    got = found(near_miss(ctx))
    assert len(got) == n and all(1.0 < start < 2.3 for start, _, _ in got)
    assert found(accident(ctx)) == []


def test_congestion(spark):
    free = stream(60, every=1.0)
    queue = [row for i in range(8) for row in path(i, (10, STREET, 90 + 80 * i), (70, STREET, 96 + 80 * i))]
    [(start, end, _)] = found(congestion(context(spark, queue, free)))
    assert start <= 11 and end >= 69
    assert found(congestion(context(spark, queue[: 5 * len(queue) // 8], free))) == []  # five vehicles
    assert found(congestion(context(spark, free, free))) == []


def test_turns_and_markings(spark):
    layout = Layout(prohibited_turns=[{"from": area(450, 100, 550, 200), "to": area(450, 450, 550, 550)}], solid_lines=[[(600, 0), (600, 300), (600, 700)]])
    [(start, end, _)] = found(illegal_turn(context(spark, path(1, (0, STREET, 0), (6, STREET, 720)), layout=layout)))
    assert 1.5 < start < 1.9 and 4.3 < end < 4.8
    assert found(illegal_turn(context(spark, path(1, (0, 800, 0), (6, 800, 720)), layout=layout))) == []
    [(start, end, _)] = found(solid_line(context(spark, path(1, (0, 540, 100), (4, 680, 500)), layout=layout)))
    assert 1.2 < start < 1.8 and 2.2 < end < 2.8
    assert found(solid_line(context(spark, path(1, (0, 540, 100), (4, 560, 500)), layout=layout))) == []


def lamp(spark, *changes, until=60):
    """Red from, green from, ...: a sample each second."""
    rows = [("v", "s", float(t), sum(c <= t for c in changes) % 2 == 1) for t in range(until)]
    return spark.createDataFrame(rows, "video_id string, signal string, t double, red boolean")


JUNCTION = Layout(stop_lines=[{"name": "l", "a": (600, 360), "b": (400, 360), "approach_sign": 1, "signal": "s"}], intersection=area(400, 420, 600, 560))


@pytest.mark.parametrize(("changes", "n"), [((5, 30), 1), ((12, 40), 1), ((13, 40), 0), ((5, 14), 0), ((25, 40), 0)])  # red for a second before, for two after
def test_red_light(spark, changes, n):
    got = found(red_light(context(spark, path(1, (10, STREET, 0), (16, STREET, 720)), layout=JUNCTION, signals=lamp(spark, *changes))))
    assert len(got) == n and all(12.4 < start < 13.0 and 14.4 < end < 15.0 for start, end, _ in got)


@pytest.mark.parametrize(("late", "n"), [(2, 2), (3, 0)])
def test_a_lamp_that_drivers_contradict(spark, late, n):
    """Of eight passes a quarter may be on red; passes in the first second of red don't count against it."""
    cars = [row for i in range(8 - late) for row in path(10 + i, (4 * i, STREET, 0), (4 * i + 6, STREET, 720))]
    cars += [row for i in range(late) for row in path(30 + i, (40 + 3 * i, STREET, 0), (46 + 3 * i, STREET, 720))]
    assert len(found(red_light(context(spark, cars, layout=JUNCTION, signals=lamp(spark, 36))))) == n


def test_stop_line(spark):
    stand = path(1, (10, STREET, 0), (13.2, STREET, 384), (25, STREET, 384), (28, STREET, 720))
    [(start, end, _)] = found(stop_line(context(spark, stand, layout=JUNCTION, signals=lamp(spark, 5, 30))))
    assert 13 < start < 14.5 and end == 30
    assert found(stop_line(context(spark, stand, layout=JUNCTION, signals=lamp(spark, 40)))) == []


def test_failure_to_yield(spark):
    cars = stream(40, every=1.5)
    layout = Layout(crossings=[area(430, 300, 570, 400)], road_areas=[area(430, 0, 570, 720)])
    got = found(failure_to_yield(context(spark, cars + person(1, (20, 470, 350), (26, 530, 350)), cars, layout)))
    assert got and all(18 < start < 28 for start, _, _ in got)
    assert found(failure_to_yield(context(spark, cars, cars, layout))) == []


def test_animals(spark):
    cars = stream()
    animal = lambda x: path(1, (20, x, 300), (24, x + 20, 340), kind="animal", wide=40.0, tall=30.0)
    assert len(found(road_obstacle(context(spark, cars + animal(STREET), cars)))) == 1
    assert found(road_obstacle(context(spark, cars + animal(900), cars))) == []


SMOKE = (400, 150, 520, 300)


@pytest.mark.parametrize(("box", "conf", "hits", "n"), [(SMOKE, 0.7, range(30, 48), 1), (SMOKE, 0.7, (5, 22, 41), 0), (SMOKE, 0.45, range(60), 0), ((0, 0, 1280, 720), 0.7, range(60), 0)])
def test_fire_smoke(spark, box, conf, hits, n):
    samples = spark.createDataFrame([("v", float(t)) for t in range(60)], "video_id string, t double")
    boxes = spark.createDataFrame([("v", float(t), *map(float, box), conf, 1) for t in hits], "video_id string, t double, x1 double, y1 double, x2 double, y2 double, conf double, cls int")
    got = found(fire_smoke(context(spark, stream(3), duration=60.0, fire=(samples, boxes))))
    assert len(got) == n and all(27 <= start <= 31 and 46 <= end <= 48.5 for start, end, _ in got)


def test_lights_of_a_vehicle_are_no_fire(spark):
    samples = spark.createDataFrame([("v", float(t)) for t in range(60)], "video_id string, t double")
    boxes = spark.createDataFrame([("v", float(t), 470.0, 420.0, 530.0, 480.0, 0.75, 0) for t in range(25, 40)], "video_id string, t double, x1 double, y1 double, x2 double, y2 double, conf double, cls int")
    assert found(fire_smoke(context(spark, path(1, (0, STREET, 500), (60, STREET, 500), wide=180.0, tall=110.0), duration=60.0, fire=(samples, boxes)))) == []
