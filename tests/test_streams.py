"""Streams behind the reorder buffer: tracks and risk as in a batch, whatever the order and the micro-batches; late rows counted."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators.kinematics import ground, kind_of
from kerbside.operators.risk import risk_curve
from kerbside.operators.tracking import track
from kerbside.streaming.ordered import dropped_rows, ordered, ordered_tracks, risk_of_detections, risk_stream

SCHEMA = "video_id string, t double, det_idx int, x1 double, y1 double, x2 double, y2 double, conf double, cls int"


def street(video, seconds=8, seed=1):
    """Cars towards each other, one that brakes, a walker, a car out of sight for a while, and frames without detections."""
    rng, rows = random.Random(seed), []
    for k in range(seconds * 10):
        t = k / 10
        x = [60 + 150 * t, 1200 - 160 * t, 300 + 200 * min(t, 2.5) + 20 * max(t - 2.5, 0), 500 + 8 * t]
        y = [400.0, 402.0, 200.0, 410.0]
        for d in range(4):
            if k % 23 == 22 or (d == 2 and 40 <= k < 52) or (d == 0 and k in (31, 32)):
                continue
            half, tall = (15, 80) if d == 3 else (40, 50)
            jitter = rng.uniform(-1, 1)
            rows.append((video, t, d, x[d] - half + jitter, y[d] - tall, x[d] + half + jitter, y[d], 0.9 if rng.random() < 0.9 else 0.35, 0 if d == 3 else 2))
        if k % 23 == 22:
            rows.append((video, t, None, None, None, None, None, None, None))
    return rows


END = [("end", 1000.0, 0, 0.0, 0.0, 10.0, 10.0, 0.9, 2)]


def streamed(spark, tmp_path, name, make, batches):
    """All rows of a stream that reads one file a micro-batch."""
    for k, rows in enumerate([*batches, END]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/{name}/*")
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return [r for r in spark.table(name).where("video_id <> 'end'").collect()], query


def shuffled(rows, within, n, seed=3):
    """Rows out of order by less than `within` seconds, in n parts."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[1] + rng.uniform(0, within * 0.99))
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


@pytest.mark.parametrize("n", [1, 4])
def test_risk_of_shuffled_rows(spark, tmp_path, n):
    rows = street("a") + street("b", 6, 2)
    want = {(r["video_id"], r["t"]): r["score"] for r in risk_of_detections(spark.createDataFrame(rows, SCHEMA)).collect()}
    got, _ = streamed(spark, tmp_path, f"risk{n}", lambda s: risk_stream(s, 2.0, 60.0), shuffled(rows, 2.0, n))
    assert not any(r["late"] for r in got) and len(got) == len(want) == 140
    assert {(r["video_id"], r["t"]): r["score"] for r in got} == want and max(want.values()) > 0.3


def test_risk_is_the_windows(spark):
    """The kernel's scores are those of joins and windows over the same tracks."""
    detections = spark.createDataFrame(street("a"), SCHEMA)
    tracks = track(detections).select("video_id", "tid", kind_of(F.col("cls")).alias("kind"), F.round(F.col("t") * 1_000_000).cast("bigint").alias("t_us"), "x1", "y1", "x2", "y2")
    empty = detections.where("conf is null").select("video_id", F.lit(None).cast("bigint").alias("tid"), F.lit(None).cast("string").alias("kind"), F.round(F.col("t") * 1_000_000).cast("bigint").alias("t_us"), "x1", "y1", "x2", "y2")
    got = {r["t_us"]: r["score"] for r in risk_curve(ground(tracks.unionByName(empty))).collect()}
    want = {round(r["t"] * 1e6): r["score"] for r in risk_of_detections(detections).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[t], want[t], abs_tol=1e-7) for t in want)


def test_tracks_of_shuffled_rows(spark, tmp_path):
    rows = street("a") + street("b", 6, 2)
    key = lambda r: (r["video_id"], r["t"], r["tid"], r["cls"], r["x1"])
    want = sorted(map(key, track(spark.createDataFrame(rows, SCHEMA)).collect()))
    got, _ = streamed(spark, tmp_path, "tracks", lambda s: ordered_tracks(s, 1.0, 60.0), shuffled(rows, 1.0, 3))
    assert sorted(map(key, got)) == want and not any(r["late"] for r in got)


def test_late_rows_are_counted(spark, tmp_path):
    rows = street("a")
    late = [r for r in rows if r[1] == 0.3]
    kept = [r for r in rows if r[1] != 0.3]
    batches = [[r for r in kept if r[1] < 4], late, [r for r in kept if r[1] >= 4]]
    got, query = streamed(spark, tmp_path, "late", lambda s: risk_stream(s, 1.0, 60.0), batches)
    want = {r["t"]: r["score"] for r in risk_of_detections(spark.createDataFrame(kept, SCHEMA)).collect()}
    assert sum(r["late"] for r in got) == len(late) == 4 and dropped_rows(query) == 0
    assert {r["t"]: r["score"] for r in got if not r["late"]} == want


def test_rows_behind_all_cameras_are_counted(spark, tmp_path):
    """Rows more than `silence` behind the newest of all cameras: Spark's counter has them."""
    rows = street("a", 2)
    batches = [rows, [("b", 500.0, 0, 0.0, 0.0, 10.0, 10.0, 0.9, 2)], [("b", 501.0, 0, 0.0, 0.0, 10.0, 10.0, 0.9, 2)], [("a", 1.05, 9, 0.0, 0.0, 10.0, 10.0, 0.9, 2)]]
    got, query = streamed(spark, tmp_path, "behind", lambda s: risk_stream(s, 1.0, 60.0), batches)
    assert len([r for r in got if r["video_id"] == "a"]) == 20 and dropped_rows(query) == 1


def test_silence_is_no_less_than_lateness(spark):
    with pytest.raises(ValueError):
        ordered(spark.createDataFrame([], SCHEMA), lambda: None, "video_id string", 5.0, 1.0)


@pytest.mark.parametrize("marked", [True, False])
def test_a_cut_video_has_the_ids_of_the_uncut_one(spark, marked):
    """Pauses of 3 s, with frames in them or without: a standing car is found again only where no frame said that it had gone."""
    from kerbside.operators.tracking import Tracker, segments, track_frames

    rows = [(*r[:1], r[1] + 7.0 * k, *r[2:]) for k in range(3) for r in street("a", 4, k)] + [("b", t / 10, 0, 5.0, 5.0, 50.0, 50.0, 0.9, 2) for t in range(8)]
    rows += [("a", 7.0 * k + 4 + t / 10, None, None, None, None, None, None, None) for k in range(2) for t in range(30)] if marked else []
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r["video_id"], r["t"], r["tid"], r["x1"])
    want = [tuple(r) for v in "ab" for r in track_frames(Tracker(), df.where(F.col("video_id") == v).toPandas())[["video_id", "t", "tid", "x1"]].itertuples(index=False)]
    assert sorted(map(key, track(df).collect())) == sorted(want)
    assert segments(df).select("video_id", "segment").distinct().count() == (4 if marked else 2)
