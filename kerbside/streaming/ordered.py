"""Streams with state along each camera, behind a reorder buffer.

Frames reach a camera's kernel (tracker or risk) in time order, each once and whole: rows wait in the camera's state until a
row more than `lateness` seconds newer has come. A row of a frame that has been handed on already, or of an older one, is too
late; it comes out at once, marked `late`, so such rows can be counted or kept. A camera's own newest row sets its limit, so
a slow camera loses nothing to a fast one.

The watermark of all cameras together, `silence` seconds behind the newest row, is what ends a camera: once it passes the camera's
newest row, an event-time timer hands on what still waits and drops the state (should the camera come back, it starts anew).
Rows behind that watermark don't reach the operator; Spark counts them, see `dropped_rows`.

The input's rows are detections (video_id, t in seconds, det_idx, box, conf, cls); a frame without detections is a row with a
null conf. Results don't depend on how rows fall into micro-batches. A camera is one key: its state goes from frame to frame, so it
can't be split, and holds its live tracks, their last second and the rows of the last `lateness` seconds.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kerbside.operators.risk import LiveRisk
from kerbside.operators.tracking import BOX, OUT, Tracker, track_frames

#: Seconds that are added to times before Spark sees them: it takes rows at its epoch for late from the start.
OFFSET = 86_400
DETECTION = ["video_id", "t", "det_idx", *BOX, "conf", "cls"]


class Kernel(Protocol):
    def advance(self, frames: pd.DataFrame) -> pd.DataFrame: ...


class TrackKernel:
    columns = OUT

    def __init__(self) -> None:
        self.tracker = Tracker()

    def advance(self, frames: pd.DataFrame) -> pd.DataFrame:
        return track_frames(self.tracker, frames)


class RiskKernel:
    columns = "video_id string, t double, score double"

    def __init__(self) -> None:
        self.risk = LiveRisk()

    def advance(self, frames: pd.DataFrame) -> pd.DataFrame:
        return scored_frames(self.risk, frames)


def scored_frames(risk: LiveRisk, rows: pd.DataFrame) -> pd.DataFrame:
    """A video's detections in time order as its frames' scores."""
    out = []
    for t, frame in rows.sort_values(["t", "det_idx"]).groupby("t", sort=True):
        real = frame[frame["conf"].notna()]
        out.append((frame["video_id"].iloc[0], float(t), risk.update(real[BOX].to_numpy(float), real["conf"].to_numpy(float), real["cls"].to_numpy(int), float(t))))
    return pd.DataFrame(out, columns=["video_id", "t", "score"])


def risk_of_detections(detections: DataFrame) -> DataFrame:
    """video_id, t and score of all frames of whole videos: the stream's batch twin."""
    return detections.groupBy("video_id").applyInPandas(lambda rows: scored_frames(LiveRisk(), rows), RiskKernel.columns)


def ordered(rows: DataFrame, kernel: Callable[[], Kernel], columns: str, lateness: float, silence: float) -> DataFrame:
    """The kernel's rows for each frame in time order, and late input rows with nulls but for video_id, t and `late`."""
    if silence < lateness:
        raise ValueError("silence must be at least lateness, or rows that may still come would be dropped")
    marked = rows.select(*DETECTION).withColumn("_at", F.timestamp_seconds(F.col("t") + OFFSET)).withWatermark("_at", f"{round(silence * 1000)} milliseconds")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, waiting, newest, done = pickle.loads(state.get[0]) if state.exists else (kernel(), None, float("-inf"), float("-inf"))
        if state.hasTimedOut:
            if waiting is not None and len(waiting):
                yield own.advance(waiting).assign(late=False)
            state.remove()
            return
        new = pd.concat([p[DETECTION] for p in parts])
        late = new["t"] <= done
        if late.any():
            yield new.loc[late, ["video_id", "t"]].assign(late=True)
        waiting = pd.concat([x for x in (waiting, new[~late]) if x is not None and len(x)] or [new[:0]])
        newest = max(newest, float(new["t"].max()))
        ready = waiting["t"] < newest - lateness
        if ready.any():
            done = float(waiting.loc[ready, "t"].max())
            yield own.advance(waiting[ready]).assign(late=False)
        state.update((pickle.dumps((own, waiting[~ready], newest, done)),))
        state.setTimeoutTimestamp(max(int((newest + OFFSET) * 1000), state.getCurrentWatermarkMs()) + 1)

    names = [c.split()[0] for c in columns.split(", ")]

    def shaped(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        for out in step(key, parts, state):
            yield out.reindex(columns=[*names, "late"])

    return marked.groupBy("video_id").applyInPandasWithState(shaped, f"{columns}, late boolean", "kept binary", "append", GroupStateTimeout.EventTimeTimeout)


def ordered_tracks(detections: DataFrame, lateness: float = 2.0, silence: float = 60.0) -> DataFrame:
    """Tracks of a stream, as operators.tracking.track gives them for whole videos, and late rows."""
    return ordered(detections, TrackKernel, TrackKernel.columns, lateness, silence)


def risk_stream(detections: DataFrame, lateness: float = 2.0, silence: float = 60.0) -> DataFrame:
    """video_id, t and score of a stream's frames, as risk_of_detections gives them for whole videos, and late rows."""
    return ordered(detections, RiskKernel, RiskKernel.columns, lateness, silence)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came after their camera had been given up: behind the watermark of all cameras. Of the progress that Spark still has."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
