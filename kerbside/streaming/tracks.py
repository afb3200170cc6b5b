"""Streams: tracking with state, and sessions with a watermark."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kerbside.operators.tracking import OUT, Tracker, track_frames


def track_stream(detections: DataFrame) -> DataFrame:
    """Tracks of a stream of detections; each video's frames must come in time order, as frames do."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker()
        yield track_frames(tracker, pd.concat(parts))
        state.update((pickle.dumps(tracker),))

    return detections.groupBy("video_id").applyInPandasWithState(step, OUT, "tracker binary", "append", GroupStateTimeout.NoTimeout)


def session_stream(samples: DataFrame, keys: list[str], time: str, gap: str, lateness: str = "0 seconds") -> DataFrame:
    """Runs of a stream's samples with gaps under `gap`: start, end (of the last sample) and n, given once the watermark has passed."""
    marked = samples.withWatermark(time, lateness)
    runs = marked.groupBy(*keys, F.session_window(time, gap)).agg(F.count("*").alias("n"), F.max(time).alias("end"))
    return runs.select(*keys, F.col("session_window.start").alias("start"), "end", "n")
