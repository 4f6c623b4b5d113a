"""Frames as a stream: stateful operators keyed by trial.

State is small (filters' vectors and numbers of updates, or the last frame's points) and lives in the RocksDB provider. Every batch that
brings rows of a trial sets its timer anew; when a trial has been silent for ``idle_ms`` of processing time, the timer drops its state, and a trial that
returns after that begins anew. A running query looks at its timers in every batch, with data or without. Under the trigger availableNow batches without data would follow each other
without end, so turn them off there (``without_empty_batches``); timers then ring when the next data come. Rows of a micro-batch are put in frame order; a frame that is not after the last one seen is late and left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.numerics import GainTable
from ..names import KEYPOINTS, POSITIONS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds without rows of a trial after which its state is dropped.
IDLE_MS = 3_600_000


def _ordered(rows: Iterator[pd.DataFrame], last: int) -> pd.DataFrame:
    """New frames of a micro-batch in order, the first of repeated ones."""
    all_ = pd.concat(list(rows)).sort_values("frame", kind="stable").drop_duplicates("frame")
    return all_[all_["frame"] > last]


class TrialProcessor(StatefulProcessor):
    """One value of state a trial, which expires. ``due`` is the time at which the trial's timer rings."""

    #: Name and schema of the state.
    STATE, SCHEMA = "", ""

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(self.STATE, f"due long, {self.SCHEMA}")

    def held(self, now: int) -> tuple | None:
        """The trial's state; none if it has been silent for so long that its timer is due, even if that has yet to ring."""
        if not self.state.exists():
            return None
        due, *rest = self.state.get()
        self.handle.deleteTimer(due)
        return tuple(rest) if now < due else None

    def hold(self, now: int, *values: object) -> None:
        due = now + self.idle_ms
        self.handle.registerTimer(due)
        self.state.update((due, *values))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class KalmanProcessor(TrialProcessor):
    """Filters all keypoints of a trial together, frame by frame. Gains depend on the number of updates alone, so that is what is kept of a filter, beside its vector."""

    STATE, SCHEMA = "filters", "last long, updates array<long>, x array<double>"

    def __init__(self, fps: float, derivatives: int = 2, idle_ms: int = IDLE_MS):
        super().__init__(idle_ms)
        self.fps, self.derivatives = fps, derivatives

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.table = GainTable(self.fps, self.derivatives)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentProcessingTimeInMs()
        size = len(KEYPOINTS)
        last, updates, x = -1, np.zeros(size, int), np.zeros((self.derivatives + 1, 2 * size))
        if (held := self.held(clock)) is not None:
            last, updates, x = held[0], np.array(held[1], int), np.array(held[2], float).reshape(x.shape)
        new = _ordered(rows, last)
        points = new[POSITIONS].to_numpy(float)
        known = ~np.isnan(points.reshape(-1, size, 2)).any(axis=2)
        ahead = updates + np.cumsum(known, axis=0) - known
        for i in np.flatnonzero((updates == 0) & known.any(axis=0)):
            x[0, 2 * i : 2 * i + 2] = points[known[:, i].argmax(), 2 * i : 2 * i + 2]
        self.table.upto(int(ahead.max(initial=0)) + 1)
        gains = np.array(self.table.gains)
        # (frames, states, columns): both coordinates of a point have its gain.
        gains = gains[np.minimum(ahead, len(gains) - 1)].transpose(0, 2, 1).repeat(2, axis=2)
        f, known_, whole = self.table.filter.f, known.repeat(2, axis=1), known.all(axis=1).tolist()
        for row, gain, now, all_ in zip(points, gains, known_, whole):
            moved = f @ x
            moved += gain * (row - moved[0])
            if all_:
                x = moved
                row[:] = x[0]
            else:
                x = np.where(now, moved, x)
                row[now] = x[0, now]
        # A batch of late frames alone keeps the trial alive too.
        self.hold(clock, int(new["frame"].iloc[-1]) if len(new) else last, (updates + known.sum(axis=0)).tolist(), x.ravel().tolist())
        if len(new):
            yield pd.DataFrame({"trial_id": key[0], "frame": new["frame"].to_numpy(), **{c: points[:, i] for i, c in enumerate(POSITIONS)}})


class FlagProcessor(TrialProcessor):
    """Flags of each new frame against the one before: discontinuities of head and tail, crossed shortest ways."""

    STATE, SCHEMA = "last", "frame long, points array<double>"

    def __init__(self, fps: float, threshold: float, idle_ms: int = IDLE_MS):
        super().__init__(idle_ms)
        self.fps, self.threshold = fps, threshold

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentProcessingTimeInMs()
        last, before = -1, np.full(4, np.nan)
        if (held := self.held(clock)) is not None:
            last, before = held
            before = np.array([np.nan if v is None else v for v in before], float)
        new, out = _ordered(rows, last), []
        columns = ["xhead", "yhead", "xtail", "ytail"]
        for frame, now in zip(new["frame"], new[columns].to_numpy(float)):
            way = lambda a, b: float(np.hypot(now[b] - before[a], now[b + 1] - before[a + 1]))
            hh, tt, th, ht = way(0, 0), way(2, 2), way(2, 0), way(0, 2)
            if hh * self.fps > self.threshold:
                out.append((frame, "disc_head"))
            if tt * self.fps > self.threshold:
                out.append((frame, "disc_tail"))
            if not np.isnan([hh, tt, th, ht]).any() and min(th, ht) < min(tt, hh):
                out.append((frame, "mdm"))
            before, last = now, int(frame)
        self.hold(clock, last, [None if np.isnan(v) else float(v) for v in before])
        if out:
            yield pd.DataFrame({"trial_id": key[0], "frame": [f for f, _ in out], "kind": [k for _, k in out]})


@contextmanager
def without_empty_batches(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside run no batches without data."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _stateful(frames: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return frames.groupBy("trial_id").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


def stream_kalman(frames: DataFrame, fps: float = 30, derivatives: int = 2, idle_ms: int = IDLE_MS) -> DataFrame:
    """Filtered positions of every new frame. A trial's covariance is its own for each keypoint; state goes after ``idle_ms`` without rows."""
    kind = dict(frames.dtypes)["trial_id"]
    return _stateful(frames, KalmanProcessor(fps, derivatives, idle_ms), f"trial_id {kind}, frame long, " + ", ".join(f"{c} double" for c in POSITIONS))


def stream_flags(frames: DataFrame, fps: float = 30, threshold: float = 24, idle_ms: int = IDLE_MS) -> DataFrame:
    """Flags of every new frame against the one before; the frame after a silence of ``idle_ms`` has none before it."""
    kind = dict(frames.dtypes)["trial_id"]
    return _stateful(frames, FlagProcessor(fps, threshold, idle_ms), f"trial_id {kind}, frame long, kind string")
