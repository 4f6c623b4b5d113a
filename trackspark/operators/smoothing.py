"""Smoothing of the eight position columns.

Finite filters are window expressions over reflect-padded rows: taps are lags of a column, or, for medians and means, one ``collect_list``
of the eight columns for each frame and higher-order functions. With ``chunk`` a trial is cut into chunks with a halo, so one very
long trial is spread over tasks. Recurrences (Butterworth, Kalman) run in chunks too, see ``recurrence``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import POSITIONS, W, n_frames
from .recurrence import CHUNK, butterworth, kalman


def gaussian_taps(sigma: float) -> list[float]:
    """Normalised taps out to int(4 sigma + 0.5) on both sides."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def sgolay_taps(window: int, order: int) -> np.ndarray:
    """Row p: taps that give the value at place p of the polynomial fitted to a window of samples."""
    a = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return a @ np.linalg.pinv(a)


def reflect_padded(frames: DataFrame, left: int, right: int) -> DataFrame:
    """The frames and, before and after them, mirrored rows: frame -k is k - 1, frame n - 1 + k is n - k. Adds n.

    Places repeat with a period of 2 n, so a trial shorter than a pad is mirrored as often as it takes.
    """
    at, n = F.col("frame"), F.col("n")
    once = F.array_compact(F.array(at, F.when(at < left, -1 - at), F.when(at >= n - right, 2 * n - 1 - at)))
    periods = F.sequence(-F.floor(F.lit(left) / (2 * n)) - 1, F.floor(F.lit(right) / (2 * n)) + 1)
    places = F.flatten(F.transform(periods, lambda k: F.array(at + 2 * n * k, 2 * n * k - 1 - at)))
    often = F.filter(places, lambda p: (p >= -left) & (p < n + right))
    # Each row goes to its own place and the mirrored ones, so the input is read once.
    return frames.withColumn("n", n_frames()).withColumn("frame", F.explode(F.when(n >= max(left, right), once).otherwise(often)))


def with_halo(padded: DataFrame, chunk: int, left: int, right: int) -> DataFrame:
    """Rows dealt to chunks of frames (column ``chunk``), each with the rows of its halo, which repeat."""
    number = lambda c: F.floor(c / chunk)
    chunks = F.sequence(number(F.col("frame") - right), number(F.col("frame") + left))
    return padded.withColumn("chunk", F.explode(chunks))


def _padded(frames: DataFrame, left: int, right: int, chunk: int | None) -> tuple[DataFrame, WindowSpec]:
    """Reflect-padded rows, those of a chunk with its halo, and the window that orders them."""
    rows, keys = reflect_padded(frames, left, right), ["trial_id"]
    if chunk:
        rows, keys = with_halo(rows, chunk, left, right), ["trial_id", "chunk"]
    return rows, Window.partitionBy(*keys).orderBy("frame")


def _inner(rows: DataFrame, chunk: int | None) -> DataFrame:
    """Without the rows that were added."""
    rows = rows.where((F.col("frame") >= 0) & (F.col("frame") < F.col("n")))
    return rows.where(F.floor(F.col("frame") / chunk) == F.col("chunk")) if chunk else rows


def _windowed(frames: DataFrame, left: int, right: int, of, chunk: int | None = None, prefix: str = "") -> DataFrame:
    """Position columns replaced by ``of(list of rows, name)`` over frames -left to right, reflected at the ends; with a prefix, added under new names."""
    columns = [c for c in POSITIONS if c in frames.columns]
    rows, window = _padded(frames, left, right, chunk)
    rows = _inner(rows.withColumn("_near", F.collect_list(F.struct(*columns)).over(window.rowsBetween(-left, right))), chunk)
    return rows.withColumns({prefix + c: of(F.col("_near"), c) for c in columns}).select(*frames.columns, *[prefix + c for c in columns if prefix])


def filter_gaussian(frames: DataFrame, sigma: float = 3, chunk: int | None = None, prefix: str = "", columns: list[str] | None = None) -> DataFrame:
    """Gaussian smoothing; a missing sample makes all values in its reach missing. With a prefix the smoothed columns are added. ``columns``: those to smooth, if not all."""
    taps, r = gaussian_taps(sigma), int(4 * sigma + 0.5)
    own = [c for c in POSITIONS if c in frames.columns and (columns is None or c in columns)]
    rows, window = _padded(frames, r, r, chunk)
    # Every tap is the row so many places away: no list of neighbours is made for a frame. Missing samples are NaN in the sum, which asks for no test at each tap.
    nan = float("nan")
    rows = rows.withColumns({f"_{c}": F.coalesce(F.col(c), F.lit(nan)) for c in own})
    taken = rows.select("*", *[F.lag(f"_{c}", r - i, nan).over(window).alias(f"_{i}_{c}") for c in own for i in range(len(taps))])
    summed = {}
    for c in own:
        total = F.lit(0.0)
        for i, w in enumerate(taps):
            total = total + F.col(f"_{i}_{c}") * F.lit(w)
        summed[prefix + c] = F.nanvl(total, F.lit(None).cast("double"))
    return _inner(taken, chunk).withColumns(summed).select(*frames.columns, *[prefix + c for c in own if prefix])


def filter_default(frames: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return filter_gaussian(frames, 3, columns=columns)


def _reach(win: int) -> tuple[int, int]:
    return win // 2, win - 1 - win // 2


def filter_mean(frames: DataFrame, win: int = 5) -> DataFrame:
    """Centred mean; an even window reaches one further to the left."""
    return _windowed(frames, *_reach(win), lambda near, c: F.aggregate(near, F.lit(0.0), lambda s, p: s + p[c]) / win)


def _median(near: Column, c: str, win: int) -> Column:
    values = F.transform(near, lambda p: p[c])
    return F.when(~F.exists(values, lambda x: x.isNull()), F.element_at(F.sort_array(values), win // 2 + 1))


def filter_median(frames: DataFrame, win: int = 5) -> DataFrame:
    return _windowed(frames, *_reach(win), lambda near, c: _median(near, c, win))


def filter_meanmed(frames: DataFrame, med_win: int = 15, mean_win: int | None = None) -> DataFrame:
    return filter_mean(filter_median(frames, med_win), mean_win or med_win)


def filter_med_gaussian(frames: DataFrame, sigma: float = 3, win: int = 5) -> DataFrame:
    return filter_gaussian(filter_median(frames, win), sigma)


def filter_sgolay(frames: DataFrame, window: int = 45, order: int = 4) -> DataFrame:
    """Polynomial smoothing; at the ends the polynomial of the first or last window is used. Trials shorter than the window give nulls."""
    columns = [c for c in POSITIONS if c in frames.columns]
    kernels = frames.sparkSession.createDataFrame([(p, [float(x) for x in row]) for p, row in enumerate(sgolay_taps(window, order))], "_place long, _taps array<double>")
    reach = window - 1
    rows = frames.withColumn("_n", n_frames()).withColumn("_near", F.collect_list(F.struct(*columns)).over(W().rowsBetween(-reach, reach)))
    start = F.greatest(F.lit(0), F.least(F.col("frame") - window // 2, F.col("_n") - window))
    rows = rows.withColumn("_place", F.col("frame") - start).withColumn("_near", F.slice("_near", (start - F.greatest(F.lit(0), F.col("frame") - reach) + 1).cast("int"), F.lit(window)))
    rows = rows.join(F.broadcast(kernels), "_place", "left")
    fitted = lambda c: F.when(F.col("_n") >= window, F.aggregate(F.zip_with("_near", "_taps", lambda p, w: p[c] * w), F.lit(0.0), lambda s, x: s + x))
    return rows.withColumns({c: fitted(c) for c in columns}).select(*frames.columns)


def filter_butter(frames: DataFrame, fps: float, cutoff: float, order: int = 5, chunk: int = CHUNK) -> DataFrame:
    """Causal Butterworth low-pass. A missing sample makes the rest of its column missing. A recurrence, in chunks of frames that run in tasks of their own."""
    return butterworth(frames, [c for c in POSITIONS if c in frames.columns], fps, cutoff, order, chunk)


def filter_kalman(frames: DataFrame, fps: float, derivatives: int = 2, reset_covariance: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Constant-derivative Kalman filter of each keypoint, frames with a missing coordinate left out. A recurrence, in chunks of frames that run in tasks of their own."""
    return kalman(frames, fps, derivatives, reset_covariance, chunk)
