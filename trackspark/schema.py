"""Names and conventions that every operator shares.

A ``frames`` table has one row per video frame: ``trial_id``, ``frame`` (0-based, contiguous in a trial) and DOUBLE
positions. Missing values are NULL, never NaN. Segments hold inclusive ends. All windows are partitioned by
trial, so one shuffle by ``trial_id`` serves a chain of operators.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .names import BOX, KEYPOINTS, POSITIONS, RAW_COLUMNS, STIMULUS_COLUMNS

__all__ = ["AFTER", "BEFORE", "BOX", "KEYPOINTS", "POSITIONS", "RAW_COLUMNS", "SO_FAR", "STIMULUS_COLUMNS", "TRIAL", "W", "is_last", "n_frames", "xy"]


def TRIAL() -> WindowSpec:
    """The row's whole trial. Windows are functions, as a window needs a running session."""
    return Window.partitionBy("trial_id")


def W() -> WindowSpec:
    return TRIAL().orderBy("frame")


def SO_FAR() -> WindowSpec:
    return W().rowsBetween(Window.unboundedPreceding, 0)


def BEFORE() -> WindowSpec:
    return W().rowsBetween(Window.unboundedPreceding, -1)


def AFTER() -> WindowSpec:
    """The rows after this one, the nearest last. The order is turned, as Spark reads a window to a partition's end anew for every row."""
    return TRIAL().orderBy(F.col("frame").desc()).rowsBetween(Window.unboundedPreceding, -1)


def xy(key: str) -> tuple[Column, Column]:
    return F.col(f"x{key}"), F.col(f"y{key}")


def n_frames() -> Column:
    """Frames of the row's trial."""
    return F.count(F.lit(1)).over(TRIAL())


def is_last() -> Column:
    return F.col("frame") == n_frames() - 1
