"""Frame-local geometry: column expressions, and the few operators that need a whole table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import POSITIONS, TRIAL, n_frames, xy

KEYS = ["trial_id", "frame"]
Vector = tuple[Column, Column]


def norm(v: Vector) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1])


def vector_between(a: str, b: str) -> Vector:
    """From keypoint ``a`` to keypoint ``b``."""
    (ax, ay), (bx, by) = xy(a), xy(b)
    return bx - ax, by - ay


def unit_vector(v: Vector) -> Vector:
    """v / |v|; the zero vector stays zero, missing stays missing."""
    n = norm(v)
    return tuple(F.when(n == 0, F.lit(0.0)).otherwise(c / F.nullif(n, F.lit(0.0))) for c in v)


def cross_sign(a: Vector, b: Vector) -> Column:
    return F.signum(a[0] * b[1] - a[1] * b[0])


def vector_angle(ref: Vector, test: Vector, half: bool = True, degrees: bool = False) -> Column:
    """Angle between two vectors: 0 to pi, or signed by the cross product if not ``half``. Against a zero vector it is pi/2."""
    (ax, ay), (bx, by) = unit_vector(ref), unit_vector(test)
    dot = ax * bx + ay * by
    out = F.when(dot.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    if not half:
        out = out * cross_sign(ref, test)
    return F.degrees(out) if degrees else out


def array_unit(v: Column) -> Column:
    """The same for arrays of any length."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / F.nullif(n, F.lit(0.0))))


def array_angle(a: Column, b: Column) -> Column:
    products = F.zip_with(array_unit(a), array_unit(b), lambda x, y: x * y)
    dot = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def within_angle(a: Vector, b: Vector, threshold: float) -> Column:
    """angle(a, b) >= threshold without acos, which engines round differently. A missing vector gives null, a zero one pi/2."""
    na, nb = norm(a), norm(b)
    dot = a[0] * b[0] + a[1] * b[1]
    return F.when((na == 0) | (nb == 0), F.lit(math.pi / 2 >= threshold)).otherwise(dot <= F.lit(math.cos(threshold)) * na * nb)


def body(head: bool = False) -> Vector:
    """Tail to midpoint, or midpoint to head."""
    return vector_between("mid", "head") if head else vector_between("tail", "mid")


def ht_cross_sign() -> Column:
    return cross_sign(body(), body(True))


def head_angle(half: bool = False) -> Column:
    return vector_angle(body(), body(True), half)


def orientation(ref: tuple[float, float] = (1.0, 0.0), half: bool = True, head: bool = False) -> Column:
    return vector_angle((F.lit(ref[0]), F.lit(ref[1])), body(head), half)


def custom_orientation(a: str = "mid", b: str = "head", ref: tuple[float, float] = (1.0, 0.0), half: bool = True) -> Column:
    return vector_angle((F.lit(ref[0]), F.lit(ref[1])), vector_between(a, b), half)


def bearing(source: Vector, half: bool = True, head: bool = False) -> Column:
    """Angle between the way from the centroid to the source and the body."""
    x, y = xy("ctr")
    return vector_angle((source[0] - x, source[1] - y), body(head), half)


def distance_from(key: str, x0: float, y0: float) -> Column:
    x, y = xy(key)
    return norm((x - x0, y - y0))


def delta_in_frame(a: str, b: str) -> Column:
    return norm(vector_between(a, b))


def overlaps(a: str, b: str, tolerance: float = 0) -> Column:
    """Exact equality of both coordinates, or a distance under the tolerance if there is one. Missing points do not overlap."""
    (ax, ay), (bx, by) = xy(a), xy(b)
    same = (ax == bx) & (ay == by) if tolerance <= 0 else delta_in_frame(a, b) < tolerance
    return F.coalesce(same, F.lit(False))


def where_frames(frames: DataFrame, condition: Column) -> DataFrame:
    return frames.where(condition).select(*KEYS)


def time_axis(fps: Column) -> Column:
    """n points from 0 to n / fps, both included."""
    n = n_frames()
    return F.col("frame") * (n / fps) / F.nullif(n - 1, F.lit(0))


def time_slice(frames: DataFrame, start: float, end: float, fps: Column) -> DataFrame:
    """Frames from start * fps to end * fps - 1."""
    return frames.where((F.col("frame") >= F.lit(start) * fps) & (F.col("frame") <= F.lit(end) * fps - 1))


def first_valid_position(frames: DataFrame, key: str = "ctr") -> DataFrame:
    """First non-missing x and, independently, y of a keypoint in each trial."""
    return frames.groupBy("trial_id").agg(*[F.min_by(c, F.when(c.isNotNull(), F.col("frame"))).alias(n) for c, n in zip(xy(key), (f"x{key}", f"y{key}"))])


def stimulus_scale(column: str = "stimulus") -> Column:
    """Share of the trial's maximum; a maximum of zero counts as one."""
    top = F.max(column).over(TRIAL())
    return F.col(column) / F.when(top == 0, F.lit(1.0)).otherwise(top)


def event_vector(activity: DataFrame, column: str = "duration", stop: bool = True) -> DataFrame:
    return activity.where((F.col("duration") > 0) & (F.col("stop") == int(stop))).select(*KEYS, column)


def nan_to_zero(c: Column) -> Column:
    """Missing, not a number and infinite become zero."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def round_positions(frames: DataFrame) -> DataFrame:
    """One decimal, halves to even, in all position, box and stimulus columns that are there."""
    names = [c for c in [*POSITIONS, "stimulus", "xmin", "ymin", "xmax", "ymax"] if c in frames.columns]
    return frames.withColumns({c: F.rint(F.col(c) * 10) / 10 for c in names})
