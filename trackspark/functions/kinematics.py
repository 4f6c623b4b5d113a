"""Inter-frame kinematics as window expressions over (trial_id, frame)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import last_before, running_sum
from ..schema import BEFORE, SO_FAR, W, is_last, n_frames, xy
from .geometry import Vector, norm


def derivative(x: Column, points: int = 2) -> Column:
    """Per-frame derivative by 2, 3 or 5 points. Near the edges fewer points are used; the edges are told by frame number, as values may be missing."""
    lag, lead = (lambda k: F.lag(x, k).over(W())), (lambda k: F.lead(x, k).over(W()))
    first, last = F.col("frame") == 0, is_last()
    if points == 2:
        return F.when(last, x - lag(1)).otherwise(lead(1) - x)
    three = F.when(first, lead(1) - x).when(last, x - lag(1)).otherwise((lead(1) - lag(1)) / 2)
    if points == 3:
        return three
    if points == 5:
        inner = (F.col("frame") > 1) & (F.col("frame") < n_frames() - 2)
        return F.when(inner, (-lead(2) + 8 * lead(1) - 8 * lag(1) + lag(2)) / 12).otherwise(three)
    raise ValueError("derivatives use 2, 3 or 5 points")


def unwrapped(frames: DataFrame, angle: str, out: str, chunk: int | None = None, rest: bool = False) -> DataFrame:
    """``out``: the angle without jumps of 2 pi, over the non-missing samples of a trial; missing ones stay missing, and with ``rest`` so do all after the first of them. With ``chunk`` a trial is unwrapped in chunks of frames, by summaries of these."""
    known = F.col(angle).isNotNull()
    if chunk:
        frames_ = last_before(frames, F.col(angle), "_earlier", chunk)
    else:
        frames_ = frames.withColumn("_earlier", F.last(F.col(angle), ignorenulls=True).over(BEFORE()))
    d = F.col(angle) - F.col("_earlier")
    pi = F.lit(math.pi)
    wrapped = F.pmod(d + pi, 2 * pi) - pi
    wrapped = F.when((wrapped == -pi) & (d > 0), pi).otherwise(wrapped)
    step = F.when(F.abs(d) < pi, F.lit(0.0)).otherwise(wrapped - d)
    made = frames_.withColumn("_step", F.when(known, F.coalesce(step, F.lit(0.0))).otherwise(F.lit(float("nan") if rest else None).cast("double")))
    made = running_sum(made, "_step", "_turned", chunk) if chunk else made.withColumn("_turned", F.sum("_step").over(SO_FAR()))
    # A sum that has met a NaN keeps it.
    turned = F.when(~F.isnan("_turned"), F.col("_turned")) if rest else F.col("_turned")
    return made.withColumn(out, F.col(angle) + turned).drop("_step", "_earlier", "_turned")


def rate(fps: Column | float) -> Column:
    return fps if isinstance(fps, Column) else F.lit(float(fps))


def speed(key: str, fps: Column | float = 1.0, points: int = 2) -> Column:
    x, y = xy(key)
    return norm((derivative(x, points), derivative(y, points))) * rate(fps)


def motion_vector(key: str = "ctr", points: int = 3) -> Vector:
    x, y = xy(key)
    return derivative(x, points), derivative(y, points)


def delta_between(a: str, b: str | None = None, fps: Column | float = 1.0) -> Column:
    """Way from ``a`` in the frame before to ``b`` in this one, times fps; null in frame 0."""
    (ax, ay), (bx, by) = xy(a), xy(b or a)
    return norm((bx - F.lag(ax).over(W()), by - F.lag(ay).over(W()))) * rate(fps)


def all_deltas(frames: DataFrame) -> DataFrame:
    """Columns tt, hh, th (tail to head), ht: ways from the frame before."""
    return frames.withColumns({"tt": delta_between("tail"), "hh": delta_between("head"), "th": delta_between("tail", "head"), "ht": delta_between("head", "tail")})


def local_tortuosity(frames: DataFrame, window: int = 30, key: str = "mid", step: int = 1, out: str = "tortuosity") -> DataFrame:
    """Path length over net way in a centred window, cut short at the edges; a net way of zero counts as 1e-4.

    With a step, every step-th point from the window's first makes the path. A missing point makes the value missing.
    """
    hw = int(window) // step // 2
    x, y = xy(key)
    wide = W().rowsBetween(-hw, hw)
    ends = norm((F.last(x).over(wide) - F.first(x).over(wide), F.last(y).over(wide) - F.first(y).over(wide)))
    net = F.when(ends == 0, F.lit(1e-4)).otherwise(ends)
    whole = F.count(x + y).over(wide) == F.count(F.lit(1)).over(wide)
    if hw == 0:
        return frames.withColumn(out, F.when(whole, F.lit(0.0)))
    if step == 1:
        made = frames.withColumn("_d", delta_between(key))
        path = F.coalesce(F.sum(F.when(F.col("frame") > 0, F.col("_d"))).over(W().rowsBetween(-hw + 1, hw)), F.lit(0.0))
        return made.withColumn(out, F.when(whole, path / net)).drop("_d")
    points = F.collect_list(F.struct(x.alias("x"), y.alias("y"))).over(wide)
    made = frames.withColumn("_p", points).withColumn("_net", net).withColumn("_whole", whole)
    picked = F.filter("_p", lambda _, i: i % step == 0)
    made = made.withColumn("_p", picked)
    pairs = F.zip_with(F.slice("_p", F.lit(1), F.size("_p") - 1), F.slice("_p", F.lit(2), F.size("_p") - 1), lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))
    return made.withColumn(out, F.when(F.col("_whole"), F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d) / F.col("_net"))).drop("_p", "_net", "_whole")


def rolling(x: Column, window: int, how: str = "mean") -> Column:
    """Mean or median of frames i - hw to i + hw - 1, without missing values and without the trial's last sample; null if hw is 0."""
    hw = window // 2
    if hw == 0:
        return F.lit(None).cast("double")
    value, frame = F.when(F.col("frame") < n_frames() - 1, x), W().rowsBetween(-hw, hw - 1)
    return F.avg(value).over(frame) if how == "mean" else F.percentile(value, F.lit(0.5)).over(frame)


def reorientation(angle: Column) -> Column:
    """Absolute change since the frame before."""
    return F.abs(angle - F.lag(angle).over(W()))


