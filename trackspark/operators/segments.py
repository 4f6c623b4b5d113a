"""Joins and aggregations of frames over segments.

A segment's frames are a half-open slice [start, end) as the metrics define it. Segments carry their own frames to the
join: they are exploded to (trial_id, frame), an equi-join, never a theta join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import body, head_angle, norm, vector_angle
from ..functions.kinematics import delta_between, motion_vector, speed, unwrapped
from ..schema import W, xy

KEYS = ["trial_id", "start_frame", "end_frame"]


def frames_of(segments: DataFrame, buffer: int = 0, closed: bool = False) -> DataFrame:
    """A row a segment and frame (buffered at both ends); segments without frames have none."""
    a, b = F.col("start_frame") + buffer, F.col("end_frame") - buffer - (0 if closed else 1)
    return segments.select(*KEYS, F.explode(F.when(b >= a, F.sequence(a, b))).alias("frame"))


def _sliced(frames: DataFrame, segments: DataFrame, values: dict[str, Column], buffer: int = 0, closed: bool = False) -> DataFrame:
    made = frames.select("trial_id", "frame", *[v.alias(n) for n, v in values.items()])
    return frames_of(segments, buffer, closed).join(made, ["trial_id", "frame"])


def _with_all(segments: DataFrame, found: DataFrame) -> DataFrame:
    return segments.select(*KEYS).join(found, KEYS, "left")


def metrics_by_segment(frames: DataFrame, segments: DataFrame, value: Column, buffer: int = 0) -> DataFrame:
    """mean, std (population), median of the values in each segment without missing ones; null for a segment without values."""
    rows = _sliced(frames, segments, {"v": value}, buffer)
    return _with_all(segments, rows.groupBy(*KEYS).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", F.lit(0.5)).alias("median")))


def cross_segment_delta_2d(frames: DataFrame, segments: DataFrame, key1: str, key2: str, offset: int = 0) -> DataFrame:
    """Distance from ``key1`` at start - offset to ``key2`` at end + offset; null where a frame is out of range."""
    at = frames.select("trial_id", F.col("frame").alias("_a"), *[c.alias(n) for c, n in zip(xy(key1), ("_ax", "_ay"))])
    to = frames.select("trial_id", F.col("frame").alias("_b"), *[c.alias(n) for c, n in zip(xy(key2), ("_bx", "_by"))])
    own = segments.select(*KEYS, (F.col("start_frame") - offset).alias("_a"), (F.col("end_frame") + offset).alias("_b"))
    met = own.join(at, ["trial_id", "_a"], "left").join(to, ["trial_id", "_b"], "left")
    return met.select(*KEYS, norm((F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay"))).alias("delta"))


def cross_segment_delta_1d(frames: DataFrame, segments: DataFrame, value: str, offset: int = 1, absolute: bool = False, angular: bool = False, chunk: int | None = None) -> DataFrame:
    """Value at end + offset less that at start - offset; null where a frame is out of range.

    ``angular``: values are angles, whose jumps of 2 pi are taken out first; a missing sample leaves all after it without a value. ``chunk``: see ``unwrapped``.
    """
    if angular:
        frames = unwrapped(frames.select("trial_id", "frame", value), value, "_turn", chunk, rest=True).select("trial_id", "frame", F.col("_turn").alias(value))
    # Both places of a segment go to one join, so the values are made once.
    places = F.array(F.struct((F.col("start_frame") - offset).alias("frame"), F.lit(0).alias("side")), F.struct((F.col("end_frame") + offset).alias("frame"), F.lit(1).alias("side")))
    own = segments.select(*KEYS, F.inline(places))
    met = own.join(frames.select("trial_id", "frame", F.col(value).alias("_v")), ["trial_id", "frame"], "left")
    at = [F.max(F.when(F.col("side") == i, F.col("_v"))) for i in (0, 1)]
    d = at[1] - at[0]
    made = met.groupBy(*KEYS).agg((F.abs(d) if absolute else d).alias("delta"), F.count_if(F.col("side") == 0).cast("int").alias("_times"))
    return made.select(*KEYS, F.explode(F.array_repeat("delta", F.col("_times"))).alias("delta"))


def _stepped(frames: DataFrame, segments: DataFrame, key: str, step: int, combined: bool, strict: bool) -> DataFrame:
    """dist: sum of the ways from frames start, start + step, ...; combined: median over the step's phases. strict: a missing way makes it null.

    Ways are summed up along each trial, for every remainder of the frame by the step, once; a segment's sum is then the difference of two of these sums, whatever its length.
    """
    made = frames.withColumn("_d", delta_between(key)).withColumn("_d", F.lead("_d").over(W())).withColumn("_last", F.max("frame").over(Window.partitionBy("trial_id")))
    inside = F.col("frame") < F.col("_last")
    so_far = Window.partitionBy("trial_id", F.col("frame") % step).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    sums = made.select("trial_id", "frame", F.sum(F.when(inside, F.coalesce("_d", F.lit(0.0))).otherwise(0.0)).over(so_far).alias("_sum"), F.sum((inside & F.col("_d").isNull()).cast("int")).over(so_far).alias("_missing"))
    lasts = frames.groupBy("trial_id").agg(F.max("frame").alias("_last"))
    phases = F.sequence(F.lit(0).cast("long"), F.lit(step - 1 if combined else 0).cast("long"))
    own = segments.select(*KEYS).distinct().join(lasts, "trial_id", "left").select(*KEYS, "_last", F.explode(phases).alias("phase"))
    first, upper = F.col("start_frame") + F.col("phase"), F.least(F.col("end_frame"), F.col("_last")) - 1
    # Two places each: the last frame of the phase in the segment, and the one before its first. Without a frame in between there is none, and the sum is zero.
    ends = F.when(first <= upper, F.array(F.struct((first + step * F.floor((upper - first) / step)).alias("frame"), F.lit(1).alias("sign")), F.struct((first - step).alias("frame"), F.lit(-1).alias("sign"))))
    places = own.select(*KEYS, "phase", F.explode_outer(ends).alias("p")).select(*KEYS, "phase", "p.frame", "p.sign")
    met = places.join(sums, ["trial_id", "frame"], "left")
    ways = met.groupBy(*KEYS, "phase").agg(F.coalesce(F.sum(F.col("sign") * F.col("_sum")), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("sign") * F.col("_missing")), F.lit(0)).alias("m"))
    if strict:
        ways = ways.withColumn("s", F.when(F.col("m") == 0, F.col("s")))
    # Phases without a frame count in the median.
    found = ways.groupBy(*KEYS).agg(F.when(F.count("s") == F.count(F.lit(1)), F.percentile("s", F.lit(0.5))).alias("dist")) if combined else ways.select(*KEYS, F.col("s").alias("dist"))
    return _with_all(segments, found)


def segment_distance(frames: DataFrame, segments: DataFrame, key: str = "mid", step: int = 1, combined: bool = False) -> DataFrame:
    """Gross way of a keypoint in each segment, without missing steps; an empty segment has 0."""
    return _stepped(frames, segments, key, step, combined, False)


def segment_tortuosity(frames: DataFrame, segments: DataFrame, key: str = "mid", step: int = 1, combined: bool = False) -> DataFrame:
    """Gross way over the net way from the first to the last frame; a net way of zero counts as 1e-4; missing steps make it null."""
    dist = _stepped(frames, segments, key, step, combined, True)
    x, y = xy(key)
    ends = frames.select("trial_id", "frame", x.alias("x"), y.alias("y"))
    a = ends.select("trial_id", F.col("frame").alias("start_frame"), F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    b = ends.select("trial_id", (F.col("frame") + 1).alias("end_frame"), F.col("x").alias("_bx"), F.col("y").alias("_by"))
    net = norm((F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")))
    met = dist.join(a, ["trial_id", "start_frame"], "left").join(b, ["trial_id", "end_frame"], "left")
    return met.select(*KEYS, (F.col("dist") / F.when(net == 0, F.lit(1e-4)).otherwise(net)).alias("tortuosity"))


def travel_distance_ratio(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Head way over tail way (plus 1e-3) in each segment."""
    head, tail = segment_distance(frames, segments, "head"), segment_distance(frames, segments, "tail").withColumnRenamed("dist", "tail_dist")
    return head.join(tail, KEYS).select(*KEYS, (F.col("dist") / (F.col("tail_dist") + 1e-3)).alias("ratio"))


def speed_ratio(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Mean head speed over mean tail speed, and the smaller number of values; 1 without a head value."""
    rows = _sliced(frames, segments, {"h": speed("head"), "t": speed("tail")})
    found = rows.groupBy(*KEYS).agg(F.avg("h").alias("h"), F.avg("t").alias("t"), F.least(F.count("h"), F.count("t")).alias("n"))
    all_ = _with_all(segments, found)
    ratio = F.when(F.col("h").isNull(), F.lit(1.0)).otherwise(F.col("h") / F.nullif("t", F.lit(0.0)))
    return all_.select(*KEYS, ratio.alias("ratio"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def alignment() -> Column:
    return vector_angle(body(), motion_vector("tail", 3))


def alignment_angle(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Mean angle between the tail-to-midpoint vector and the tail's motion."""
    rows = _sliced(frames, segments, {"a": alignment()})
    return _with_all(segments, rows.groupBy(*KEYS).agg(F.avg("a").alias("angle")))


def run_alignment_angle(frames: DataFrame, segments: DataFrame, fps: float, min_frames: int, min_speed: float = 0, max_head_angle: float = math.pi / 4) -> DataFrame:
    """The same over run frames (fast centroid, straight body), both ends included; null with min_frames of them or fewer."""
    run = (speed("ctr", fps) > min_speed) & (head_angle(True) < max_head_angle)
    rows = _sliced(frames, segments, {"a": alignment(), "run": F.coalesce(run, F.lit(False))}, closed=True)
    n = F.count_if("run")
    found = rows.groupBy(*KEYS).agg(F.when(n > min_frames, F.coalesce(F.sum(F.when(F.col("run"), F.col("a"))), F.lit(0.0)) / F.nullif(n, F.lit(0))).alias("angle"))
    return _with_all(segments, found)


def flag_segment_metric(metric: Column, n: Column, low: float = 0.9, high: float = 1.1, min_frames: Column | int = 0) -> Column:
    """1 (swapped) under the lower bound, -1 over the upper, else 0; 0 for segments with too few values."""
    enough = n >= min_frames
    return F.when(enough & (metric < low), 1).when(enough & (metric > high), -1).otherwise(0)


def fill_ambiguous_following(flag: str = "flag", ignore_edges: bool = False) -> Column:
    """For flags of 0 the flag before; at the trial's start the next one, or 0 with ``ignore_edges``. 0 for other flags."""
    order, back, known = Window.partitionBy("trial_id").orderBy("start_frame"), Window.partitionBy("trial_id").orderBy(F.col("start_frame").desc()), F.nullif(F.col(flag), F.lit(0))
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(known, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    fill = F.coalesce(before, F.lit(0)) if ignore_edges else F.coalesce(before, after, F.lit(0))
    return F.when(F.col(flag) == 0, fill).otherwise(0)


def merge_ambiguous(flag: str = "flag", ignore_edges: bool = False) -> Column:
    """For flags of 0 the sum of the next flags on both sides as -1, 0 or 1; with ``ignore_edges`` its half, rounded down."""
    order, back, known = Window.partitionBy("trial_id").orderBy("start_frame"), Window.partitionBy("trial_id").orderBy(F.col("start_frame").desc()), F.nullif(F.col(flag), F.lit(0))
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(known, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    total = F.coalesce(before, F.lit(0)) + F.coalesce(after, F.lit(0))
    return F.when(F.col(flag) == 0, F.floor(total / 2) if ignore_edges else F.signum(total)).otherwise(0).cast("int")
