"""Detectors of tracking errors. Each returns (trial_id, frame); ``flag_table`` has all of them as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import body, ht_cross_sign, overlaps, within_angle
from ..functions.kinematics import delta_between
from ..schema import BEFORE, SO_FAR, W, is_last
from .intervals import consecutive_ranges

KEYS = ["trial_id", "frame"]
DELTAS = {"tt": ("tail", "tail"), "hh": ("head", "head"), "th": ("tail", "head"), "ht": ("head", "tail")}


def _min_mismatch() -> Column:
    """A crossed way is the shortest of the four; ties and missing points do not count."""
    all_there = F.col("tt").isNotNull() & F.col("hh").isNotNull() & F.col("th").isNotNull() & F.col("ht").isNotNull()
    return all_there & (F.least("th", "ht") < F.least("tt", "hh"))


def _mismatch(tolerance: float) -> Column:
    return F.col("tt") + F.col("hh") > (F.col("ht") + F.col("th")) * (1 + tolerance)


def _with_deltas(frames: DataFrame) -> DataFrame:
    return frames.withColumns({n: delta_between(a, b) for n, (a, b) in DELTAS.items()})


def flag_discontinuities(frames: DataFrame, key: str, fps: float, threshold: float = 24) -> DataFrame:
    return frames.withColumn("_d", delta_between(key, fps=fps)).where(F.col("_d") > threshold).select(*KEYS)


def flag_delta_mismatches(frames: DataFrame, tolerance: float = 0) -> DataFrame:
    return _with_deltas(frames).where(_mismatch(tolerance)).select(*KEYS)


def flag_min_delta_mismatches(frames: DataFrame) -> DataFrame:
    return _with_deltas(frames).where(_min_mismatch()).select(*KEYS)


def flag_sign_reversals(frames: DataFrame, threshold: float = math.pi / 2) -> DataFrame:
    """The bend's sign changes (also to or from zero) between two frames that are both bent by the threshold or more."""
    made = frames.withColumn("_z", ht_cross_sign()).withColumn("_v", within_angle(body(), body(True), threshold))
    made = made.withColumn("_pz", F.lag("_z").over(W())).withColumn("_pv", F.lag("_v").over(W()))
    return made.where((F.abs(F.col("_z") - F.col("_pz")) > 0) & F.col("_v") & F.col("_pv")).select(*KEYS)


def flag_overlaps(frames: DataFrame, tolerance: float = 0, a: str = "head", b: str = "tail") -> DataFrame:
    return frames.where(overlaps(a, b, tolerance)).select(*KEYS)


def overlap_edges(frames: DataFrame, offset: int = 0, tolerance: float = 0, a: str = "head", b: str = "tail") -> DataFrame:
    """Runs of overlap, widened by ``offset`` and clipped to the trial."""
    runs = consecutive_ranges(flag_overlaps(frames, tolerance, a, b))
    if not offset:
        return runs
    sizes = frames.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"))
    wide = runs.join(sizes, "trial_id")
    return wide.select("trial_id", F.greatest(F.col("start_frame") - offset, F.lit(0)).alias("start_frame"), F.least(F.col("end_frame") + offset, F.col("n") - 1).alias("end_frame"))


def overlap_edges_by_type(frames: DataFrame, tolerance: float = 0) -> DataFrame:
    """kind ht, hm, tm, all: runs where only these points overlap (head-tail, head-mid, tail-mid), and all three."""
    made = frames.select(*KEYS, overlaps("head", "tail", tolerance).alias("ht"), overlaps("head", "mid", tolerance).alias("hm"), overlaps("tail", "mid", tolerance).alias("tm"))
    kinds = {"ht": F.expr("ht and not hm"), "hm": F.expr("hm and not ht"), "tm": F.expr("tm and not ht"), "all": F.expr("ht and hm and tm")}
    on = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]), lambda k: k.isNotNull())
    rows = made.select("trial_id", "frame", F.explode(on).alias("kind"))
    typed = rows.select(F.struct("trial_id", "kind").alias("trial_id"), "frame")
    return consecutive_ranges(typed).select("trial_id.trial_id", "trial_id.kind", "start_frame", "end_frame")


def with_flags(frames: DataFrame, threshold: float = math.pi / 4, bent: float = math.pi / 2, tolerance: float = 0, delta_tolerance: float = 0) -> DataFrame:
    """The frames with boolean columns over, dm, mdm, sr (against the frame before) and com, comm, cosr (across an overlap).

    One window pass, so one shuffle and one sort by trial. A flag across an overlap lies on the first frame after the
    run, or on the trial's last frame if the run reaches it; it compares that frame with the last one before the
    run, or with frame 0 if the run begins there.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    made = _with_deltas(frames).withColumns({"_z": ht_cross_sign(), "_v": within_angle(body(), body(True), bent), "_w": within_angle(body(), body(True), threshold), "over": overlaps("head", "tail", tolerance)})
    made = made.withColumns({"dm": no(_mismatch(delta_tolerance)), "mdm": no(_min_mismatch())})
    points = [f"{axis}{k}" for k in ("head", "tail") for axis in "xy"]
    here = F.struct(*points, F.col("_z").alias("z"), F.col("_w").alias("w"))
    made = made.withColumns({
        "_pz": F.lag("_z").over(W()), "_pv": F.lag("_v").over(W()), "_po": no(F.lag("over").over(W())),
        "_a": F.coalesce(F.last(F.when(~F.col("over"), here), ignorenulls=True).over(BEFORE()), F.first(here).over(SO_FAR())),
    })
    made = made.withColumn("_after", (~F.col("over") & F.col("_po")) | (F.col("over") & is_last()))
    way = lambda p, q: F.sqrt((F.col(f"x{q}") - F.col(f"_a.x{p}")) * (F.col(f"x{q}") - F.col(f"_a.x{p}")) + (F.col(f"y{q}") - F.col(f"_a.y{p}")) * (F.col(f"y{q}") - F.col(f"_a.y{p}")))
    made = made.withColumns({n: way(p, q) for n, (p, q) in DELTAS.items()})
    made = made.withColumns({
        "sr": no((F.abs(F.col("_z") - F.col("_pz")) > 0) & F.col("_v") & F.col("_pv")),
        "com": F.col("_after") & no(_mismatch(delta_tolerance)),
        "comm": F.col("_after") & no(_min_mismatch()),
        "cosr": F.col("_after") & no((F.abs(F.col("_z") - F.col("_a.z")) > 0) & F.col("_w") & F.col("_a.w")),
        "clear": ~F.col("over") & ~F.col("_po"),
    })
    return made.select(*frames.columns, "over", "clear", "dm", "mdm", "sr", "com", "comm", "cosr")


def flag_overlap_mismatches(frames: DataFrame, delta_tolerance: float = 0, overlap_tolerance: float = 0) -> DataFrame:
    return with_flags(frames, tolerance=overlap_tolerance, delta_tolerance=delta_tolerance).where("com").select(*KEYS)


def flag_overlap_min_mismatches(frames: DataFrame, overlap_tolerance: float = 0) -> DataFrame:
    return with_flags(frames, tolerance=overlap_tolerance).where("comm").select(*KEYS)


def flag_overlap_sign_reversals(frames: DataFrame, tolerance: float = 0, threshold: float = math.pi / 4) -> DataFrame:
    return with_flags(frames, threshold, tolerance=tolerance).where("cosr").select(*KEYS)


#: What makes a frame one from which head and tail are exchanged: crossed ways away from overlaps, bends or crossed ways across them.
SWAP = "(mdm and clear) or cosr or comm"


def flag_all_swaps(frames: DataFrame) -> DataFrame:
    return with_flags(frames).where(SWAP).select(*KEYS)


def flag_table(frames: DataFrame, fps: float = 30, threshold: float = 24) -> DataFrame:
    """Every frame with all flags as columns; dm, mdm and sr only away from overlaps."""
    made = with_flags(frames.withColumns({"_hh": delta_between("head", fps=fps), "_tt": delta_between("tail", fps=fps)}))
    jumps = {n: F.coalesce(F.col(c) > threshold, F.lit(False)).alias(n) for n, c in (("disc_head", "_hh"), ("disc_tail", "_tt"))}
    return made.select(*KEYS, F.col("over").alias("overlap"), *jumps.values(), *[(F.col(c) & F.col("clear")).alias(c) for c in ("dm", "mdm", "sr")], "com", "comm", "cosr")
