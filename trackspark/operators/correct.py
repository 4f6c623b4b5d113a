"""Corrections of tracks, and the whole correction as one plan over all trials."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import norm, overlaps, round_positions
from ..functions.kinematics import delta_between, derivative, rate, speed
from ..schema import AFTER, BEFORE, POSITIONS, SO_FAR, TRIAL, W, xy
from . import segments as seg
from .flags import SWAP, with_flags
from .intervals import ranges_to_list
from .prefix import running_sum
from .smoothing import filter_default, filter_gaussian
from .spline import CHUNK, fill_by_spline

KEYS = ["trial_id", "frame"]
ENDS = [f"{a}{k}" for k in ("head", "tail") for a in "xy"]


def remove_edge_frames(frames: DataFrame) -> DataFrame:
    """Positions missing where all points coincide in runs that touch the trial's ends, and in one frame after a leading run."""
    x, y = POSITIONS[0::2], POSITIONS[1::2]
    same = F.lit(True)
    for names in (x, y):
        for c in names[1:]:
            same = same & (F.col(c) == F.col(names[0]))
    made = frames.withColumn("_bad", F.coalesce(same, F.lit(False)))
    good = F.when(F.col("_bad"), 0).otherwise(1)
    so_far = F.sum(good).over(SO_FAR())
    lead = so_far == 0
    trail = F.sum(good).over(TRIAL()) - so_far + good == 0
    made = made.withColumn("_lead", lead).withColumn("_trail", trail)
    gone = F.col("_lead") | F.col("_trail") | F.coalesce(F.lag("_lead").over(W()), F.lit(False))
    return made.withColumn("_gone", gone).withColumns({c: F.when(~F.col("_gone"), F.col(c)) for c in POSITIONS}).select(*frames.columns)


def _swapped(frames: DataFrame, swap: Column) -> DataFrame:
    new = {}
    for a in "xy":
        new[f"{a}head"] = F.when(swap, F.col(f"{a}tail")).otherwise(F.col(f"{a}head"))
        new[f"{a}tail"] = F.when(swap, F.col(f"{a}head")).otherwise(F.col(f"{a}tail"))
    return frames.withColumns(new)


def tagged(frames: DataFrame, ranges: DataFrame, name: str) -> DataFrame:
    """A boolean column: whether the frame is in one of the ranges."""
    rows = ranges_to_list(ranges).distinct().withColumn(name, F.lit(True))
    return frames.join(rows, KEYS, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def swap_segments(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """Head and tail exchanged in the frames of the ranges."""
    return _swapped(tagged(frames, ranges, "_swap"), F.col("_swap")).select(*frames.columns)


def swap_parity(frames: DataFrame, flags: DataFrame | None = None, chunk: int | None = None) -> DataFrame:
    """Column ``swapped``: an odd number of distinct flags lies in (0, frame]. Without ``flags``, all swap flags count, found in the same window pass.

    With ``chunk`` flags are counted in chunks of frames, by summaries of these; then ``flags`` must be given, as they are found by windows over whole trials.
    """
    if chunk and flags is None:
        raise ValueError("chunks need the flags")
    if flags is None:
        marked = with_flags(frames).withColumn("_flag", F.when(F.expr(SWAP) & (F.col("frame") > 0), 1).otherwise(0))
    else:
        marks = flags.where("frame > 0").select(*KEYS).distinct().withColumn("_flag", F.lit(1))
        marked = frames.join(marks, KEYS, "left").withColumn("_flag", F.coalesce("_flag", F.lit(0)))
    counted = running_sum(marked, "_flag", "_flags", chunk) if chunk else marked.withColumn("_flags", F.sum("_flag").over(SO_FAR()))
    return counted.withColumn("swapped", F.col("_flags") % 2 == 1).select(*frames.columns, "swapped")


def correct_global_swap(frames: DataFrame, chunk: int | None = None) -> DataFrame:
    """Head and tail exchanged in trials whose smoothed tail is faster than the head.

    The smoothed columns are set beside the others and averaged over the trial's window: no join, no second shuffle.
    With ``chunk`` one very long trial is smoothed in chunks with a halo; the speeds are then averaged by an aggregation.
    """
    own = filter_gaussian(frames, 3, chunk, prefix="_g", columns=ENDS)
    fast = {k: norm((derivative(F.col(f"_gx{k}")), derivative(F.col(f"_gy{k}")))) for k in ("head", "tail")}
    own = own.withColumns({f"_v{k}": v for k, v in fast.items()})
    if chunk:
        swap = own.groupBy("trial_id").agg(F.coalesce(F.avg("_vtail") > F.avg("_vhead"), F.lit(False)).alias("_swap"))
        return _swapped(frames.join(swap, "trial_id"), F.col("_swap")).select(*frames.columns)
    own = own.withColumn("_swap", F.coalesce(F.avg("_vtail").over(TRIAL()) > F.avg("_vhead").over(TRIAL()), F.lit(False)))
    return _swapped(own, F.col("_swap")).select(*frames.columns)


def correct_tracking_errors(frames: DataFrame) -> DataFrame:
    """Parity of all swap flags, in the flags' own window pass, and then the global swap."""
    by_parity = _swapped(swap_parity(frames), F.col("swapped"))
    return correct_global_swap(by_parity.select(*frames.columns))


def remove_overlaps(frames: DataFrame, fps: Column | float, speed_threshold: float = 20) -> DataFrame:
    """In each overlap run the head goes missing if it jumps at the run's first frame or the one after the run; likewise the tail."""
    made = frames.withColumn("_over", overlaps("head", "tail")).withColumn("_begins", F.col("_over") & ~F.coalesce(F.lag("_over").over(W()), F.lit(False)))
    for k in ("head", "tail"):
        made = made.withColumn(f"_j{k}", F.coalesce(delta_between(k, fps=fps) > speed_threshold, F.lit(False)))
    gone = {}
    for k in ("head", "tail"):
        begin = F.last(F.when(F.col("_begins"), F.col(f"_j{k}")), ignorenulls=True).over(SO_FAR())
        after = F.last(F.when(~F.col("_over"), F.col(f"_j{k}")), ignorenulls=True).over(AFTER())
        gone[f"_b{k}"] = F.col("_over") & (F.coalesce(begin, F.lit(False)) | F.coalesce(after, F.lit(False)))
    made = made.withColumns(gone)
    new = {f"{a}{k}": F.when(~F.col(f"_b{k}"), F.col(f"{a}{k}")) for k in ("head", "tail") for a in "xy"}
    return made.withColumns(new).select(*frames.columns)


def _pieces(frames: DataFrame, min_overlap: int = 1) -> DataFrame:
    """Columns _piece, a number for each run of frames between overlaps (boolean ``_over``) of ``min_overlap`` frames or more, missing in those and in trials without any overlap, and _within, whether the run goes on after the frame."""
    made = frames.withColumn("_cut", F.col("_over"))
    if min_overlap > 1:
        changed = F.when(F.lag("_over").over(W()) == F.col("_over"), 0).otherwise(1)
        made = made.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(SO_FAR()))
        made = made.withColumn("_cut", F.col("_over") & (F.count(F.lit(1)).over(Window.partitionBy("trial_id", "_run")) >= min_overlap))
    goes_on = (F.lag("_cut").over(W()) == F.col("_cut")) & (F.lag("frame").over(W()) == F.col("frame") - 1)
    made = made.withColumns({"_new": F.when(goes_on, 0).otherwise(1), "_next": (F.lead("frame").over(W()) == F.col("frame") + 1) & ~F.lead("_cut").over(W())})
    made = made.withColumns({"_piece": F.sum("_new").over(SO_FAR()), "_any": F.max("_over").over(TRIAL())})
    made = made.withColumn("_piece", F.when(F.col("_any") & ~F.col("_cut"), F.col("_piece")))
    return made.withColumn("_within", F.coalesce(F.col("_piece").isNotNull() & F.col("_next"), F.lit(False))).select(*[c for c in frames.columns if c != "_over"], "_piece", "_within")


def between_overlaps(frames: DataFrame, min_overlap: int = 1) -> DataFrame:
    """What overlap runs of ``min_overlap`` frames or more leave of the trials that have an overlap, in one pass of windows over the frames."""
    made = _pieces(frames.select("trial_id", "frame", overlaps("head", "tail").alias("_over")), min_overlap)
    return made.where("_piece is not null").groupBy("trial_id", "_piece").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame")).drop("_piece")


def _way(key: str) -> Column:
    """To the next frame; none from the last."""
    x, y = xy(key)
    return norm((F.lead(x).over(W()) - x, F.lead(y).over(W()) - y))


#: Columns that a mode smooths, and what it takes of each frame.
MODES = {
    "alignment": (["xtail", "ytail", "xmid", "ymid"], {"_v": seg.alignment}),
    "speed": (ENDS, {"_h": lambda: speed("head"), "_t": lambda: speed("tail")}),
    "distance": (ENDS, {"_h": lambda: _way("head"), "_t": lambda: _way("tail")}),
}


def swapped_segments(frames: DataFrame, fps: Column | float, mode: str = "alignment", swap_following: bool = True, merge: bool = False, ignore_edges: bool = False, min_overlap: int = 1, min_time: float = 1, thresholds: tuple[float, float] = (0.95, 1.05), polarity: str = "observed") -> DataFrame:
    """Stretches between overlaps whose metric says that head and tail are exchanged.

    The pieces between overlaps end at the frame before the next overlap; metrics use [start, end). With ``polarity``
    "corrected" a small alignment angle means correct labels. Trials without overlaps have no rows.
    """
    if mode not in MODES:
        raise ValueError("mode is alignment, speed or distance")
    columns, values = MODES[mode]
    pieces = _pieces(frames.withColumn("_over", overlaps("head", "tail")), min_overlap)
    smooth = filter_default(remove_overlaps(pieces, fps, 0), columns).withColumns({n: v() for n, v in values.items()})
    # All of a piece but its last frame; no frame leaves its trial's partition.
    value = {n: F.when(F.col("_within"), F.col(n)) for n in values}
    of = {
        "alignment": lambda: (F.avg(value["_v"]) / (np.pi / 4), None),
        "speed": lambda: (F.when(F.avg(value["_h"]).isNull(), F.lit(1.0)).otherwise(F.avg(value["_h"]) / F.nullif(F.avg(value["_t"]), F.lit(0.0))), F.least(F.count(value["_h"]), F.count(value["_t"]))),
        "distance": lambda: (F.coalesce(F.sum(value["_h"]), F.lit(0.0)) / (F.coalesce(F.sum(value["_t"]), F.lit(0.0)) + 1e-3), None),
    }
    made, n = of[mode]()
    size = F.max("frame") - F.min("frame")
    metric = smooth.where("_piece is not null").groupBy("trial_id", "_piece").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), made.alias("metric"), (size if n is None else n).alias("n"), F.max(F.floor(min_time * rate(fps))).alias("_least"))
    flag = seg.flag_segment_metric(F.col("metric"), F.col("n"), *thresholds, min_frames=F.col("_least"))
    if mode == "alignment" and polarity == "corrected":
        flag = -flag
    flagged = metric.withColumn("flag", flag)
    fill = seg.fill_ambiguous_following(ignore_edges=ignore_edges) if swap_following else seg.merge_ambiguous(ignore_edges=ignore_edges) if merge else F.lit(0)
    return flagged.withColumn("_fill", fill).where(F.col("flag") + F.col("_fill") > 0).select(*seg.KEYS)


def validate_swaps(frames: DataFrame, fps: Column | float = 30, **options) -> DataFrame:
    return swap_segments(frames, swapped_segments(frames, fps, **options))


def _gap_lengths(c: str) -> tuple[Column, Column]:
    """Frames of the last known sample before and the next one after."""
    known = F.when(F.col(c).isNotNull(), F.col("frame"))
    return F.last(known, ignorenulls=True).over(BEFORE()), F.last(known, ignorenulls=True).over(AFTER())


def interpolate_gaps(frames: DataFrame, method: str = "cubicspline", max_segment: int = 15, chunk: int = CHUNK) -> DataFrame:
    """Gaps of at most max_segment + 1 frames between known samples filled, each column on its own.

    ``linear`` is a window expression; ``cubicspline`` one solve for a trial, in chunks of frames that run in tasks of their own; ``reference`` leaves the data as they are,
    which is what the original does in effect.
    """
    columns = [c for c in POSITIONS if c in frames.columns]
    if method == "reference":
        return frames
    if method == "linear":
        new = {}
        for c in columns:
            a, b = _gap_lengths(c)
            va = F.last(c, ignorenulls=True).over(BEFORE())
            vb = F.last(c, ignorenulls=True).over(AFTER())
            fits = F.col(c).isNull() & (b - a - 2 <= max_segment)
            new[c] = F.when(fits, va + (vb - va) * (F.col("frame") - a) / (b - a)).otherwise(F.col(c))
        return frames.withColumns(new)
    if method != "cubicspline":
        raise ValueError("method is linear, cubicspline or reference")

    return fill_by_spline(frames, columns, max_segment, chunk)


def tracking_correction(frames: DataFrame, fps: Column | float = 30, swaps: bool = True, errors: bool = True, interpolate: str | None = None, validate: bool = False, smooth: bool = False) -> DataFrame:
    """Edges, swaps, validation, overlaps, gaps, smoothing, rounding, in this order, for all trials at once. ``fps`` may be a column, where trials have rates of their own."""
    out = remove_edge_frames(frames)
    if swaps:
        out = correct_tracking_errors(out)
    if validate:
        out = validate_swaps(out, fps)
    if errors:
        out = remove_overlaps(out, fps)
    if interpolate:
        out = interpolate_gaps(out, interpolate)
    if smooth:
        out = filter_default(out)
    return round_positions(out)


