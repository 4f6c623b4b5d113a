"""Interval and set algebra on flags (trial_id, frame) and segments (trial_id, start_frame, end_frame, both inside).

Islands come from a running difference or change points, so every operator is one window pass over
rows partitioned by trial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import W
from .prefix import chunked, inside

BOUNDS = ["trial_id", "start_frame", "end_frame"]


def S() -> WindowSpec:
    return Window.partitionBy("trial_id").orderBy("start_frame", "end_frame")


def _S_BEFORE() -> WindowSpec:
    return S().rowsBetween(Window.unboundedPreceding, -1)


def _S_SO_FAR() -> WindowSpec:
    return S().rowsBetween(Window.unboundedPreceding, 0)


def consecutive_ranges(flags: DataFrame, chunk: int | None = None) -> DataFrame:
    """Maximal runs of consecutive frames; repeated frames count once. With ``chunk`` runs are found in chunks of frames, and those that touch a chunk's ends are joined after that."""
    own = flags.select("trial_id", "frame").distinct()
    if chunk:
        own = chunked(own, chunk)
        island = F.col("frame") - F.row_number().over(inside())
        runs = own.withColumn("_i", island).groupBy("trial_id", "_chunk", "_i").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))
        first, last = F.col("start_frame") == F.col("_chunk") * chunk, F.col("end_frame") == (F.col("_chunk") + 1) * chunk - 1
        whole = runs.where(~first & ~last).select("trial_id", "start_frame", "end_frame")
        # At most two runs a chunk touch its ends; a new run begins where the one before does not end just before it.
        open_ = runs.where(first | last)
        new = F.coalesce(F.col("start_frame") - F.lag("end_frame").over(Window.partitionBy("trial_id").orderBy("start_frame")) > 1, F.lit(True))
        joined = open_.withColumn("_new", new.cast("int")).withColumn("_i", F.sum("_new").over(Window.partitionBy("trial_id").orderBy("start_frame").rowsBetween(Window.unboundedPreceding, 0)))
        return whole.unionByName(joined.groupBy("trial_id", "_i").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame")).drop("_i"))
    island = F.col("frame") - F.row_number().over(W())
    return own.withColumn("_i", island).groupBy("trial_id", "_i").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame")).drop("_i")


def consecutive_values(flags: DataFrame) -> DataFrame:
    """The runs as arrays of frames."""
    return consecutive_ranges(flags).select("trial_id", F.sequence("start_frame", "end_frame").alias("frames"))


def value_segments(frames: DataFrame, condition: Column) -> DataFrame:
    """Runs of frames where the condition holds; missing does not hold."""
    own = frames.select("trial_id", "frame", F.coalesce(condition, F.lit(False)).alias("_on"))
    changed = F.when(F.col("_on") == F.coalesce(F.lag("_on").over(W()), ~F.col("_on")), 0).otherwise(1)
    runs = own.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(W().rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("_on").groupBy("trial_id", "_run").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame")).drop("_run")


def ranges_to_list(segments: DataFrame) -> DataFrame:
    return segments.select("trial_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))


def ranges_to_edges(segments: DataFrame) -> DataFrame:
    """Distinct first frames and frames after the last."""
    return segments.select("trial_id", F.explode(F.array(F.col("start_frame"), F.col("end_frame") + 1)).alias("frame")).distinct()


def invert_ranges(segments: DataFrame, lengths: DataFrame, shared_ends: bool = False) -> DataFrame:
    """What the segments of each trial leave of frames 0 to n - 1; ``lengths`` has trial_id and n. With ``shared_ends`` the pieces include the segments' end frames."""
    inside = 0 if shared_ends else 1
    nexts = segments.withColumn("_next", F.lead("start_frame").over(S())).withColumn("_first", F.row_number().over(S()) == 1)
    n = F.col("n")
    whole = F.struct(F.lit(0).cast("long").alias("a"), (n - 1).alias("b"))
    lead = F.struct(F.lit(0).cast("long").alias("a"), (F.col("start_frame") - inside).alias("b"))
    tail = F.struct((F.col("end_frame") + inside).alias("a"), F.coalesce(F.col("_next") - inside, n - 1).alias("b"))
    joined = lengths.join(nexts, "trial_id", "left")
    pieces = F.when(F.col("start_frame").isNull(), F.array(whole)).when(F.col("_first") & (F.col("start_frame") > 0), F.array(lead, tail)).otherwise(F.array(tail))
    out = joined.select("trial_id", F.explode(pieces).alias("p")).select("trial_id", F.col("p.a").alias("start_frame"), F.col("p.b").alias("end_frame"))
    ok = F.col("start_frame") <= F.col("end_frame") if not shared_ends else F.col("start_frame") < F.col("end_frame")
    return out.where(ok)


def fuse_ranges(*tables: DataFrame, adjacent: bool = True) -> DataFrame:
    """Union of segments, merged where they overlap and, if ``adjacent``, where they touch."""
    own = tables[0].select(*BOUNDS)
    for t in tables[1:]:
        own = own.unionByName(t.select(*BOUNDS))
    reach = F.max("end_frame").over(_S_BEFORE())
    new = F.when(F.col("start_frame") <= reach + (1 if adjacent else 0), 0).otherwise(1)
    return own.withColumn("_new", new).withColumn("_g", F.sum("_new").over(_S_SO_FAR())).groupBy("trial_id", "_g").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame")).drop("_g")


def filter_ranges(base: DataFrame, remove: DataFrame) -> DataFrame:
    """Frames of ``base`` that are not in ``remove``, as runs."""
    return consecutive_ranges(ranges_to_list(base).join(ranges_to_list(remove), ["trial_id", "frame"], "left_anti"))


def segment_lengths(segments: DataFrame, inclusive: bool = False) -> DataFrame:
    return segments.withColumn("length", F.col("end_frame") - F.col("start_frame") + int(inclusive))


def segments_of_length(segments: DataFrame, lower: int = 1, upper: int | None = None, inclusive: bool = False) -> DataFrame:
    """Segments with lower <= length < upper."""
    length = F.col("end_frame") - F.col("start_frame") + int(inclusive)
    return segments.where((length >= lower) & (length < upper if upper is not None else F.lit(True)))


def index_steps(flags: DataFrame) -> DataFrame:
    return consecutive_ranges(flags).select("trial_id", "start_frame", (F.col("end_frame") - F.col("start_frame")).alias("steps"))


def indices_to_segments(flags: DataFrame, lengths: DataFrame, bounds: bool = True, inclusive: bool = False, alternating: bool = False) -> DataFrame:
    """[0, n) cut at the flagged frames; ends are exclusive unless ``inclusive``; ``alternating`` keeps the 2nd, 4th, ... piece."""
    own = flags.select("trial_id", "frame")
    if bounds:
        own = own.unionByName(lengths.select("trial_id", F.explode(F.array(F.lit(0).cast("long"), F.col("n"))).alias("frame")))
    own = own.distinct()
    pieces = own.withColumn("_end", F.lead("frame").over(W())).withColumn("_k", F.row_number().over(W())).where("_end is not null")
    if alternating:
        pieces = pieces.where(F.col("_k") % 2 == 0)
    return pieces.select("trial_id", F.col("frame").alias("start_frame"), (F.col("_end") - int(inclusive)).alias("end_frame"))


def intervals(flags: DataFrame, lengths: DataFrame, alternating: bool = False) -> DataFrame:
    """The same pieces as arrays of their frames."""
    return indices_to_segments(flags, lengths, True, True, alternating).select("trial_id", F.sequence("start_frame", "end_frame").alias("frames"))


def flatten_samples(samples: DataFrame, column: str = "values") -> DataFrame:
    """Arrays set in a row, in the order of ``sample``: trial_id, position, value."""
    long = samples.select("trial_id", "sample", F.posexplode(column).alias("_k", "value"))
    at = F.row_number().over(Window.partitionBy("trial_id").orderBy("sample", "_k")) - 1
    return long.select("trial_id", at.cast("long").alias("position"), "value")


def merge_flags(*tables: DataFrame) -> DataFrame:
    own = tables[0].select("trial_id", "frame")
    for t in tables[1:]:
        own = own.unionByName(t.select("trial_id", "frame"))
    return own.distinct()


def filter_flags(flags: DataFrame, remove: DataFrame) -> DataFrame:
    """Flags not in ``remove``; repeated ones stay repeated."""
    return flags.join(remove, ["trial_id", "frame"], "left_anti")


def match_flags(flags: DataFrame, other: DataFrame) -> DataFrame:
    return flags.join(other, ["trial_id", "frame"], "left_semi")


def mismatch_flags(a: DataFrame, b: DataFrame) -> DataFrame:
    """Flags in one table but not in both."""
    return merge_flags(filter_flags(a, b), filter_flags(b, a))
