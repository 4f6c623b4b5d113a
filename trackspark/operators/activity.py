"""Stops and runs by a speed threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SO_FAR, TRIAL, W
from .prefix import chunked, last_before, running_sum


def detect_stops(frames: DataFrame, speed: Column, min_speed: float, min_time: float, fps: Column | float) -> DataFrame:
    """trial_id, frame, stop (0 or 1), duration (seconds, on the first frame of each stop or run, else 0).

    A run of L frames counts L - 1. A slow island is a stop if that is over min_time * fps; shorter ones melt into
    the run around them. The last island of a trial is never closed: it is no stop and adds no time. Missing speed counts as fast.
    """
    fps = fps if isinstance(fps, Column) else F.lit(float(fps))
    own = frames.select("trial_id", "frame", F.coalesce(speed < min_speed, F.lit(False)).alias("slow"), fps.alias("fps"))
    own = own.withColumn("_new", F.when(F.lag("slow").over(W()) == F.col("slow"), 0).otherwise(1)).withColumn("island", F.sum("_new").over(SO_FAR()))
    of_island = Window.partitionBy("trial_id", "island")
    size = F.count(F.lit(1)).over(of_island)
    own = own.withColumn("size", size).withColumn("last", F.col("island") == F.max("island").over(TRIAL()))
    own = own.withColumn("stop", F.col("slow") & ~F.col("last") & (F.col("size") - 1 > F.lit(float(min_time)) * F.col("fps")))
    # Confirmed stops stand alone; all islands between two of them are one run.
    own = own.withColumn("_new", F.when(F.lag("stop").over(W()) == F.col("stop"), F.lit(0)).otherwise(1))
    own = own.withColumn("_new", F.when(F.col("stop") & (F.lag("island").over(W()) != F.col("island")), 1).otherwise(F.col("_new"))).withColumn("act", F.sum("_new").over(SO_FAR()))
    first_of_island = F.row_number().over(Window.partitionBy("trial_id", "island").orderBy("frame")) == 1
    own = own.withColumn("_part", F.when(first_of_island & ~F.col("last"), F.col("size") - 1).otherwise(0))
    of_act = Window.partitionBy("trial_id", "act")
    total = F.sum("_part").over(of_act)
    first = F.col("frame") == F.min("frame").over(of_act)
    return own.select("trial_id", "frame", F.col("stop").cast("int").alias("stop"), F.when(first, total / F.col("fps")).otherwise(0.0).alias("duration"))


def detect_stops_in_chunks(frames: DataFrame, slow: Column, min_time: float, fps: Column | float, chunk: int) -> DataFrame:
    """What ``detect_stops`` gives, for a column or expression of the frame's own row that says whether it is slow (missing: not), by summaries of chunks of frames and of islands.

    Islands are aggregates, so one may hold any share of the frames; no window spans a trial but over one row a chunk.
    """
    fps = fps if isinstance(fps, Column) else F.lit(float(fps))
    own = frames.select("trial_id", "frame", F.coalesce(slow, F.lit(False)).alias("slow"), fps.alias("fps"))
    own = last_before(own, F.col("slow"), "_was", chunk)
    own = own.withColumn("_new", F.when(F.col("_was") == F.col("slow"), 0).otherwise(1))
    own = running_sum(own, "_new", "island", chunk).select("trial_id", "frame", "slow", "fps", "island")
    islands = own.groupBy("trial_id", "island").agg(F.first("slow").alias("slow"), F.first("fps").alias("fps"), F.count(F.lit(1)).alias("size"), F.min("frame").alias("first"))
    ends = islands.groupBy("trial_id").agg(F.max("island").alias("_end"))
    islands = islands.join(ends, "trial_id").withColumn("last", F.col("island") == F.col("_end"))
    islands = islands.withColumn("stop", F.col("slow") & ~F.col("last") & (F.col("size") - 1 > F.lit(float(min_time)) * F.col("fps")))
    # Confirmed stops stand alone; all islands between two of them are one run.
    islands = last_before(islands, F.col("stop"), "_was", chunk, "island").withColumn("_new", F.when(F.col("stop") | F.coalesce("_was", F.lit(True)), 1).otherwise(0))
    islands = running_sum(islands, "_new", "act", chunk, "island").withColumn("_part", F.when(~F.col("last"), F.col("size") - 1).otherwise(0))
    acts = islands.groupBy("trial_id", "act").agg(F.sum("_part").alias("_total"), F.min("first").alias("frame"))
    # Frames meet their island by way of the chunk, so that no key has more rows than a chunk.
    pieces = chunked(own, chunk).groupBy("trial_id", "_chunk", "island").agg(F.first("slow").alias("_slow")).join(islands.select("trial_id", "island", "stop"), ["trial_id", "island"])
    met = chunked(own, chunk).join(pieces.select("trial_id", "_chunk", "island", "stop"), ["trial_id", "_chunk", "island"])
    met = met.join(acts.select("trial_id", "frame", "_total"), ["trial_id", "frame"], "left")
    return met.select("trial_id", "frame", F.col("stop").cast("int").alias("stop"), F.coalesce(F.col("_total") / F.col("fps"), F.lit(0.0)).alias("duration"))


def activity_summary(activity: DataFrame) -> DataFrame:
    """count, mean, std (population) and sum of the durations of each trial's stops and runs."""
    own = activity.where("duration > 0").groupBy("trial_id", "stop")
    return own.agg(F.count(F.lit(1)).alias("count"), F.avg("duration").alias("mean"), F.stddev_pop("duration").alias("std"), F.sum("duration").alias("total"))
