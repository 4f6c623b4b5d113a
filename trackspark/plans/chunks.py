"""Queries of the operators that take a trial in chunks, with chunks that cut every trial of the fixture into several. Their SQL is that of the same operators over whole trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import kinematics as k
from ..operators import activity, correct, flags, intervals
from .fixture import pose
from .frames import r6
from .registry import ORACLES, register

CHUNK = 100


@register("unwrap_angle_chunked", ORACLES["unwrap_angle"])
def unwrap_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pose(spark, sf_dir).withColumn("signed", g.orientation(half=False))
    return k.unwrapped(made, "signed", "angle", CHUNK).select("trial_id", "frame", r6(F.col("angle")).alias("angle"))


@register("consecutive_ranges_chunked", ORACLES["consecutive_ranges"])
def consecutive_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.consecutive_ranges(flags.flag_overlaps(pose(spark, sf_dir)), 8)


@register("swap_parity_chunked", ORACLES["swap_parity"])
def swap_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = correct.remove_edge_frames(pose(spark, sf_dir))
    return correct.swap_parity(clean, flags.flag_all_swaps(clean), CHUNK).select("trial_id", "frame", "swapped")


@register("detect_stops_chunked", ORACLES["detect_stops"])
def detect_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pose(spark, sf_dir).withColumn("slow", k.speed("ctr", 30) < 80)
    return activity.detect_stops_in_chunks(made, F.col("slow"), 0.05, 30, CHUNK).withColumn("duration", r6(F.col("duration")))
