"""Queries of the streaming operators: the fixture as a stream of files, read until none is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import POSITIONS
from ..scratch import scratch
from ..streaming import live
from .fixture import pose
from .frames import FLAGS, MINI
from .registry import register
from .smoothing import SHOWN, r3, sql_kalman

#: Micro-batches that the frames of every trial are cut into, in order.
BATCHES = 3


def streamed(spark: SparkSession, sf_dir: str, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an operator on a stream gives for the whole fixture, by way of files in and out: BATCHES times files come in and the stream is started anew."""
    made, out = scratch(spark, "frames"), scratch(spark, "stream")
    frames = pose(spark, sf_dir).select("trial_id", "frame", *POSITIONS)
    lengths = frames.groupBy("trial_id").agg(F.max("frame").alias("last"))
    part = F.least(F.floor(F.col("frame") * BATCHES / (F.col("last") + 1)), F.lit(BATCHES - 1))
    cut = frames.join(lengths, "trial_id").withColumn("part", part).drop("last")
    with live.without_empty_batches(spark):
        for k in range(BATCHES):
            cut.where(F.col("part") == k).drop("part").write.mode("append").parquet(made)
            # Each start takes up the state that the last one left.
            source = spark.readStream.schema(frames.schema).parquet(made)
            run = apply(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.parquet(out)


@register(
    "stream_flags",
    f"{FLAGS} SELECT trial_id, frame, 'disc_head' AS kind FROM nb WHERE hh * 30 > 600 UNION ALL SELECT trial_id, frame, 'disc_tail' FROM nb WHERE tt * 30 > 600 UNION ALL SELECT trial_id, frame, 'mdm' FROM nb WHERE {MINI}",
)
def stream_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, lambda frames: live.stream_flags(frames, 30, 600))


@register("stream_kalman", sql_kalman(carry=False))
def stream_kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = streamed(spark, sf_dir, live.stream_kalman)
    return made.select("trial_id", "frame", *[r3(F.col(c)).alias(c) for c in SHOWN])
