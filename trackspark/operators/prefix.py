"""Running values along a trial in two levels, so that one very long trial is spread over tasks.

Rows are dealt to chunks of their order; a chunk's summary is one row; a window over the summaries of a trial gives every chunk what comes before it; and a window inside the chunk does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ["trial_id", "_chunk"]


def chunked(rows: DataFrame, chunk: int, order: str = "frame") -> DataFrame:
    return rows.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long"))


def inside(order: str = "frame") -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy(order)


def _earlier() -> WindowSpec:
    return Window.partitionBy("trial_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(rows: DataFrame, value: str, out: str, chunk: int, order: str = "frame") -> DataFrame:
    """``out``: the sum of a column over a trial's rows up to and with this one."""
    own = chunked(rows, chunk, order)
    sums = own.groupBy(*KEYS).agg(F.sum(value).alias("_sum"))
    before = sums.select(*KEYS, F.coalesce(F.sum("_sum").over(_earlier()), F.lit(0)).alias("_before"))
    so_far = F.sum(value).over(inside(order).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn(out, so_far).join(before, KEYS).withColumn(out, F.col("_before") + F.coalesce(out, F.lit(0))).select(*rows.columns, out)


def last_before(rows: DataFrame, value: Column, out: str, chunk: int, order: str = "frame") -> DataFrame:
    """``out``: the last value that is not missing of a trial's rows before this one."""
    own = chunked(rows, chunk, order).withColumn("_value", value)
    lasts = own.groupBy(*KEYS).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    carried = lasts.select(*KEYS, F.last("_last", ignorenulls=True).over(_earlier()).alias("_carried"))
    near = F.last("_value", ignorenulls=True).over(inside(order).rowsBetween(Window.unboundedPreceding, -1))
    return own.withColumn(out, near).join(carried, KEYS).withColumn(out, F.coalesce(out, "_carried")).select(*rows.columns, out)
