"""The pose fixture: tracks and trials derived from the given tables, by SQL that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed fixture text. {lineitem} and {supplier} stand for the tables.
POSE_CTES = """
b AS (
 SELECT CAST(l_suppkey AS BIGINT) AS trial_id,
   CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS frame,
   count(*) OVER (PARTITION BY l_suppkey) AS n, CAST(l_partkey AS BIGINT) AS pk, CAST(l_orderkey AS BIGINT) AS ok
 FROM {lineitem}),
w AS (
 SELECT *, 640 + sum(pk % 7 - 3) OVER (PARTITION BY trial_id ORDER BY frame) AS xm,
   480 + sum(ok % 7 - 3) OVER (PARTITION BY trial_id ORDER BY frame) AS ym,
   sum(CASE WHEN pk % 41 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY trial_id ORDER BY frame) % 2 AS swp,
   CASE WHEN ok % 29 < 2 THEN 1 ELSE 0 END AS ovl,
   CASE WHEN frame < trial_id % 4 OR frame >= n - trial_id % 3 THEN 1 ELSE 0 END AS zed,
   CASE (frame - frame % 16) / 16 % 4 WHEN 0 THEN 20 WHEN 1 THEN 3 WHEN 2 THEN -20 ELSE -3 END AS ux,
   CASE (frame - frame % 16) / 16 % 4 WHEN 0 THEN 3 WHEN 1 THEN 20 WHEN 2 THEN -3 ELSE -20 END AS uy,
   CASE WHEN frame % 40 < 20 THEN 14 ELSE -14 END AS bend
 FROM b),
p AS (
 SELECT *, xm + ux - CASE WHEN uy > 0 THEN bend ELSE -bend END AS hx, ym + uy + CASE WHEN ux > 0 THEN bend ELSE -bend END AS hy,
   xm - ux AS tx, ym - uy AS ty FROM w),
pose AS (
 SELECT trial_id, frame,
  CAST(CASE WHEN zed=1 THEN 0 WHEN ovl=1 THEN tx WHEN swp=1 THEN tx ELSE hx END AS DOUBLE) AS xhead,
  CAST(CASE WHEN zed=1 THEN 0 WHEN ovl=1 THEN ty WHEN swp=1 THEN ty ELSE hy END AS DOUBLE) AS yhead,
  CAST(CASE WHEN zed=1 THEN 0 WHEN ovl=1 THEN tx WHEN swp=1 THEN hx ELSE tx END AS DOUBLE) AS xtail,
  CAST(CASE WHEN zed=1 THEN 0 WHEN ovl=1 THEN ty WHEN swp=1 THEN hy ELSE ty END AS DOUBLE) AS ytail,
  CAST(CASE WHEN zed=1 THEN 0 ELSE xm END AS DOUBLE) AS xmid, CAST(CASE WHEN zed=1 THEN 0 ELSE ym END AS DOUBLE) AS ymid,
  CAST(CASE WHEN zed=1 THEN 0 ELSE xm + pk % 3 - 1 END AS DOUBLE) AS xctr, CAST(CASE WHEN zed=1 THEN 0 ELSE ym + ok % 3 - 1 END AS DOUBLE) AS yctr,
  CAST(CASE WHEN frame % 200 < 50 THEN 100 ELSE 0 END AS DOUBLE) AS stimulus
 FROM p)"""
TRIALS_CTE = """
trials AS (SELECT CAST(s_suppkey AS BIGINT) AS trial_id, CAST(30 AS DOUBLE) AS fps,
  CAST(CASE WHEN s_suppkey % 2 = 0 THEN 8 ELSE 16 END AS DOUBLE) AS ppmm, CAST(640 AS DOUBLE) AS source_x, CAST(480 AS DOUBLE) AS source_y FROM {supplier})"""
#: For DuckDB: the head of every statement. Each step is computed once.
SQL = "WITH " + re.sub(r"^(b|w|p|pose) AS \(", r"\1 AS MATERIALIZED (", (POSE_CTES + "," + TRIALS_CTE).format(lineitem="lineitem", supplier="supplier"), flags=re.MULTILINE)


#: Frames of a partition in large tables. Left alone, Spark joins a shuffle's partitions until there are no more than cores, and a task sorts what then is in one.
ROWS = 100_000


def numbered(lineitem: DataFrame) -> DataFrame:
    """The rows of ``b``. Named before they are dealt, so that the one shuffle by trial serves all windows after it."""
    own = lineitem.select(F.col("l_suppkey").cast("long").alias("trial_id"), F.col("l_partkey").cast("long").alias("pk"), F.col("l_orderkey").cast("long").alias("ok"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    parts = -(-lineitem.count() // ROWS)
    if parts > lineitem.sparkSession.sparkContext.defaultParallelism:
        own = own.repartition(parts, "trial_id")
    frame = F.row_number().over(Window.partitionBy("trial_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    return own.select("trial_id", frame.cast("long").alias("frame"), F.count(F.lit(1)).over(Window.partitionBy("trial_id")).alias("n"), "pk", "ok")


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a video frame, pixel units."""
    _, later, ctes = POSE_CTES.partition("w AS (")
    return spark.sql("WITH b AS (SELECT * FROM {rows}), " + later + ctes + " SELECT * FROM pose", rows=numbered(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rate, pixels per mm and source of every trial."""
    return spark.sql("WITH " + TRIALS_CTE + " SELECT * FROM trials", supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
