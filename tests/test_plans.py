"""What the plans of queries over large tables must not hold: shuffles, scans and calls that grow with the frames for no reason."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from trackspark.operators import segments as seg
from trackspark.plans import fixture
from trackspark.schema import POSITIONS

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_transforms_take_many_groups_at_a_time(spark):
    text = plan(spark, "fft_spectrum_split")
    # The grouped call that is left is of samples of one group.
    assert text.count("FlatMapGroupsInPandas") == 1 and "MapInArrow" in text


def test_deltas_make_the_values_once_and_do_not_filter_by_them(spark):
    for name in ("cross_segment_delta_angular", "cross_segment_delta_1d"):
        text = plan(spark, name)
        assert text.count("FileScan") == 3
        assert max(len(line) for line in text.splitlines() if "Filter" in line) < 5_000


def test_deltas_keep_repeated_segments(spark):
    frames = spark.createDataFrame([(1, f, float(f * f)) for f in range(6)], "trial_id long, frame long, v double")
    segments = spark.createDataFrame([(1, 1, 3), (1, 1, 3), (1, 0, 2)], "trial_id long, start_frame long, end_frame long")
    got = seg.cross_segment_delta_1d(frames, segments, "v", 1).collect()
    assert sorted((r.start_frame, r.delta) for r in got if r.delta is not None) == [(1, 16.0), (1, 16.0)] and len(got) == 3


def test_angles_after_a_missing_one_have_no_delta(spark):
    frames = spark.createDataFrame([(1, f, None if f == 3 else float(f)) for f in range(8)], "trial_id long, frame long, v double")
    segments = spark.createDataFrame([(1, 1, 1), (1, 1, 4)], "trial_id long, start_frame long, end_frame long")
    for chunk in (None, 2):
        got = {r.end_frame: r.delta for r in seg.cross_segment_delta_1d(frames, segments, "v", 1, angular=True, chunk=chunk).collect()}
        assert got == {1: 2.0, 4: None}


def test_frames_are_dealt_to_trials_once(spark):
    for name in ("detect_stops", "swapped_segments", "swapped_segments_speed", "swapped_segments_distance"):
        assert plan(spark, name).count("Exchange") == 1, name


def test_large_tables_have_partitions_of_bounded_size(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(fixture, "ROWS", 100)
    assert fixture.pose(spark, SF).rdd.getNumPartitions() == -(-rows // 100)


def test_smoothing_makes_no_list_of_neighbours(spark):
    for name in ("filter_gaussian", "tracking_correction", "swapped_segments"):
        assert "collect_list" not in plan(spark, name), name


def test_batch_correction_makes_and_deals_the_frames_once(spark):
    text = plan(spark, "batch_correct")
    assert text.count("MapInArrow") == 1 and text.count("Exchange hashpartitioning") == 1


def test_batch_correction_fills_short_gaps(spark):
    done = __spark_entry__.queries()["batch_correct"](spark, SF).toPandas().sort_values(["trial_id", "frame"])
    for _, own in done.groupby("trial_id"):
        for c in POSITIONS:
            steps = np.diff(own["frame"].to_numpy()[own[c].notna()])
            assert not ((steps > 1) & (steps <= 17)).any(), c


def test_batch_correction_takes_each_trial_at_its_own_rate(spark, monkeypatch):
    """At a rate of zero no point is fast, so that overlaps stay in such trials."""
    own, known = fixture.trials, fixture.trials(spark, SF)
    monkeypatch.setattr(fixture, "trials", lambda *a: own(*a).withColumn("fps", F.when(F.col("trial_id") % 2 == 0, F.col("fps")).otherwise(0.0)))
    overlaps = "sum(CASE WHEN xhead = xtail AND yhead = ytail THEN 1 ELSE 0 END)"
    done = __spark_entry__.queries()["batch_correct"](spark, SF).groupBy("trial_id").agg(F.expr(f"{overlaps} AS n")).collect()
    assert {r["trial_id"] for r in known.collect()} == {r["trial_id"] for r in done}
    few, many = ([r["n"] for r in done if r["trial_id"] % 2 == k] for k in (0, 1))
    assert max(few) < min(many), (few, many)
