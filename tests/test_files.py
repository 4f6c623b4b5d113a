"""Files in and out, and streams of frames against the batch operators."""

import json
import time

import pytest
from pyspark.sql import functions as F

from trackspark.operators.flags import flag_discontinuities, flag_min_delta_mismatches
from trackspark.operators.smoothing import filter_kalman
from trackspark.schema import POSITIONS, RAW_COLUMNS
from trackspark.sources import tracks
from trackspark.streaming import live

COLUMNS = ["Frame", *list(RAW_COLUMNS)[:8], "Stim Ch1", "note"]


@pytest.fixture
def root(tmp_path):
    for trial, files in {"t1": ["t1_data.csv", "t1_data_filtered.csv"], "t2": ["b_data.csv", "a_data.csv"], "Omit_x": ["x_data.csv"], "empty": [], "only": ["z_data.csv_filtered"]}.items():
        (tmp_path / trial).mkdir()
        for f in files:
            (tmp_path / trial / f).write_text(",".join(COLUMNS) + "\n" + "".join(f"{5 + i},{640 + i},{480}, ,480,640,480,640,480,{i % 2},n{i}\n" for i in range(4)))
    settings = {"Framerate": 30, "Pixel per mm": 16.0, "Source x": 640, "Source y": 480}
    (tmp_path / "t1/experiment_settings.json").write_text(json.dumps(settings))
    (tmp_path / "t2/experiment_settings.json").write_text(json.dumps({"Framerate": 30, "Pixel per mm": 16.0}))
    (tmp_path / "t1/experiment_settings_updated.json").write_text(json.dumps({"Framerate": 1, "Pixel per mm": 8.0}))
    return str(tmp_path)


def test_round_trip(spark, root, tmp_path):
    picked = tracks.pick_trial_file(tracks.scan_trials(spark, root)).orderBy("trial_id").collect()
    assert [(r["trial_id"], r["name"]) for r in picked] == [("t1", "t1_data.csv"), ("t2", "a_data.csv")]
    trials = tracks.load_settings(spark, root)
    assert [tuple(r) for r in trials.orderBy("trial_id").collect()] == [("t1", 30, 8, 640, 480), ("t2", 30, 16, 0, 0)]
    paths = [r["path"] for r in picked]
    own = tracks.load_tracks(spark, paths, trials).where("trial_id = 't1'").orderBy("frame")
    assert [(r["frame"], r["xhead"], r["xtail"], r["stimulus"]) for r in own.collect()] == [(i, i / 8, None, i % 2) for i in range(4)]
    raw = tracks.read_track_csv(spark, paths, COLUMNS).withColumn("frame0", F.col("Frame") - 5)
    done = tracks.export_tracks(raw.withColumnRenamed("Frame", "pos").withColumnRenamed("frame0", "frame"), own.select("trial_id", "frame", *POSITIONS), trials)
    assert [r["X-Head"] for r in done.where("trial_id = 't1'").orderBy("frame").collect()] == [640, 641, 642, 643]
    assert "note" in done.columns
    tracks.write_tracks(done, str(tmp_path / "out"))
    assert (tmp_path / "out/trial_id=t1").is_dir()
    segments = spark.createDataFrame([("t1", 1, 2)], "trial_id string, start_frame long, end_frame long")
    tracks.export_segments(segments, str(tmp_path / "s"))
    assert tracks.read_segments(spark, str(tmp_path / "s")).collect() == segments.collect()


def test_files_are_read_by_their_headers(spark, tmp_path):
    """Other orders, other stimulus names, missing and unknown columns, quotes, a byte-order mark, a header alone."""
    files = {
        "a": "Frame,X-Head,Y-Head,stimulation\n7,1.5,2.5,1\n8, ,3.5,0\n",
        "b": "\ufeff\"Stim Ch1\",note, Y-Head ,X-Head,Frame\n9,\"x, y\",4.5,-1.5,3\n9,,oops,-2.5,4\n",
        "c": "Y-Head,X-Tail,Frame,stimulation,Stim Ch1\n1,2,3,,5\n",
        "d": "Frame,X-Head\n",
    }
    for trial, text in files.items():
        (tmp_path / trial).mkdir()
        (tmp_path / trial / f"{trial}_data.csv").write_text(text)
    raw = tracks.read_track_csv(spark, f"{tmp_path}/*")
    assert raw.columns == ["Frame", "X-Head", "Y-Head", "X-Tail", "stimulation", "Stim Ch1", "note", "trial_id"]
    assert {tuple(r) for r in raw.collect()} == {
        (7, 1.5, 2.5, None, 1, None, None, "a"), (8, None, 3.5, None, 0, None, None, "a"),
        (3, -1.5, 4.5, None, None, 9, "x, y", "b"), (4, -2.5, None, None, None, 9, None, "b"), (3, None, 1, 2, None, 5, None, "c"),
    }
    got = tracks.load_tracks(spark, f"{tmp_path}/*")
    assert got.columns == ["trial_id", "frame", "xhead", "yhead", "xtail", "stimulus"]
    # A file's stimulus is the first of the columns that it has, even where that is empty.
    assert {tuple(r) for r in got.collect()} == {("a", 0, 1.5, 2.5, None, 1), ("a", 1, None, 3.5, None, 0), ("b", 0, -1.5, 4.5, None, 9), ("b", 1, -2.5, None, None, 9), ("c", 0, None, 1, 2, None)}
    # The order of the names asked for is the caller's own.
    some = tracks.read_track_csv(spark, f"{tmp_path}/*", ["Y-Head", "Frame", "missing"])
    assert some.columns == ["Y-Head", "Frame", "missing", "trial_id"]
    assert {tuple(r) for r in some.where("trial_id = 'b'").collect()} == {(4.5, 3, None, "b"), (None, 4, None, "b")}


def test_a_file_of_many_splits_has_one_header(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/t_data.csv").write_text("X-Head,Frame\n" + "".join(f"{i / 2},{i}\n" for i in range(20_000)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = tracks.read_track_csv(spark, f"{tmp_path}/*")
        assert spark.read.text(f"{tmp_path}/*").rdd.getNumPartitions() > 4
        assert rows.count() == 20_000 and rows.where("`X-Head` <> Frame / 2").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_streams_equal_batches(spark, tmp_path):
    rows = [(t, i, *[float((i * 7 + t + j * 3) % 11 + j) for j in range(8)]) for t in (1, 2) for i in range(12)]
    own = spark.createDataFrame(rows, "trial_id long, frame long, " + ", ".join(f"{c} double" for c in POSITIONS))
    for k in range(3):
        own.where((F.col("frame") >= 4 * k) & (F.col("frame") < 4 * k + 4)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for name, apply in (("kalman", live.stream_kalman), ("flags", lambda f: live.stream_flags(f, 30, 150))):
        source = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with live.without_empty_batches(spark):
            q = apply(source).writeStream.format("memory").queryName(f"out_{name}").option("checkpointLocation", str(tmp_path / f"c_{name}")).outputMode("append").trigger(availableNow=True).start()
            assert q.awaitTermination(60)
    got = {(r["trial_id"], r["frame"]): r["xmid"] for r in spark.table("out_kalman").collect()}
    want = {(r["trial_id"], r["frame"]): r["xmid"] for r in filter_kalman(own, 30, reset_covariance=True).collect()}
    assert got == pytest.approx(want)
    flags = {(r["trial_id"], r["frame"]) for r in spark.table("out_flags").where("kind = 'mdm'").collect()}
    assert flags == {(r["trial_id"], r["frame"]) for r in flag_min_delta_mismatches(own).collect()}
    jumps = {(r["trial_id"], r["frame"]) for r in spark.table("out_flags").where("kind = 'disc_head'").collect()}
    assert jumps == {(r["trial_id"], r["frame"]) for r in flag_discontinuities(own, "head", 30, 150).collect()}


def test_state_of_silent_trials_expires(spark, tmp_path):
    """Trial 1 falls silent and returns; trial 2 goes on."""
    schema, idle = "trial_id long, frame long, " + ", ".join(f"{c} double" for c in POSITIONS), 4_000

    def feed(*rows):
        own = spark.createDataFrame([(t, f, *[float(f * f + j) for j in range(8)]) for t, f in rows], schema)
        own.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(own.schema).parquet(str(tmp_path / "in"))
        for name, apply in (("filters", live.stream_kalman), ("last", live.stream_flags)):
            with live.without_empty_batches(spark):
                q = apply(source, idle_ms=idle).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
                assert q.awaitTermination(60)

    def held(name):
        rows = spark.read.format("statestore").option("path", str(tmp_path / f"c_{name}")).option("stateVarName", name).load()
        return {r["key"]["trial_id"] for r in rows.collect()}

    feed((1, 0), (1, 1), (2, 0), (2, 1))
    assert held("filters") == held("last") == {1, 2}
    time.sleep(idle / 1000 + 0.5)
    feed((2, 2))
    assert held("filters") == held("last") == {2}
    # A frame that would be late under the old state begins a new one: the first filtered position is the frame's own.
    feed((1, 0))
    assert 1 in held("filters")
    got = spark.read.parquet(str(tmp_path / "filters")).where("trial_id = 1 and frame = 0").select("xhead").collect()
    assert [r[0] for r in got] == pytest.approx([0.0, 0.0])
    # Trial 2 was silent for longer than allowed before its third frame, so that began anew too.
    assert spark.read.parquet(str(tmp_path / "filters")).where("trial_id = 2 and frame = 2").first()["xhead"] == pytest.approx(4.0)


def test_a_streams_filter_keeps_numbers_of_updates_and_skips_gaps():
    """One small state for all keypoints, without covariances; gaps leave it as it is, over two batches."""
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    from trackspark.functions import numerics

    box = []
    state = SimpleNamespace(exists=lambda: bool(box), get=lambda: box[-1], update=box.append)
    handle = SimpleNamespace(getValueState=lambda name, schema: state, deleteTimer=lambda t: None, registerTimer=lambda t: None)
    clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0)
    points = np.cumsum(np.random.default_rng(4).normal(size=(50, 8)), axis=0)
    points[np.random.default_rng(5).random((50, 8)) < 0.1] = np.nan
    points[:30, 2] = np.nan
    own = pd.DataFrame(points, columns=POSITIONS).assign(trial_id=1, frame=range(50))
    run = live.KalmanProcessor(30)
    run.init(handle)
    got = pd.concat([df for part in (own[:20], own[20:]) for df in run.handleInputRows((1,), iter([part]), clock)])
    np.testing.assert_allclose(got[POSITIONS].to_numpy(float), numerics.kalman_trial(points, 30, reset_covariance=True), rtol=1e-9, atol=1e-9)
    assert sum(len(v) for v in box[-1] if isinstance(v, list)) == 4 + 24


def test_folders_are_written_by_many_tasks_and_headers_read_once(spark):
    """A small table of many trials would be one task's work, and every use of the index one more scan of all files."""
    import glob
    import os
    import re

    from trackspark.plans import registry

    assert registry.QUERIES
    from trackspark.plans.files import mixed_files, settings_files
    from trackspark.sources import tracks

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("needs the given tables")
    root = settings_files(spark, data)
    assert len({re.search(r"part-(\d+)", f).group(1) for f in glob.glob(f"{root}/*/*.json")}) > 1
    frames = tracks.load_tracks(spark, f"{mixed_files(spark, data)}/*")
    plan = frames._jdf.queryExecution().optimizedPlan().toString()
    assert " csv" in plan and " text" not in plan
