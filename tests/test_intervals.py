"""Interval and set algebra against plain sets of frames, on random inputs, and a few cases with results written out."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions.kinematics import unwrapped
from trackspark.operators import activity, correct
from trackspark.operators import intervals as iv

N = "trial_id long, n long"
LENGTH = 24


def flags(spark, frames):
    return spark.createDataFrame([(1, int(f)) for f in frames], "trial_id long, frame long")


def segs(spark, pairs):
    return spark.createDataFrame([(1, int(a), int(b)) for a, b in pairs], "trial_id long, start_frame long, end_frame long")


def pairs(df):
    return sorted((r["start_frame"], r["end_frame"]) for r in df.collect())


def frames_of(df):
    return sorted(r["frame"] for r in df.collect())


def runs(frames):
    """(first, last) of the maximal runs of a set of numbers."""
    frames = set(frames)
    firsts = sorted(f for f in frames if f - 1 not in frames)
    return [(f, next(e for e in range(f, max(frames) + 1) if e + 1 not in frames)) for f in firsts]


def inside(segments):
    return {f for a, b in segments for f in range(a, b + 1)}


def some_frames(rng):
    return rng.integers(0, LENGTH, rng.integers(0, 16)).tolist()


def some_segments(rng):
    """Segments that may overlap, touch or repeat."""
    starts = rng.integers(0, LENGTH, rng.integers(0, 6))
    return [(int(a), int(min(LENGTH - 1, a + rng.integers(0, 6)))) for a in starts]


@pytest.mark.parametrize("seed", range(4))
def test_runs(spark, seed):
    own = some_frames(np.random.default_rng(seed))
    table = flags(spark, own)
    assert pairs(iv.consecutive_ranges(table)) == runs(own)
    assert sorted(r["frames"] for r in iv.consecutive_values(table).collect()) == [list(range(a, b + 1)) for a, b in runs(own)]
    assert sorted((r["start_frame"], r["steps"]) for r in iv.index_steps(table).collect()) == [(a, b - a) for a, b in runs(own)]


@pytest.mark.parametrize("seed", range(4))
def test_ranges(spark, seed):
    own = runs(some_frames(np.random.default_rng(10 + seed)))
    table = segs(spark, own)
    assert frames_of(iv.ranges_to_list(table)) == sorted(inside(own))
    assert frames_of(iv.ranges_to_edges(table)) == sorted({e for a, b in own for e in (a, b + 1)})
    ten = spark.createDataFrame([(1, LENGTH)], N)
    rest = runs(set(range(LENGTH)) - inside(own))
    assert pairs(iv.invert_ranges(table, ten)) == rest


def test_shared_ends_and_lengths(spark):
    table = segs(spark, [(4, 6), (11, 11)])
    assert pairs(iv.invert_ranges(table, spark.createDataFrame([(1, 14)], N), True)) == [(0, 4), (6, 11), (11, 13)]
    both = iv.invert_ranges(table, spark.createDataFrame([(1, 14), (2, 5)], N))
    assert sorted((r["trial_id"], r["start_frame"], r["end_frame"]) for r in both.collect()) == [(1, 0, 3), (1, 7, 10), (1, 12, 13), (2, 0, 4)]
    assert pairs(iv.segments_of_length(segs(spark, [(0, 0), (2, 6), (9, 11), (13, 30)]), 2, 6, True)) == [(2, 6), (9, 11)]


@pytest.mark.parametrize("seed", range(4))
def test_fuse_and_filter(spark, seed):
    rng = np.random.default_rng(20 + seed)
    a, b = some_segments(rng), some_segments(rng)
    both = inside(a) | inside(b)
    assert pairs(iv.fuse_ranges(segs(spark, a), segs(spark, b))) == runs(both)
    assert pairs(iv.fuse_ranges(iv.fuse_ranges(segs(spark, a + b)))) == runs(both)
    # Without fusing neighbours, the same frames are covered, and only pieces that share a frame are one.
    apart = pairs(iv.fuse_ranges(segs(spark, a), segs(spark, b), adjacent=False))
    assert inside(apart) == both and sum(y - x + 1 for x, y in apart) == len(both)
    assert all(any(x <= p and q <= y for x, y in apart) for p, q in a + b)
    clean = runs(inside(a))
    assert inside(pairs(iv.filter_ranges(segs(spark, clean), segs(spark, b)))) == inside(a) - inside(b)


def test_cuts(spark):
    own, n = flags(spark, [2, 9, 10]), spark.createDataFrame([(1, 12)], N)
    assert pairs(iv.indices_to_segments(own, n)) == [(0, 2), (2, 9), (9, 10), (10, 12)]
    assert sorted(r["frames"] for r in iv.intervals(own, n).collect()) == [[0, 1], [2, 3, 4, 5, 6, 7, 8], [9], [10, 11]]
    assert sorted(r["frames"] for r in iv.intervals(own, n, True).collect()) == [[2, 3, 4, 5, 6, 7, 8], [10, 11]]
    assert pairs(iv.indices_to_segments(own, n, inclusive=True, alternating=True)) == [(2, 8), (10, 11)]


@pytest.mark.parametrize("seed", range(3))
def test_values(spark, seed):
    values = np.random.default_rng(30 + seed).integers(0, 2, 12).tolist()
    own = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)] + [(2, 0, None)], "trial_id long, frame long, v int")
    assert pairs(iv.value_segments(own, own["v"] == 1)) == runs([i for i, v in enumerate(values) if v])


def test_samples(spark):
    parts = [[4, 4], [], [7], [1, 2, 3]]
    own = spark.createDataFrame([(1, i, p) for i, p in enumerate(parts)], "trial_id long, sample int, values array<int>")
    assert [r["value"] for r in iv.flatten_samples(own).orderBy("position").collect()] == sum(parts, [])


@pytest.mark.parametrize("seed", range(3))
def test_sets(spark, seed):
    rng = np.random.default_rng(40 + seed)
    x, y = some_frames(rng), some_frames(rng)
    a, b = flags(spark, x), flags(spark, y)
    assert frames_of(iv.merge_flags(a, b)) == sorted(set(x) | set(y))
    assert frames_of(iv.filter_flags(a, b)) == sorted(f for f in x if f not in y)
    assert frames_of(iv.match_flags(a, b)) == sorted(f for f in x if f in y)
    assert frames_of(iv.mismatch_flags(a, b)) == sorted(set(x) ^ set(y))


@pytest.mark.parametrize("chunk", [1, 7])
def test_trials_in_chunks(spark, chunk):
    """Two-level scans against windows over whole trials: runs across many chunks, missing values, a trial of one frame."""
    rng = np.random.default_rng(chunk)
    rows = []
    for trial, n in ((1, 60), (2, 41), (3, 1)):
        slow = np.repeat(rng.random(n) < 0.5, rng.integers(1, 9, n))[:n]
        angle = rng.uniform(-3.1, 3.1, n)
        rows += [(trial, i, None if rng.random() < 0.1 else float(angle[i]), None if i % 17 == 5 else 0.0 if slow[i] else 9.0, bool(slow[i])) for i in range(n)]
    frames = spark.createDataFrame(rows, "trial_id long, frame long, angle double, v double, flag boolean").repartition(4)
    same = lambda a, b: collections.Counter(map(tuple, a.collect())) == collections.Counter(map(tuple, b.collect()))
    flags = frames.where("flag").select("trial_id", "frame")
    assert same(iv.consecutive_ranges(flags, chunk), iv.consecutive_ranges(flags))
    own = frames.select("trial_id", "frame")
    assert same(correct.swap_parity(own, flags, chunk), correct.swap_parity(own, flags))
    six = lambda df: df.select("trial_id", "frame", F.round("out", 6))
    assert same(six(unwrapped(frames, "angle", "out", chunk)), six(unwrapped(frames, "angle", "out")))
    assert same(activity.detect_stops_in_chunks(frames, F.col("v") < 1, 1, 2, chunk), activity.detect_stops(frames, F.col("v"), 1, 1, 2))
    for none in (iv.consecutive_ranges(flags.limit(0), chunk), activity.detect_stops_in_chunks(frames.limit(0), F.col("v") < 1, 1, 2, chunk)):
        assert none.isEmpty()
