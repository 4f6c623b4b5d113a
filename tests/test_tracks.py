"""Kinematics, smoothing, corrections and activity on tiny tracks with hand-traced or numpy results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions import geometry as g
from trackspark.functions import kinematics as k
from trackspark.functions import numerics
from trackspark.operators import activity, cohort, correct, segments, smoothing
from trackspark.operators.flags import flag_all_swaps, with_flags
from trackspark.schema import POSITIONS


def line(spark, values, name="x", trial=1):
    return spark.createDataFrame([(trial, i, None if v is None else float(v)) for i, v in enumerate(values)], f"trial_id long, frame long, {name} double")


def track(spark, rows):
    """rows: eight positions each, or None for missing ones."""
    return spark.createDataFrame([(1, i, *[None if v is None else float(v) for v in r]) for i, r in enumerate(rows)], "trial_id long, frame long, " + ", ".join(f"{c} double" for c in POSITIONS))


def values(df, name):
    return [r[name] for r in df.orderBy("frame").collect()]


@pytest.mark.parametrize(("points", "want"), [(2, [1, 3, 5, 7, 9, 9]), (3, [1, 2, 4, 6, 8, 9]), (5, [1, 2, 4, 6, 8, 9])])
def test_derivative(spark, points, want):
    own = line(spark, [0, 1, 4, 9, 16, 25])
    assert values(own.withColumn("d", k.derivative(F.col("x"), points)), "d") == pytest.approx(want)


def test_rolling_and_time(spark):
    own = line(spark, [1, 2, 3, 4, 5])
    assert values(own.withColumn("m", k.rolling(F.col("x"), 3)), "m") == [1, 1.5, 2.5, 3.5, 4]
    assert values(line(spark, [0] * 4).withColumn("t", g.time_axis(F.lit(2.0))), "t") == pytest.approx([0, 2 / 3, 4 / 3, 2])


def test_unwrap(spark):
    a = np.array([0, 3, -3, 2.9, -2.5, 0.1, -3.1, 3.1])
    own = line(spark, [*a[:3], None, *a[3:]], "a")
    got = values(k.unwrapped(own, "a", "u"), "u")
    assert got[3] is None
    assert [x for i, x in enumerate(got) if i != 3] == pytest.approx(np.unwrap(a).tolist())


def test_angles(spark):
    row = spark.range(1)
    v = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    got = row.select(g.vector_angle(v(1, 0), v(0, 0)), g.vector_angle(v(1, 0), v(-1, 0), False), g.vector_angle(v(1, 0), v(0, -2), False)).first()
    assert list(got) == pytest.approx([math.pi / 2, 0, -math.pi / 2])


def test_filters_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    own = track(spark, x)
    taps = np.array(smoothing.gaussian_taps(2))
    want = np.convolve(np.pad(x[:, 0], 8, "symmetric"), taps, "valid")
    assert values(smoothing.filter_gaussian(own, 2), "xhead") == pytest.approx(want.tolist())
    assert values(smoothing.filter_gaussian(own, 2, chunk=16), "xhead") == pytest.approx(want.tolist())
    med = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x[:, 1], 2, "symmetric"), 5), axis=1)
    assert values(smoothing.filter_median(own, 5), "yhead") == pytest.approx(med.tolist())
    line_ = track(spark, [[i * 1.0] * 8 for i in range(60)])
    assert values(smoothing.filter_sgolay(line_), "xtail") == pytest.approx(list(range(60)), abs=1e-6)


def test_trials_shorter_than_the_reach_are_mirrored_more_than_once(spark):
    rng = np.random.default_rng(3)
    own = {n: rng.normal(size=n) for n in [*range(1, 14), 23, 24, 25, 30]}
    rows = [(n, i, *[float(v)] * 8) for n, x in own.items() for i, v in enumerate(x)]
    frames = spark.createDataFrame(rows, "trial_id long, frame long, " + ", ".join(f"{c} double" for c in POSITIONS))
    taps = np.array(smoothing.gaussian_taps(3))
    windows = lambda x, win: np.lib.stride_tricks.sliding_window_view(np.pad(x, (win // 2, win - 1 - win // 2), "symmetric"), win)
    for made, want in (
        (smoothing.filter_gaussian(frames, 3), lambda x: np.convolve(np.pad(x, len(taps) // 2, "symmetric"), taps, "valid")),
        (smoothing.filter_gaussian(frames, 3, chunk=7), lambda x: np.convolve(np.pad(x, len(taps) // 2, "symmetric"), taps, "valid")),
        (smoothing.filter_mean(frames, 15), lambda x: windows(x, 15).mean(axis=1)),
        (smoothing.filter_median(frames, 9), lambda x: np.median(windows(x, 9), axis=1)),
    ):
        got = {n: [] for n in own}
        for r in made.orderBy("trial_id", "frame").collect():
            got[r["trial_id"]].append(r["xtail"])
        for n, x in own.items():
            assert got[n] == pytest.approx(want(x).tolist()), n


@pytest.mark.parametrize("n", [4, 11, 40])
def test_global_swap_of_short_and_long_trials(spark, n):
    still, moving = [1.0] * n, [float(i * i) for i in range(n)]
    own = track(spark, [[a, 0, b, 0, 0, 0, 0, 0] for a, b in zip(still, moving)])
    for chunk in (None, 8):
        got = correct.correct_global_swap(own, chunk)
        assert values(got, "xhead") == moving and values(got, "xtail") == still


def test_missing_samples_spread(spark):
    own = track(spark, [[None if i == 30 else 1.0] * 8 for i in range(60)])
    got = values(smoothing.filter_gaussian(own, 2), "xhead")
    assert [i for i, v in enumerate(got) if v is None] == list(range(22, 39))


def test_butterworth():
    b, a = numerics.butter_coefficients(2, 5, 30)
    # Gain 1 at zero, -3 dB at the cutoff.
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 30)) / np.polyval(a, np.exp(2j * np.pi * f / 30)))
    assert gain(0) == pytest.approx(1)
    assert gain(5) == pytest.approx(math.sqrt(0.5))


def test_kalman_keeps_a_resting_point_and_gaps(spark):
    rows = [[3.0] * 8 if i != 4 else [None] * 8 for i in range(9)]
    got = values(smoothing.filter_kalman(track(spark, rows), 30), "xmid")
    assert got[4] is None or math.isnan(got[4])
    assert [v for i, v in enumerate(got) if i != 4] == pytest.approx([3.0] * 8)


def test_edges(spark):
    zero, good = [0.0] * 8, [1, 2, 3, 4, 5, 6, 7, 8]
    own = track(spark, [zero if i in (0, 1, 4, 7) else good for i in range(8)])
    assert [i for i, v in enumerate(values(correct.remove_edge_frames(own), "xhead")) if v is None] == [0, 1, 2, 7]


def test_parity_and_swaps(spark):
    own = track(spark, [[1, 1, 2, 2, 3, 3, 4, 4]] * 10)
    flags = spark.createDataFrame([(1, f) for f in (0, 3, 5, 8, 8)], "trial_id long, frame long")
    assert [i for i, v in enumerate(values(correct.swap_parity(own, flags), "swapped")) if v] == [3, 4, 8, 9]
    ranges = spark.createDataFrame([(1, 2, 3)], "trial_id long, start_frame long, end_frame long")
    once = correct.swap_segments(own, ranges)
    assert values(once, "xhead") == [1, 1, 2, 2, 1, 1, 1, 1, 1, 1]
    assert values(correct.swap_segments(once, ranges), "xhead") == [1.0] * 10


def test_linear_and_cubic_gaps(spark):
    x = [0, 1, None, None, 4, 5, None, 7, None]
    own = track(spark, [[v] * 8 for v in x])
    assert values(correct.interpolate_gaps(own, "linear"), "xhead") == [0, 1, 2, 3, 4, 5, 6, 7, None]
    cubic = values(correct.interpolate_gaps(own), "xhead")
    assert cubic[:8] == pytest.approx(list(range(8)))
    assert values(correct.interpolate_gaps(own, "linear", 0), "xhead") == [0, 1, None, None, 4, 5, 6, 7, None]
    assert values(correct.interpolate_gaps(own, "reference"), "xhead") == x
    t = np.array([0.0, 1, 2, 4, 5, 7])
    at = np.array([3.0, 6.0])
    assert numerics.not_a_knot(t, t**3 - 2 * t, at) == pytest.approx((at**3 - 2 * at).tolist())


def test_missing_points_are_not_flagged(spark):
    own = track(spark, [[0, 0, 10, 0, 5, 0, 5, 0], [10, 0, 0, 0, 5, 0, 5, 0], [None] * 8, [0, 0, 10, 0, 5, 0, 5, 0]])
    assert [r["frame"] for r in flag_all_swaps(own).collect()] == [1]
    assert with_flags(own).where("frame >= 2 and (mdm or comm or cosr)").count() == 0


@pytest.mark.parametrize(
    ("flags", "following", "at_edges", "merged", "merged_at_edges"),
    [([0, 0, 1, 0, -1, 0], [1, 1, 0, 1, 0, -1], [0, 0, 0, 1, 0, -1], [1, 1, 0, 0, 0, -1], [0, 0, 0, 0, 0, -1])],
)
def test_ambiguous(spark, flags, following, at_edges, merged, merged_at_edges):
    own = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "trial_id long, start_frame long, flag int")
    got = own.select("start_frame", segments.fill_ambiguous_following().alias("a"), segments.fill_ambiguous_following(ignore_edges=True).alias("b"), segments.merge_ambiguous().alias("c"), segments.merge_ambiguous(ignore_edges=True).alias("d")).orderBy("start_frame").collect()
    assert [[r[n] for r in got] for n in "abcd"] == [following, at_edges, merged, merged_at_edges]


@pytest.mark.parametrize(
    ("speed", "stops", "durations"),
    [([2, 2, 0, 0, 0, 2, 0, 2, 2], [0, 0, 1, 1, 1, 0, 0, 0, 0], [1, 0, 2, 0, 0, 0, 0, 0, 0]), ([0, 0, 2, 0, 0, 0], [0] * 6, [1, 0, 0, 0, 0, 0])],
)
def test_stops(spark, speed, stops, durations):
    got = activity.detect_stops(line(spark, speed, "s"), F.col("s"), 1, 1, 1.0)
    assert values(got, "stop") == stops
    assert values(got, "duration") == durations


def test_bounds_and_histogram(spark):
    own = line(spark, [0, 10])
    assert list(cohort.vector_bounds(own, "x", 0.05).first()) == pytest.approx([-0.5, 10.525])
    assert list(cohort.vector_bounds(line(spark, [None, None]), "x").first()) == [0, 0]
    got = cohort.histogram(line(spark, [0, 2.5, 5, 5.1, -1]), "x", (0, 5), 2, True).orderBy("bin").collect()
    assert [(r["count"], r["height"]) for r in got] == [(1, 2.5), (2, 10)]


def test_spectra():
    x = np.sin(2 * np.pi * 3 * np.arange(300) / 300)
    f, a = numerics.one_sided_fft(x, 30)
    assert a.argmax() == 3
    f, p = numerics.welch(np.sin(2 * np.pi * 6 * np.arange(3000) / 30), 30)
    assert f[p.argmax()] == pytest.approx(6, abs=0.12)
    assert p.sum() * (f[1] - f[0]) == pytest.approx(0.5, rel=0.05)


@pytest.mark.parametrize("bandwidth", [0.3, 40.0, "silverman"])
def test_kernels(spark, bandwidth):
    """Every kernel against its formula at each value and grid point: ties with grid points, values outside, nulls, NaN."""
    rng = np.random.default_rng(5)
    xs = np.concatenate([rng.uniform(-30, 130, 60), [0.0, 10.0, 20.0, 20.0, 100.0, 50.5]])
    values = spark.createDataFrame([(float(x),) for x in xs] + [(None,), (float("nan"),)], "v double")
    h = {"scott": len(xs) ** -0.2, "silverman": (len(xs) * 3 / 4) ** -0.2}.get(bandwidth, bandwidth)
    grid = np.linspace(0, 100, 101)
    z = np.abs(grid[:, None] - xs) / h
    want = {
        "gaussian": np.exp(-z * z / 2) / np.sqrt(2 * np.pi), "tophat": (np.abs(grid[:, None] - xs) < h) / 2, "epanechnikov": np.maximum(0, 1 - z * z) * 0.75,
        "exponential": np.exp(-z) / 2, "linear": np.maximum(0, 1 - z), "cosine": np.where(z < 1, np.cos(z * np.pi / 2), 0) * np.pi / 4,
    }
    for kernel in cohort.KERNELS:
        got = np.array([r["density"] for r in cohort.kde(values, "v", (0, 100), 101, bandwidth, kernel=kernel).orderBy("x").collect()])
        np.testing.assert_allclose(got, want[kernel].mean(axis=1) / h, rtol=1e-9, atol=1e-12, err_msg=kernel)
    assert cohort.kde(values.limit(0), "v", (0, 100), 101, bandwidth).isEmpty()


@pytest.fixture(scope="module")
def gappy(spark):
    """Three trials of 97, 40 and 1 frames with gaps, one of them with no head at all and one that begins with a gap."""
    rng = np.random.default_rng(8)
    rows = []
    for trial, n in (("a", 97), ("b", 40), ("c", 1)):
        points = np.cumsum(rng.normal(size=(n, 8)), axis=0) + 100
        points[rng.random((n, 8)) < 0.08] = np.nan
        if trial == "a":
            points[:23, 2] = np.nan
        if trial == "b":
            points[:, 0] = np.nan
        rows += [(trial, i, "note", *[None if np.isnan(v) else float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "trial_id string, frame long, note string, " + ", ".join(f"{c} double" for c in POSITIONS)).repartition(5).cache()


def by_trial(frames):
    own = frames.select("trial_id", "frame", *POSITIONS).toPandas().sort_values(["trial_id", "frame"])
    return {t: g[POSITIONS].to_numpy(float) for t, g in own.groupby("trial_id")}


@pytest.mark.parametrize(("chunk", "reset"), [(1000, True), (49, False), (2, False)])
def test_kalman_in_chunks(gappy, chunk, reset):
    got = smoothing.filter_kalman(gappy, 30, 2, reset, chunk)
    assert got.columns == gappy.columns and got.where("note = 'note'").count() == 138
    raw, got = by_trial(gappy), by_trial(got)
    for t, points in raw.items():
        np.testing.assert_allclose(got[t], numerics.kalman_trial(points, 30, 2, reset), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("chunk", [1000, 2])
def test_butterworth_in_chunks(gappy, chunk):
    b, a = numerics.butter_coefficients(5, 3.0, 30)
    raw, got = by_trial(gappy), by_trial(smoothing.filter_butter(gappy, 30, 3.0, 5, chunk))
    filled = by_trial(smoothing.filter_butter(gappy.fillna(7.0), 30, 3.0, 5, chunk))
    for t, points in raw.items():
        np.testing.assert_allclose(got[t], numerics.recursive_filter(b, a, points)[0], rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(filled[t], numerics.recursive_filter(b, a, np.nan_to_num(points, nan=7.0))[0], rtol=1e-9, atol=1e-9)


def test_recurrences_of_empty_tables(gappy):
    assert smoothing.filter_kalman(gappy.limit(0), 30).isEmpty() and smoothing.filter_butter(gappy.limit(0), 30, 3.0).isEmpty()


@pytest.mark.parametrize("chunk", [1000, 20, 1])
def test_spline_in_chunks(spark, gappy, chunk):
    """Chunks of any size, some without a known sample, against one solve of the whole trial; few known samples give a polynomial."""
    few = [("d", i, "note", *([float(i * i) if i in (2, 5, 9) else None] * 4), *([float(i) if i in (3, 19) else None] * 2), *([1.0 if i == 4 else None] * 2)) for i in range(24)]
    frames = gappy.union(spark.createDataFrame(few, gappy.schema)).repartition(3)
    raw, got = by_trial(frames), by_trial(correct.interpolate_gaps(frames, "cubicspline", 15, chunk))
    for t, points in raw.items():
        want = points.copy()
        for j in range(8):
            known = np.flatnonzero(~np.isnan(points[:, j]))
            for a, b in zip(known, known[1:]):
                if 1 < b - a <= 17:
                    at = np.arange(a + 1, b)
                    want[at, j] = numerics.not_a_knot(known.astype(float), points[known, j], at.astype(float))
        np.testing.assert_allclose(got[t], want, rtol=1e-8, atol=1e-8)
    assert (np.isnan(raw["a"]) & ~np.isnan(got["a"])).any()


def test_spline_of_short_trials_beside_long_ones(spark, gappy):
    """Trials of one chunk, one of them with few known samples, take no part in the scans of the others."""
    few = [("d", i, "note", *[float(i * i) if i in (2, 5, 9) else None] * 8) for i in range(12)]
    frames = gappy.union(spark.createDataFrame(few, gappy.schema))
    mixed, whole = (by_trial(correct.interpolate_gaps(frames, "cubicspline", 15, chunk)) for chunk in (41, 1000))
    for t, points in whole.items():
        np.testing.assert_allclose(mixed[t], points, rtol=1e-8, atol=1e-8)
    assert mixed["d"][2:10, 0] == pytest.approx([float(i * i) for i in range(2, 10)]) and np.isnan(mixed["d"][[0, 1, 10, 11]]).all()
    spread = correct.interpolate_gaps(frames, "cubicspline", 15)
    assert spread._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("validate", [False, True])
def test_correction_at_rates_of_the_trials(spark, validate):
    """One table of trials of two rates is corrected as each trial is by itself."""
    rng = np.random.default_rng(5)
    points = np.cumsum(rng.normal(size=(90, 8)), axis=0)
    points[20:23, :2], points[50:52, :2] = points[20:23, 2:4], points[50:52, 2:4]
    rows = [(t, i, fps, *map(float, p)) for t, fps in ((1, 2.0), (2, 60.0)) for i, p in enumerate(points)]
    frames = spark.createDataFrame(rows, "trial_id long, frame long, fps double, " + ", ".join(f"{c} double" for c in POSITIONS))
    got = by_trial(correct.tracking_correction(frames, F.col("fps"), interpolate="cubicspline", validate=validate))
    for t, fps in ((1, 2), (2, 60)):
        np.testing.assert_array_equal(got[t], by_trial(correct.tracking_correction(frames.where(F.col("trial_id") == t), fps, interpolate="cubicspline", validate=validate))[t])
    assert not np.array_equal(got[1], got[2])


@pytest.mark.parametrize("block", [4, 1000])
def test_long_spectra_are_split(spark, block):
    """Lengths that factor and lengths that do not, in groups far smaller than they are."""
    rng = np.random.default_rng(6)
    data = {n: rng.normal(size=n) for n in (1, 2, 3, 60, 61, 64, 97, 143, 202)}
    frames = spark.createDataFrame([(n, i, float(v)) for n, x in data.items() for i, v in enumerate(x)], "trial_id long, frame long, v double").repartition(5)
    got = cohort.fft_spectrum(frames, "v", 30, block=block).toPandas()
    assert set(got["trial_id"]) == set(data) - {1}
    for n, own in got.groupby("trial_id"):
        own = own.sort_values("k")
        np.testing.assert_allclose(own["amplitude"], np.abs(np.fft.fft(data[n]))[: n // 2], atol=1e-9)
        np.testing.assert_allclose(own["freq"], np.fft.fftfreq(n, n / 30 / (n - 1))[: n // 2])
    from trackspark.operators.fourier import split_of

    for n in range(block + 1, 3000):
        size, parts = split_of(n, block)
        assert size % parts == 0 and (size == n or size >= 2 * n - 1) and max(parts, size // parts) <= max(block, 4 * math.isqrt(n) + 4)


def test_spectra_of_empty_tables(spark):
    assert cohort.fft_spectrum(line(spark, [1.0]).limit(0), "x").isEmpty()


def test_mixture_is_a_stationary_point_of_the_likelihood(spark):
    rng = np.random.default_rng(9)
    xs = np.concatenate([rng.normal(0, 1, 500), rng.normal(6, 0.5, 300), rng.normal(12, 2, 200), [100.0, -50.0]])
    values = spark.createDataFrame([(float(x),) for x in xs] + [(None,), (float(xs[3]),)], "v double").repartition(4)
    kept = np.append(xs[(xs >= -10) & (xs <= 30)], xs[3])
    w, m, s = np.array([tuple(r) for r in cohort.gmm_fit(values, "v", 3, (-10, 30), 300, 1e-9).collect()]).T
    assert w.sum() == pytest.approx(1) and m == pytest.approx([0, 6, 12], abs=0.5) and w == pytest.approx([0.5, 0.3, 0.2], abs=0.03)
    p = w * np.exp(-0.5 * ((kept[:, None] - m) / s) ** 2) / s / np.sqrt(2 * np.pi)
    r = p / p.sum(axis=1, keepdims=True)
    # At a stationary point the parts are the moments of their own shares; and a coarser stop is no likelier.
    assert r.mean(axis=0) == pytest.approx(w, abs=1e-3)
    assert (r * kept[:, None]).sum(axis=0) / r.sum(axis=0) == pytest.approx(m, abs=1e-2)
    assert np.sqrt((r * (kept[:, None] - m) ** 2).sum(axis=0) / r.sum(axis=0)) == pytest.approx(s, abs=1e-2)
    likelihood = lambda parts: np.log((parts[0] * np.exp(-0.5 * ((kept[:, None] - parts[1]) / parts[2]) ** 2) / parts[2]).sum(axis=1)).mean()
    early = np.array([tuple(r) for r in cohort.gmm_fit(values, "v", 3, (-10, 30), 1).collect()]).T
    assert likelihood((w, m, s)) >= likelihood(early)
    one = cohort.gmm_fit(values, "v", 1, (-10, 30)).first()
    assert tuple(one) == pytest.approx((1, kept.mean(), kept.std()), abs=1e-6)
    assert cohort.gmm_fit(values, "v", 2, (1000, 2000)).isEmpty()
    (same,) = {tuple(r) for r in cohort.gmm_fit(values.where("v = 100"), "v", 1, (0, 200)).collect()}
    assert same == pytest.approx((1, 100, 1e-3))


def test_no_window_reads_a_trial_to_its_end_for_every_row(spark):
    """Such a window is read anew for every row, which is quadratic in a trial's frames."""
    own = track(spark, [[float(i)] * 8 for i in range(5)])
    ambiguous = spark.createDataFrame([(1, 0, 1)], "trial_id long, start_frame long, flag int")
    made = [correct.remove_edge_frames(own), correct.remove_overlaps(own, 30), correct.interpolate_gaps(own, "linear"), *[ambiguous.withColumn("f", of()) for of in (segments.fill_ambiguous_following, segments.merge_ambiguous)]]
    for df in made:
        assert "unboundedfollowing$()))" not in df._jdf.queryExecution().analyzed().toString().replace("unboundedpreceding$(), unboundedfollowing$()", "")


def test_batches_end_with_a_group(spark):
    from trackspark.operators.batches import in_batches, lists

    rows = spark.range(1000).selectExpr("concat('t', id % 7) trial_id", "id % 3 _chunk", "id frame").repartition(3)

    def of(table, groups):
        return table.select(["trial_id", "_chunk"]).take(groups.first.tolist()).append_column("frames", lists(np.stack([groups.size, table["frame"].to_numpy()[groups.first]], axis=1)))

    got = in_batches(rows, ["trial_id", "_chunk"], [F.col("frame")], of, "trial_id string, _chunk long, frames array<double>", most=20)
    want = rows.groupBy("trial_id", "_chunk").agg(F.count("frame").alias("n"), F.min("frame").alias("first"))
    assert {(r[0], r[1], *r[2]) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 21


def test_recurrences_call_python_by_batch(gappy):
    """A call for each group of frames costs more than its work, and a step of numpy for a single frame more still."""
    for made in (smoothing.filter_kalman(gappy, 30, chunk=20), smoothing.filter_butter(gappy, 30, 3.0, chunk=20), correct.interpolate_gaps(gappy, "cubicspline", 15, 20)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "GroupsIn" not in plan


def test_distributions_are_counted_in_one_pass(spark):
    raw = line(spark, [0.0, 1.0, 10.0, None, 11.0])
    got = cohort.compare_distributions(raw, line(spark, [5.0]), {"a": (F.col("x"), (0, 10)), "b": (F.col("x") * 2, (0, 4))}, 2)
    assert {(r["metric"], r["version"], r["bin"], r["count"], r["height"]) for r in got.collect()} == {
        ("a", "raw", 0, 2, 10.0), ("a", "raw", 1, 1, 10.0), ("b", "raw", 0, 1, 2.0), ("b", "raw", 1, 1, 4.0),
        ("a", "processed", 0, 0, 0.0), ("a", "processed", 1, 1, 10.0), ("b", "processed", 0, 0, 0.0), ("b", "processed", 1, 0, 0.0),
    }
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
