"""Cohort aggregations, distributions and spectra."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import nan_to_zero
from ..functions.numerics import welch
from ..schema import POSITIONS
from .fourier import BLOCK, amplitudes


def _buffered(low: Column, high: Column, buffer: float) -> tuple[Column, Column]:
    """The lower bound moves first; the upper one moves by a share of the widened range."""
    a = low - (high - low) * buffer
    return a, high + (high - a) * buffer


def column_bounds(frames: DataFrame, columns: list[str], buffer: float = 0.05) -> DataFrame:
    low, high = F.least(*[F.min(c) for c in columns]), F.greatest(*[F.max(c) for c in columns])
    if len(columns) == 1:
        low, high = F.min(columns[0]), F.max(columns[0])
    found = frames.agg(low.alias("_a"), high.alias("_b"))
    a, b = _buffered(F.col("_a"), F.col("_b"), buffer)
    return found.select(a.alias("low"), b.alias("high"))


def vector_bounds(values: DataFrame, column: str, buffer: float = 0.05, floor: float | None = None, ceil: float | None = None) -> DataFrame:
    """Bounds of a column, widened and then clamped; (0, 0) if all values are missing or zero."""
    found = values.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    none = F.col("_a").isNull() | ((F.col("_a") == 0) & (F.col("_b") == 0))
    a, b = _buffered(F.col("_a"), F.col("_b"), buffer)
    if floor is not None:
        a = F.greatest(a, F.lit(float(floor)))
    if ceil is not None:
        b = F.least(b, F.lit(float(ceil)))
    return found.select(F.when(none, 0.0).otherwise(a).alias("low"), F.when(none, 0.0).otherwise(b).alias("high"))


def sample_lengths(samples: DataFrame, sample: str = "trial_id") -> DataFrame:
    """shortest and longest number of rows of a sample."""
    return samples.groupBy(sample).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("shortest"), F.max("n").alias("longest"))


def sample_matrix(samples: DataFrame, value: str, length: int | None = None, to_min: bool = True, sample: str = "trial_id", index: str = "frame") -> DataFrame:
    """Samples at one length, the given, the shortest or the longest: longer ones are cut, shorter ones padded with nulls."""
    if length is None:
        row = sample_lengths(samples, sample).select(F.col("shortest" if to_min else "longest").alias("_length"))
    else:
        row = samples.sparkSession.range(1).select(F.lit(length).cast("long").alias("_length"))
    # One row, so broadcasting it is bounded.
    names = samples.select(sample).distinct().join(F.broadcast(row))
    spine = names.select(sample, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_length") - 1)).alias(index))
    return spine.join(samples.select(sample, index, value), [sample, index], "left")


def cohort_timeseries(samples: DataFrame, value: str, sample: str = "trial_id", index: str = "frame", exact: bool = True) -> DataFrame:
    """mean, std (population), median over samples at each index, up to the shortest sample's end.

    The median is exact, for which an index's distinct values are held in one buffer; with ``exact=False`` it is a quantile sketch of bounded size.
    """
    cut = sample_lengths(samples, sample).select(F.col("shortest").alias("_length"))
    rows = samples.join(F.broadcast(cut), F.col(index) < F.col("_length"))
    return rows.groupBy(index).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.percentile(value, F.lit(0.5)) if exact else F.percentile_approx(value, 0.5)).alias("median"))


def _bin(x: Column, span: tuple[float, float], bins: int) -> Column:
    """The equal bin (from 0) of a value, null outside the span; its right end is in the last one."""
    lo, hi = map(float, span)
    place = F.when(x == hi, F.lit(bins).cast("long")).otherwise(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(bins)))
    return F.when((x >= lo) & (x <= hi), (place - 1).cast("int"))


def histogram(values: DataFrame, column: str, span: tuple[float, float], bins: int = 100, scale: bool = False, by: list[str] | None = None) -> DataFrame:
    """bin (from 0), count in equal bins; values outside the span are left out, its right end is in the last bin. ``scale`` adds height: count times the bin's upper edge."""
    lo, hi = map(float, span)
    by = by or []
    counted = values.withColumn("bin", _bin(F.col(column), span, bins)).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    spine = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        spine = values.select(*by).distinct().join(F.broadcast(spine))
    out = spine.join(counted, [*by, "bin"], "left").withColumn("count", F.coalesce("n", F.lit(0).cast("long"))).drop("n")
    return out.withColumn("height", F.col("count") * (F.lit(lo) + (F.col("bin") + 1) * F.lit((hi - lo) / bins))) if scale else out


KERNELS = ("gaussian", "tophat", "epanechnikov", "exponential", "linear", "cosine")
#: Bandwidths from a value out to which a Gaussian is evaluated.
REACH = 8
#: Bandwidths that a block of the exponential kernel's scans is long: what decays over one is lost in a double's rounding, and its inverse is no overflow.
DECAY = 200


def bandwidth_of(n: Column, rule: str) -> Column:
    """Bandwidth by a rule of thumb for n values; neither rule looks at their spread."""
    if rule not in ("scott", "silverman"):
        raise ValueError("bandwidth must be a number, scott or silverman")
    return F.pow(n * 0.75 if rule == "silverman" else n.cast("double"), F.lit(-0.2))


class _Grid:
    """An even grid of points, and the first of them beyond a place."""

    def __init__(self, span: tuple[float, float], resolution: int):
        self.lo, self.hi = map(float, span)
        self.size = resolution
        self.step = (self.hi - self.lo) / (resolution - 1)

    def x(self, k: Column) -> Column:
        return F.lit(self.lo) + k * F.lit(self.step)

    def first(self, near: Column, beyond) -> Column:
        """The least k for which ``beyond(x(k))``, about where x is ``near``; the size of the grid if there is none. Settled by the points themselves, not by the quotient."""
        k = F.least(F.greatest(F.floor((near - self.lo) / self.step), F.lit(-2)), F.lit(self.size)).cast("long")
        some = F.filter(F.transform(F.array(*[F.lit(i).cast("long") for i in range(-2, 4)]), lambda i: F.greatest(F.least(k + i, F.lit(self.size)), F.lit(0))), lambda i: beyond(self.x(i)) | (i == self.size))
        return F.coalesce(F.array_min(some), F.lit(self.size)).cast("long")


def _polynomial_sums(counted: DataFrame, grid: _Grid, h: float, kernel: str) -> DataFrame:
    """k, s for kernels that are sums of products of a function of the value and one of the grid point: every value adds its moments where its
    support begins and takes them away where it ends, and running sums over the grid give all sums. Two or three rows a value, whatever its support."""
    v, u = F.col("v"), (F.col("v") - grid.lo) / h
    g = F.col("k") * (grid.step / h)
    inner = [lambda x: x - v > -h, lambda x: x - v >= h]
    half = math.pi / 2
    if kernel == "tophat":
        edges, moments, value = inner, [[F.lit(1.0)]], F.col("m0")
    elif kernel == "epanechnikov":
        edges, moments, value = inner, [[F.lit(1.0), u, u * u]], F.col("m0") * (1 - g * g) + 2 * g * F.col("m1") - F.col("m2")
    elif kernel == "cosine":
        edges, moments, value = inner, [[F.cos(u * half), F.sin(u * half)]], F.col("m0") * F.cos(g * half) + F.col("m1") * F.sin(g * half)
    else:  # linear, which rises up to the value and falls after it
        edges, moments = [inner[0], lambda x: x >= v, inner[1]], [[1 - u, F.lit(1.0)], [1 + u, F.lit(-1.0)]]
        value = F.col("m0") + g * F.col("m1")
    near = {2: [v - h, v + h], 3: [v - h, v, v + h]}[len(edges)]
    at = [grid.first(n, e) for n, e in zip(near, edges)]
    names = [f"m{i}" for i in range(len(moments[0]))]
    steps = []
    for piece, (a, b) in zip(moments, zip(at, at[1:])):
        for k, sign in ((a, 1.0), (b, -1.0)):
            steps.append(F.struct(k.alias("k"), *[(F.col("w") * sign * m).alias(n) for m, n in zip(piece, names)]))
    rows = counted.select(F.explode(F.array(*steps)).alias("r")).select("r.*").groupBy("k").agg(*[F.sum(n).alias(n) for n in names])
    # The grid has ``resolution`` rows, so one ordered window is bounded.
    so_far = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    line = counted.sparkSession.range(grid.size).select(F.col("id").alias("k")).join(F.broadcast(rows), "k", "left")
    line = line.select("k", *[F.sum(F.coalesce(n, F.lit(0.0))).over(so_far).alias(n) for n in names])
    return line.select("k", F.greatest(value, F.lit(0.0)).alias("s"))


def _exponential_sums(counted: DataFrame, grid: _Grid, h: float) -> DataFrame:
    """k, s of exp(-|x - v| / h) by two scans that decay along the grid, forward from the values before a point and backward from those after it.

    In blocks of DECAY bandwidths the terms are weighed by their place and summed up; of the blocks before, only the next can still be felt.
    """
    v = F.col("v")
    rate = grid.step / h
    i = grid.first(v, lambda x: x >= v)
    # Of each value what it adds at the point after it and at the point before it.
    ends = counted.withColumn("i", i).select(
        F.explode(F.array(F.struct(F.col("i").alias("k"), (F.col("w") * F.exp(-(grid.x(F.col("i")) - v) / h)).alias("f"), F.lit(0.0).alias("b")), F.struct((F.col("i") - 1).alias("k"), F.lit(0.0).alias("f"), (F.col("w") * F.exp(-(v - grid.x(F.col("i") - 1)) / h)).alias("b")))).alias("r")
    ).select("r.*").where((F.col("k") >= 0) & (F.col("k") < grid.size)).groupBy("k").agg(F.sum("f").alias("f"), F.sum("b").alias("b"))
    width = max(1, int(DECAY / rate)) if rate < DECAY else 1
    line = counted.sparkSession.range(grid.size).select(F.col("id").alias("k"), F.floor(F.col("id") / width).alias("block")).join(F.broadcast(ends), "k", "left").fillna(0.0, ["f", "b"])
    at, last = F.col("k") - F.col("block") * width, width - 1
    held = Window.partitionBy("block").orderBy("k")
    before, after = held.rowsBetween(Window.unboundedPreceding, 0), held.rowsBetween(0, Window.unboundedFollowing)
    own = line.select("k", "block", (F.sum(F.col("f") * F.exp(at * rate)).over(before) * F.exp(-at * rate)).alias("f"), (F.sum(F.col("b") * F.exp(-at * rate)).over(after) * F.exp(at * rate)).alias("b"))
    # What a block hands on: the forward sum at its last point, the backward sum at its first.
    sums = line.groupBy("block").agg(F.sum(F.col("f") * F.exp((at - last) * rate)).alias("to_next"), F.sum(F.col("b") * F.exp(-at * rate)).alias("to_before"))
    met = own.join(F.broadcast(sums.select((F.col("block") + 1).alias("block"), "to_next")), "block", "left").join(F.broadcast(sums.select((F.col("block") - 1).alias("block"), "to_before")), "block", "left")
    return met.select("k", (F.col("f") + F.col("b") + F.coalesce(F.col("to_next") * F.exp(-(at + 1) * rate), F.lit(0.0)) + F.coalesce(F.col("to_before") * F.exp(-(width - at) * rate), F.lit(0.0))).alias("s"))


def _met_sums(counted: DataFrame, grid: _Grid, h: float, kernel: str) -> DataFrame:
    """k, s by every value's meeting the grid points that it reaches: a Gaussian, or a support narrower than the grid's step."""
    reach = REACH if kernel == "gaussian" else 1
    v, size = F.col("v"), grid.size
    first = F.greatest(F.lit(0), F.ceil((v - reach * h - grid.lo) / grid.step))
    last = F.least(F.lit(size - 1), F.floor((v + reach * h - grid.lo) / grid.step))
    near = counted.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    away = grid.x(F.col("k")) - v
    z = away / h
    height = {"gaussian": F.exp(-0.5 * z * z), "tophat": F.lit(1.0), "epanechnikov": 1 - z * z, "linear": 1 - F.abs(z), "cosine": F.cos(z * (math.pi / 2))}[kernel]
    if kernel != "gaussian":
        height = F.when(F.abs(away) < h, height).otherwise(0.0)
    return near.groupBy("k").agg(F.sum(F.col("w") * height).alias("s"))


def kde(values: DataFrame, column: str, span: tuple[float, float], resolution: int = 1000, bandwidth: float | str = 1.0, cell: float | None = None, kernel: str = "gaussian") -> DataFrame:
    """x, density of a kernel estimate on an even grid; missing values are left out, and without any there is no row.

    ``kernel``: one of KERNELS. ``bandwidth``: a number, or the rule scott or silverman. The compact kernels (tophat, epanechnikov, linear, cosine) and the exponential one cost a few rows a
    distinct value and a running sum over the grid. A Gaussian meets the grid points within REACH bandwidths; beyond them it is under 1e-13 of its peak. All sums are formed
    in the tasks before the shuffle, which carries a row a task and grid point. ``cell`` first counts values
    in cells of that width, which bounds the work for very many values at the price of moving each by half a cell at most.
    """
    if kernel not in KERNELS:
        raise ValueError(f"kernel must be one of {', '.join(KERNELS)}")
    grid = _Grid(span, resolution)
    own = values.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(F.col(column).cast("double").alias("v"))
    h = bandwidth if not isinstance(bandwidth, str) else own.agg(bandwidth_of(F.count(F.lit(1)), bandwidth)).first()[0]
    if cell:
        own = own.withColumn("v", (F.floor(F.col("v") / cell) + 0.5) * cell)
    counted = own.groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    total = counted.agg(F.sum("w").alias("total"))
    if h is None or not math.isfinite(h):
        h = 1.0  # no value, so no row
    sums = _exponential_sums(counted, grid, h) if kernel == "exponential" else _met_sums(counted, grid, h, kernel) if kernel == "gaussian" or h < grid.step else _polynomial_sums(counted, grid, h, kernel)
    mass = {"gaussian": math.sqrt(2 * math.pi), "tophat": 2.0, "epanechnikov": 4 / 3, "exponential": 2.0, "linear": 1.0, "cosine": 4 / math.pi}[kernel]
    line = values.sparkSession.range(resolution).select(grid.x(F.col("id")).alias("x"), F.col("id").alias("k"))
    rows = line.join(F.broadcast(sums), "k", "left").join(F.broadcast(total))
    return rows.where("total > 0").select("x", (F.coalesce("s", F.lit(0.0)) / (F.col("total") * (h * mass))).alias("density"))


#: Added to every variance of a mixture, so that none is zero.
LEAST_VARIANCE = 1e-6


def _part_sums(counted: DataFrame, shares: list[Column], centres: list[float], more: list[Column]) -> list[list[float]]:
    """One pass over the counted values: for each part the sums of its shares, of the distances from its centre and of their squares; then the sums of ``more``."""
    made = []
    for share, m in zip(shares, centres):
        d = F.col("v") - F.lit(m)
        made += [F.sum(F.col("w") * share), F.sum(F.col("w") * share * d), F.sum(F.col("w") * share * d * d)]
    row = counted.agg(*[F.coalesce(c, F.lit(0.0)).alias(f"c{i}") for i, c in enumerate([*made, *[F.sum(F.col("w") * c) for c in more]])]).first()
    return [list(row[3 * i : 3 * i + 3]) for i in range(len(shares))] + [list(row[3 * len(shares) :])]


def _moments(sums: list[list[float]], centres: list[float]) -> list[tuple[float, float, float]]:
    """(weight, mean, sigma) of each part from sums about a centre; a part without a share stays where it is."""
    total = sum(a for a, _, _ in sums)
    out = []
    for (a, b, q), m in zip(sums, centres):
        shift = b / a if a > 0 else 0.0
        out.append((a / total, m + shift, math.sqrt(max(0.0, q / a - shift * shift if a > 0 else 0.0) + LEAST_VARIANCE)))
    return out


def gmm_fit(values: DataFrame, column: str, peaks: int, span: tuple[float, float], most: int = 100, tolerance: float = 1e-3) -> DataFrame:
    """weight, mean, sigma, by mean, of each part of a Gaussian mixture fitted to the values in the span; no row without values.

    Expectation and maximisation, each turn one aggregate of every part's sufficient statistics over the distinct values and their counts: what comes to the driver is three numbers a part. It
    starts from the groups of k-means, that from centres spread evenly over the values, and ends when a turn changes the mean log-likelihood by less than ``tolerance``, after ``most`` turns at the latest.
    """
    counted = values.where(F.col(column).between(*map(float, span))).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("w")).persist()
    try:
        low, high = counted.agg(F.min("v"), F.max("v")).first()
        if low is None:
            return values.sparkSession.createDataFrame([], "weight double, mean double, sigma double")
        centres = [low + (i + 0.5) / peaks * (high - low) for i in range(peaks)]
        for _ in range(most):
            away = F.array(*[F.abs(F.col("v") - F.lit(m)) for m in centres])
            nearest = F.array_position(away, F.array_min(away))
            sums = _part_sums(counted, [(nearest == i + 1).cast("double") for i in range(peaks)], centres, [])[:-1]
            parts = _moments(sums, centres)
            moved = [m for _, m, _ in parts]
            if max(abs(a - b) for a, b in zip(centres, moved)) <= 1e-12 * max(1.0, abs(high), abs(low)):
                break
            centres = moved
        before = -math.inf
        for _ in range(most):
            # Logarithms of the parts' densities, so that a value far from all of them still has shares.
            logs = [F.lit(math.log(w) - math.log(s)) - 0.5 * ((F.col("v") - F.lit(m)) / s) * ((F.col("v") - F.lit(m)) / s) if w > 0 else F.lit(-math.inf) for w, m, s in parts]
            top = F.greatest(*logs) if peaks > 1 else logs[0]
            whole = top + F.log(sum((F.exp(x - top) for x in logs[1:]), F.exp(logs[0] - top)))
            *sums, (likelihood,) = _part_sums(counted, [F.exp(x - whole) for x in logs], [m for _, m, _ in parts], [whole - 0.5 * math.log(2 * math.pi)])
            parts = _moments(sums, [m for _, m, _ in parts])
            now = likelihood / sum(a for a, _, _ in sums)
            if abs(now - before) < tolerance:
                break
            before = now
    finally:
        counted.unpersist()
    return values.sparkSession.createDataFrame(sorted(parts, key=lambda p: p[1]), "weight double, mean double, sigma double")


def gmm_density_minima(parts: DataFrame, span: tuple[float, float], resolution: int = 1000) -> DataFrame:
    """index, x, density at strict local minima of a mixture's density on an even grid."""
    lo, hi = map(float, span)
    grid = parts.sparkSession.range(resolution).select(F.col("id").alias("index"), (F.lit(lo) + F.col("id") * F.lit((hi - lo) / (resolution - 1))).alias("x"))
    z = (F.col("x") - F.col("mean")) / F.col("sigma")
    pdf = F.col("weight") * F.exp(-0.5 * z * z) / (F.col("sigma") * math.sqrt(2 * math.pi))
    line = grid.join(F.broadcast(parts)).groupBy("index", "x").agg(F.sum(pdf).alias("density"))
    # The grid has ``resolution`` rows, so one ordered window is bounded.
    w = Window.partitionBy(F.lit(0)).orderBy("index")
    return line.withColumn("_a", F.lag("density").over(w)).withColumn("_b", F.lead("density").over(w)).where("density < _a and density < _b").select("index", "x", "density")


def fft_spectrum(samples: DataFrame, value: str, fps: float = 30, sample: str = "trial_id", index: str = "frame", block: int = BLOCK) -> DataFrame:
    """sample, k, freq, amplitude of each sample's one-sided spectrum; samples of one row have none. ``index`` counts from 0 in each sample.

    A sample of up to ``block`` rows is one group; a longer one is dealt to groups of about that size, see ``fourier``.
    """
    kind = dict(samples.dtypes)[sample]
    own = samples.select(sample, F.col(index).cast("long").alias("pos"), nan_to_zero(F.col(value)).cast("double").alias("v"))
    lengths = own.groupBy(sample).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("pos")["v"].to_numpy(float)
        a = np.abs(np.fft.fft(x))[: len(x) // 2]
        return pd.DataFrame({sample: [rows[sample].iloc[0]] * len(a), "n": len(x), "k": np.arange(len(a)), "amplitude": a})

    short = own.join(lengths.where(F.col("n") <= block).select(sample), sample).groupBy(sample).applyInPandas(run, f"{sample} {kind}, n long, k long, amplitude double")
    made = short.unionByName(amplitudes(own, lengths.where(F.col("n") > block), sample, block))
    n = F.col("n")
    return made.select(sample, "k", (F.col("k") / (n * (n / F.lit(float(fps)) / (n - 1)))).alias("freq"), "amplitude")


def dft_spectrum(samples: DataFrame, value: str, frequencies: int, fps: float = 30, sample: str = "trial_id", index: str = "frame") -> DataFrame:
    """The first amplitudes of the same spectrum by sums of cosines and sines: each row meets a fixed number of frequencies."""
    n = F.count(F.lit(1)).over(Window.partitionBy(sample))
    own = samples.select(sample, index, nan_to_zero(F.col(value)).alias("_v"), n.alias("_n"))
    rows = own.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frequencies - 1).cast("long"))))
    angle = F.lit(2 * math.pi) * F.col("k") * F.col(index) / F.col("_n")
    sums = rows.groupBy(sample, "k").agg(F.sum(F.col("_v") * F.cos(angle)).alias("_c"), F.sum(F.col("_v") * F.sin(angle)).alias("_s"), F.max("_n").alias("_n"))
    n = F.col("_n")
    freq = F.col("k") / (n * (n / F.lit(float(fps))) / (n - 1))
    return sums.select(sample, "k", freq.alias("freq"), F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")).alias("amplitude"))


def welch_psd(samples: DataFrame, value: str, fps: float = 30, sample: str = "trial_id", index: str = "frame", size: int = 256) -> DataFrame:
    """freq, mean, std (population) over samples of their power densities. ``index`` counts from 0 in each sample.

    Every row goes to the one or two half-overlapping segments that hold it, so a group is a segment of ``size`` rows, however long the sample.
    """
    kind = dict(samples.dtypes)[sample]
    lengths = samples.groupBy(sample).agg(F.count(F.lit(1)).alias("_n"))
    width = F.least(F.lit(size).cast("long"), F.col("_n"))
    step = width - F.floor(width / 2)
    at = F.col(index)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((at - width + 1) / step))
    last = F.least(F.floor(at / step), F.floor((F.col("_n") - width) / step))
    rows = samples.select(sample, index, nan_to_zero(F.col(value)).alias("_v")).join(lengths, sample).where(first <= last)
    parts = rows.withColumn("_part", F.explode(F.sequence(first, last)))

    def power(part: pd.DataFrame) -> pd.DataFrame:
        f, p = welch(part.sort_values(index)["_v"].to_numpy(float), fps, size)
        return pd.DataFrame({sample: [part[sample].iloc[0]] * len(f), "freq": f, "power": p})

    made = parts.groupBy(sample, "_part").applyInPandas(power, f"{sample} {kind}, freq double, power double")
    return made.groupBy(sample, "freq").agg(F.avg("power").alias("power")).groupBy("freq").agg(F.avg("power").alias("mean"), F.stddev_pop("power").alias("std"))


def compare_distributions(raw: DataFrame, processed: DataFrame, metrics: dict[str, tuple[Column, tuple[float, float]]], bins: int = 100) -> DataFrame:
    """metric, version (raw or processed), bin, count, height: scaled histograms of each metric, all counted in one pass over both versions."""
    both = None
    for version, frames in (("raw", raw), ("processed", processed)):
        own = frames.select(F.lit(version).alias("version"), *[c.alias(n) for n, (c, _) in metrics.items()])
        both = own if both is None else both.unionByName(own)
    placed = F.array(*[F.struct(F.lit(n).alias("metric"), _bin(F.col(n), span, bins).alias("bin")) for n, (_, span) in metrics.items()])
    counted = both.select("version", F.inline(placed)).groupBy("version", "metric", "bin").agg(F.count(F.lit(1)).alias("n"))
    # A version's counts of a metric are one row for a moment, at most ``bins`` of them, so that empty bins need no second look at the rows.
    held = counted.groupBy("version", "metric").agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("_counts"))
    out = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).withColumn("count", F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0).cast("long")))
    height = F.coalesce(*[F.when(F.col("metric") == n, F.col("count") * (F.lit(float(lo)) + (F.col("bin") + 1) * F.lit((float(hi) - float(lo)) / bins))) for n, (_, (lo, hi)) in metrics.items()])
    return out.select("metric", "version", "bin", "count", height.alias("height"))


def compare_tracks(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """For each trial: frames, changed and blanked head positions, mean head displacement, shared bounds of the heads."""
    a = raw.select("trial_id", "frame", *[F.col(c).alias(f"r_{c}") for c in POSITIONS])
    met = a.join(processed.select("trial_id", "frame", *POSITIONS), ["trial_id", "frame"])
    dx, dy = F.col("xhead") - F.col("r_xhead"), F.col("yhead") - F.col("r_yhead")
    return met.groupBy("trial_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if((dx != 0) | (dy != 0)).alias("changed"),
        F.count_if(F.col("xhead").isNull() & F.col("r_xhead").isNotNull()).alias("blanked"),
        F.avg(F.sqrt(dx * dx + dy * dy)).alias("displacement"),
        F.least(F.min("xhead"), F.min("r_xhead")).alias("xlow"),
        F.greatest(F.max("xhead"), F.max("r_xhead")).alias("xhigh"),
    )
