"""Queries of cohort aggregations, distributions and spectra."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import kinematics as k
from ..operators import cohort, correct
from .corrections import DONE
from .fixture import SQL, pose
from .frames import ONE, TM, r6, s6, sql_angle, sql_norm
from .registry import register

POSE_COLUMNS = ["xhead", "xtail", "xmid", "xctr"]


@register("column_bounds", f"{SQL} SELECT {s6('lo - (hi-lo)*0.05')} AS low, {s6('hi + (hi - (lo - (hi-lo)*0.05))*0.05')} AS high FROM (SELECT min(least({', '.join(POSE_COLUMNS)})) AS lo, max(greatest({', '.join(POSE_COLUMNS)})) AS hi FROM pose)")
def column_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.column_bounds(pose(spark, sf_dir), POSE_COLUMNS).select(r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@register("vector_bounds", f"SELECT {s6('greatest(lo - (hi-lo)*0.05, 0)')} AS low, {s6('hi + (hi - (lo - (hi-lo)*0.05))*0.05')} AS high FROM (SELECT min(value) AS lo, max(value) AS hi FROM events)")
def vector_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.vector_bounds(events(spark, sf_dir), "value", 0.05, floor=0).select(r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


SAMPLES = "s AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i, value FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order, as one sample."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events(spark, sf_dir).select("user_id", at.cast("long").alias("i"), "value")


@register("sample_length_minmax", f"WITH {SAMPLES} SELECT min(n) AS shortest, max(n) AS longest FROM (SELECT count(*) AS n FROM s GROUP BY user_id)")
def sample_length_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.sample_lengths(samples(spark, sf_dir), "user_id")


@register("sample_matrix", f"WITH {SAMPLES}, m AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM s GROUP BY user_id)) SELECT u.user_id, r.i, s.value FROM (SELECT DISTINCT user_id FROM s) u CROSS JOIN (SELECT unnest(range(n)) AS i FROM m) r LEFT JOIN s ON s.user_id = u.user_id AND s.i = r.i")
def sample_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.sample_matrix(samples(spark, sf_dir), "value", to_min=False, sample="user_id", index="i")


@register("cohort_timeseries", f"WITH {SAMPLES} SELECT i, {s6('avg(value)')} AS mean, {s6('stddev_pop(value)')} AS std, {s6('median(value)')} AS median FROM s WHERE i < (SELECT min(n) FROM (SELECT count(*) AS n FROM s GROUP BY user_id)) GROUP BY i")
def cohort_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.cohort_timeseries(samples(spark, sf_dir), "value", "user_id", "i").withColumns({c: r6(F.col(c)) for c in ("mean", "std", "median")})


def sql_histogram(source: str, column: str, lo: float, hi: float, bins: int, by: str = "") -> str:
    place = f"least(CAST(floor(({column} - {lo}) / (({hi} - {lo}) / {bins})) AS INT), {bins - 1})"
    spine = f"(SELECT CAST(unnest(range({bins})) AS INT) AS bin)"
    keys = f"{by}, " if by else ""
    names = f"(SELECT DISTINCT {by} FROM {source})" if by else "(SELECT 1)"
    on = f"c.bin = r.bin AND c.{by} = u.{by}" if by else "c.bin = r.bin"
    head = f"u.{by}, " if by else ""
    return f"(SELECT {head}r.bin, coalesce(c.n, 0) AS count, coalesce(c.n, 0) * ({lo} + (r.bin + 1) * (CAST({hi} - {lo} AS DOUBLE) / {bins})) AS height FROM {names} u CROSS JOIN {spine} r LEFT JOIN (SELECT {keys}{place} AS bin, count(*) AS n FROM {source} WHERE {column} >= {lo} AND {column} <= {hi} GROUP BY ALL) c ON {on})"


@register("histogram", f"SELECT bin, count, {s6('height')} AS height FROM {sql_histogram('events', 'value', 0, 400, 64)}")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.histogram(events(spark, sf_dir), "value", (0, 400), 64, True).withColumn("height", r6(F.col("height")))


@register("kde", f"SELECT round(x, 6) AS x, round(avg(exp(-0.5 * ((x - value) / 8) * ((x - value) / 8)) / (8 * sqrt(2 * pi()))), 9) AS density FROM events CROSS JOIN (SELECT CAST(unnest(range(200)) AS DOUBLE) * (CAST(400 AS DOUBLE) / 199) AS x) GROUP BY ALL")
def kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.kde(events(spark, sf_dir), "value", (0, 400), 200, 8.0).select(F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


# Linear sums of values of two decimals end in 5 at the tenth digit often with a bandwidth of 8, so that one has another.
# Each kernel's height at a distance of z bandwidths, the area under it, and the bandwidth of its query.
_HEIGHTS = {
    "tophat": ("CASE WHEN abs(x - value) < h THEN 1.0 ELSE 0 END", "2", "CAST(8 AS DOUBLE)"),
    "epanechnikov": ("CASE WHEN abs(z) < 1 THEN 1 - z * z ELSE 0 END", "(CAST(4 AS DOUBLE) / 3)", "CAST(8 AS DOUBLE)"),
    "exponential": ("exp(-abs(z))", "2", "CAST(8 AS DOUBLE)"),
    "linear": ("CASE WHEN abs(z) < 1 THEN 1 - abs(z) ELSE 0 END", "1", "CAST(7.3 AS DOUBLE)"),
    "cosine": ("CASE WHEN abs(z) < 1 THEN cos(z * pi() / 2) ELSE 0 END", "(4 / pi())", "CAST(8 AS DOUBLE)"),
    "scott": ("exp(-0.5 * z * z)", "sqrt(2 * pi())", "pow(n, CAST(-0.2 AS DOUBLE))"),
    "silverman": ("CASE WHEN abs(z) < 1 THEN 1 - z * z ELSE 0 END", "(CAST(4 AS DOUBLE) / 3)", "pow(n * CAST(0.75 AS DOUBLE), CAST(-0.2 AS DOUBLE))"),
}


def _sql_kde(name: str) -> str:
    height, mass, h = _HEIGHTS[name]
    grid = "(SELECT CAST(unnest(range(200)) AS DOUBLE) * (CAST(400 AS DOUBLE) / 199) AS x)"
    return f"SELECT round(x, 6) AS x, round(avg({height} / (h * {mass})), 9) + CAST(0 AS DOUBLE) AS density FROM (SELECT x, value, h, (x - value) / h AS z FROM events CROSS JOIN (SELECT {h} AS h FROM (SELECT count(*) AS n FROM events)) CROSS JOIN {grid}) GROUP BY x"


def _kde(name: str) -> None:
    rule = name in ("scott", "silverman")

    @register(f"kde_{name}", _sql_kde(name))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        kernel = {"scott": "gaussian", "silverman": "epanechnikov"}.get(name, name)
        made = cohort.kde(events(spark, sf_dir), "value", (0, 400), 200, name if rule else 7.3 if name == "linear" else 8.0, kernel=kernel)
        return made.select(F.round("x", 6).alias("x"), (F.round("density", 9) + F.lit(0.0)).alias("density"))


for _name in _HEIGHTS:
    _kde(_name)


_PART = lambda i: f"w{i} * exp(-0.5 * ((v - m{i}) / s{i}) * ((v - m{i}) / s{i})) / s{i}"
_GMM = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT value AS v, count(*) AS c FROM events WHERE value BETWEEN 0 AND 400 GROUP BY value),
 km AS (SELECT 0 AS i, min(v) + CAST(0.25 AS DOUBLE) * (max(v) - min(v)) AS a, min(v) + CAST(0.75 AS DOUBLE) * (max(v) - min(v)) AS b FROM v
   UNION ALL SELECT i + 1, sum(CASE WHEN abs(v - a) <= abs(v - b) THEN c * v END) / sum(CASE WHEN abs(v - a) <= abs(v - b) THEN c END), sum(CASE WHEN abs(v - a) > abs(v - b) THEN c * v END) / sum(CASE WHEN abs(v - a) > abs(v - b) THEN c END) FROM km CROSS JOIN v WHERE i < 100 GROUP BY i, a, b),
 cl AS (SELECT v, c, abs(v - a) <= abs(v - b) AS low FROM v CROSS JOIN (SELECT a, b FROM km WHERE i = 100)),
 mo AS (SELECT low, CAST(sum(c) AS DOUBLE) AS n, sum(c * v) / sum(c) AS m, sum(c * v * v) / sum(c) - (sum(c * v) / sum(c)) * (sum(c * v) / sum(c)) AS q FROM cl GROUP BY low),
 em AS (SELECT 0 AS i, x.n / (x.n + y.n) AS w0, x.m AS m0, sqrt(x.q + 1e-6) AS s0, y.n / (x.n + y.n) AS w1, y.m AS m1, sqrt(y.q + 1e-6) AS s1, CAST('-inf' AS DOUBLE) AS ll, FALSE AS done FROM mo x JOIN mo y ON x.low AND NOT y.low
   UNION ALL SELECT i + 1, a0 / (a0 + a1), m0 + b0 / a0, sqrt(q0 / a0 - (b0 / a0) * (b0 / a0) + 1e-6), a1 / (a0 + a1), m1 + b1 / a1, sqrt(q1 / a1 - (b1 / a1) * (b1 / a1) + 1e-6), l / (a0 + a1), coalesce(abs(l / (a0 + a1) - ll) < 1e-3, FALSE)
   FROM (SELECT i, m0, m1, ll, sum(c * p0 / (p0 + p1)) AS a0, sum(c * p0 / (p0 + p1) * (v - m0)) AS b0, sum(c * p0 / (p0 + p1) * (v - m0) * (v - m0)) AS q0,
           sum(c * p1 / (p0 + p1)) AS a1, sum(c * p1 / (p0 + p1) * (v - m1)) AS b1, sum(c * p1 / (p0 + p1) * (v - m1) * (v - m1)) AS q1, sum(c * ln((p0 + p1) / sqrt(2 * pi()))) AS l
         FROM (SELECT i, m0, m1, ll, v, c, {_PART(0)} AS p0, {_PART(1)} AS p1 FROM em CROSS JOIN v WHERE NOT done AND i < 100) GROUP BY i, m0, m1, ll)),
 f AS (SELECT * FROM em ORDER BY i DESC LIMIT 1)
 SELECT {s6('w0')} AS weight, {s6('m0')} AS mean, {s6('s0')} AS sigma FROM f UNION ALL SELECT {s6('w1')}, {s6('m1')}, {s6('s1')} FROM f"""


@register("gmm_fit", _GMM)
def gmm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.gmm_fit(events(spark, sf_dir), "value", 2, (0, 400)).select(*[r6(F.col(c)).alias(c) for c in ("weight", "mean", "sigma")])


_PARTS = "p AS (SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS weight, avg(value) AS mean, stddev_pop(value) / 4 AS sigma FROM events GROUP BY value < 150)"


@register(
    "gmm_density_minima",
    f"WITH {_PARTS}, l AS (SELECT i AS index, CAST(i AS DOUBLE) * (CAST(400 AS DOUBLE) / 999) AS x, sum(weight * exp(-0.5 * ((CAST(i AS DOUBLE) * (CAST(400 AS DOUBLE) / 999) - mean) / sigma) * ((CAST(i AS DOUBLE) * (CAST(400 AS DOUBLE) / 999) - mean) / sigma)) / (sigma * sqrt(2 * pi()))) AS density FROM p CROSS JOIN (SELECT unnest(range(1000)) AS i) GROUP BY i)"
    " SELECT index, round(x, 6) AS x, round(density, 9) AS density FROM (SELECT *, lag(density) OVER (ORDER BY index) AS a, lead(density) OVER (ORDER BY index) AS b FROM l) WHERE density < a AND density < b",
)
def gmm_density_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minima between two parts that are given by the moments of the values under and over 150."""
    own = events(spark, sf_dir)
    parts = own.groupBy((F.col("value") < 150).alias("_low")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.stddev_pop("value") / 4).alias("sigma"))
    total = own.agg(F.count(F.lit(1)).alias("_total"))
    parts = parts.join(F.broadcast(total)).select((F.col("n") / F.col("_total")).alias("weight"), "mean", "sigma")
    return cohort.gmm_density_minima(parts, (0, 400)).select("index", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


_FFT = f"{SQL}, c AS MATERIALIZED (SELECT trial_id, frame, xctr - 640 AS v, count(*) OVER (PARTITION BY trial_id) AS n FROM pose) SELECT trial_id, k, {s6('k / (max(n) * (max(n) / CAST(30 AS DOUBLE)) / (max(n) - 1))')} AS freq, round(sqrt(sum(v*cos(2*pi()*(k*frame%n)/n)) * sum(v*cos(2*pi()*(k*frame%n)/n)) + sum(v*sin(2*pi()*(k*frame%n)/n)) * sum(v*sin(2*pi()*(k*frame%n)/n))), 3) + CAST(0 AS DOUBLE) AS amplitude FROM (SELECT *, unnest(range(n // 2)) AS k FROM c WHERE n > 1) GROUP BY trial_id, k"


def _fft(name: str, block: int) -> None:
    @register(name, _FFT)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = pose(spark, sf_dir).select("trial_id", "frame", (F.col("xctr") - 640).alias("v"))
        return cohort.fft_spectrum(own, "v", 30, block=block).select("trial_id", "k", r6(F.col("freq")).alias("freq"), (F.round("amplitude", 3) + F.lit(0.0)).alias("amplitude"))


# Trials as one group each, and trials dealt to several groups.
_fft("fft_spectrum", cohort.BLOCK)
_fft("fft_spectrum_split", 256)


@register(
    "dft_spectrum",
    f"{SQL}, c AS (SELECT trial_id, frame, xctr - 640 AS v, count(*) OVER (PARTITION BY trial_id) AS n FROM pose) SELECT trial_id, k, {s6('k / (max(n) * (max(n) / CAST(30 AS DOUBLE)) / (max(n) - 1))')} AS freq, round(sqrt(sum(v*cos(2*pi()*k*frame/n)) * sum(v*cos(2*pi()*k*frame/n)) + sum(v*sin(2*pi()*k*frame/n)) * sum(v*sin(2*pi()*k*frame/n))), 3) + CAST(0 AS DOUBLE) AS amplitude FROM c CROSS JOIN (SELECT unnest(range(8)) AS k) GROUP BY trial_id, k",
)
def dft_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pose(spark, sf_dir).select("trial_id", "frame", (F.col("xctr") - 640).alias("v"))
    made = cohort.dft_spectrum(own, "v", 8, 30)
    return made.select("trial_id", "k", r6(F.col("freq")).alias("freq"), (F.round("amplitude", 3) + F.lit(0.0)).alias("amplitude"))


_HANN = "(0.5 - 0.5 * cos(2 * pi() * (frame - a) / c.size))"
_WELCH = f"""{SQL}, c AS (SELECT trial_id, frame, xctr - 640 AS v, least(256, count(*) OVER (PARTITION BY trial_id)) AS size, count(*) OVER (PARTITION BY trial_id) AS n FROM pose),
 parts AS (SELECT DISTINCT trial_id, size, unnest(range(0, n - size + 1, size - size // 2)) AS a FROM c),
 m AS MATERIALIZED (SELECT c.trial_id, p.a, c.frame, c.size, (v - avg(v) OVER (PARTITION BY c.trial_id, p.a)) * {_HANN} AS v, sum({_HANN} * {_HANN}) OVER (PARTITION BY c.trial_id, p.a) AS w FROM c JOIN parts p ON p.trial_id = c.trial_id AND c.frame >= p.a AND c.frame < p.a + c.size),
 t AS (SELECT *, unnest(range(size // 2 + 1)) AS k, 2 * pi() * (unnest(range(size // 2 + 1)) * (frame - a) % size) / size AS angle FROM m),
 q AS (SELECT trial_id, a, k, max(size) AS size, (sum(v * cos(angle)) * sum(v * cos(angle)) + sum(v * sin(angle)) * sum(v * sin(angle))) / (30 * max(w)) * CASE WHEN k = 0 OR 2 * k = max(size) THEN 1 ELSE 2 END AS power FROM t GROUP BY trial_id, a, k),
 e AS (SELECT trial_id, round(k * CAST(30 AS DOUBLE) / max(size), 6) AS freq, avg(power) AS power FROM q GROUP BY trial_id, k)"""


@register("welch_psd", f"{_WELCH} SELECT freq, {s6('avg(power)')} AS mean, {s6('stddev_pop(power)')} AS std FROM e GROUP BY freq")
def welch_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pose(spark, sf_dir).select("trial_id", "frame", (F.col("xctr") - 640).alias("v"))
    made = cohort.welch_psd(own, "v", 30)
    return made.select(F.round("freq", 6).alias("freq"), r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


_METRICS = {"distance": (sql_norm("xtail-xhead", "ytail-yhead"), 0, 60), "orientation": (sql_angle(ONE, TM), 0, math.pi), "rate": (f"abs({sql_angle(ONE, TM)} - lag({sql_angle(ONE, TM)}) OVER (PARTITION BY version, trial_id ORDER BY frame))", 0, 1)}
_BOTH = f"(SELECT 'raw' AS version, trial_id, frame, xhead, yhead, xtail, ytail, xmid, ymid FROM pose UNION ALL SELECT 'processed', trial_id, frame, xhead, yhead, xtail, ytail, xmid, ymid FROM done)"


@register(
    "compare_distributions",
    f"{SQL}{DONE}, mv AS MATERIALIZED (SELECT version, {', '.join(f'round({v}, 9) AS {n}' for n, (v, _, _) in _METRICS.items())} FROM {_BOTH})"
    + " UNION ALL ".join(f" SELECT '{n}' AS metric, version, bin, count, {s6('height')} AS height FROM {sql_histogram('mv', n, lo, round(hi, 6), 100, 'version')}" for n, (_, lo, hi) in _METRICS.items()),
)
def compare_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = pose(spark, sf_dir)
    nine = lambda c: F.round(c, 9)
    made = {"distance": (nine(g.delta_in_frame("head", "tail")), (0, 60)), "orientation": (nine(g.orientation()), (0, round(math.pi, 6))), "rate": (nine(k.reorientation(g.orientation())), (0, 1))}
    return cohort.compare_distributions(raw, correct.tracking_correction(raw), made).withColumn("height", r6(F.col("height")))


@register(
    "compare_tracks",
    f"""{SQL}{DONE} SELECT p.trial_id, count(*) AS frames, count_if(d.xhead <> p.xhead OR d.yhead <> p.yhead) AS changed, count_if(d.xhead IS NULL AND p.xhead IS NOT NULL) AS blanked,
 {s6('avg(sqrt((d.xhead-p.xhead)*(d.xhead-p.xhead) + (d.yhead-p.yhead)*(d.yhead-p.yhead)))')} AS displacement, least(min(d.xhead), min(p.xhead)) AS xlow, greatest(max(d.xhead), max(p.xhead)) AS xhigh
 FROM pose p JOIN done d ON d.trial_id = p.trial_id AND d.frame = p.frame GROUP BY p.trial_id""",
)
def compare_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = pose(spark, sf_dir)
    return cohort.compare_tracks(raw, correct.tracking_correction(raw)).withColumn("displacement", r6(F.col("displacement")))
