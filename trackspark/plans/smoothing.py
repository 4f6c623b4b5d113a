"""Queries of the smoothing filters, with SQL over padded rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numerics
from ..operators import smoothing as sm
from ..schema import POSITIONS
from .fixture import SQL, pose
from .frames import r6, s6
from .registry import register

SHOWN = ["xhead", "yhead", "xtail", "ytail"]


def sql_padded(source: str, left: int, right: int, columns: list[str] = SHOWN) -> str:
    c = ", ".join(columns)
    counted = f"(SELECT trial_id, frame, {c}, count(*) OVER (PARTITION BY trial_id) AS n FROM {source})"
    return f"(SELECT trial_id, frame, n, {c} FROM {counted} UNION ALL SELECT trial_id, -1 - frame, n, {c} FROM {counted} WHERE frame < {left} UNION ALL SELECT trial_id, 2*n - 1 - frame, n, {c} FROM {counted} WHERE frame >= n - {right})"


def sql_windowed(source: str, how: str, win: int, columns: list[str] = SHOWN) -> str:
    """avg or median over a centred window of padded rows."""
    left, right = win // 2, win - 1 - win // 2
    over = f"OVER (PARTITION BY trial_id ORDER BY frame ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING)"
    return f"(SELECT trial_id, frame, {', '.join(columns)} FROM (SELECT trial_id, frame, n, {', '.join(f'{how}({c}) {over} AS {c}' for c in columns)} FROM {sql_padded(source, left, right, columns)}) WHERE frame >= 0 AND frame < n)"


def sql_gaussian(source: str, sigma: float = 3, columns: list[str] = SHOWN) -> str:
    """Sum of taps; a missing sample makes the sum missing."""
    taps = sm.gaussian_taps(sigma)
    r = len(taps) // 2
    values = ", ".join(f"({i - r}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(taps))
    sums = ", ".join(f"CASE WHEN count(q.{c}) = {len(taps)} THEN sum(t.w * q.{c}) END AS {c}" for c in columns)
    return f"(SELECT p.trial_id, p.frame, {sums} FROM {source} p CROSS JOIN (VALUES {values}) t(off, w) JOIN {sql_padded(source, r, r, columns)} q ON q.trial_id = p.trial_id AND q.frame = p.frame + t.off GROUP BY p.trial_id, p.frame)"


def sql_sgolay(source: str, window: int = 45, order: int = 4) -> str:
    h = sm.sgolay_taps(window, order)
    values = ", ".join(f"({p}, [{', '.join(repr(float(x)) for x in h[p])}]::DOUBLE[])" for p in range(window))
    sums = ", ".join(f"sum(t.w[q.frame - p.a + 1] * q.{c}) AS {c}" for c in SHOWN)
    placed = f"(SELECT trial_id, frame, greatest(0, least(frame - {window // 2}, count(*) OVER (PARTITION BY trial_id) - {window})) AS a FROM {source})"
    kernel = f"(SELECT p.*, t.w FROM {placed} p JOIN (VALUES {values}) t(place, w) ON t.place = p.frame - p.a)"
    return f"(SELECT p.trial_id, p.frame, {sums.replace('t.w', 'p.w')} FROM {kernel} p JOIN {source} q ON q.trial_id = p.trial_id AND q.frame BETWEEN p.a AND p.a + {window - 1} GROUP BY p.trial_id, p.frame)"


def _smooth(name: str, apply, sql: str | None) -> None:
    shown = ", ".join(f"{s6(c)} AS {c}" for c in SHOWN)

    def query(spark, sf_dir: str) -> DataFrame:
        return apply(pose(spark, sf_dir)).select("trial_id", "frame", *[r6(F.col(c)).alias(c) for c in SHOWN])

    register(name, sql and f"{SQL} SELECT trial_id, frame, {shown} FROM {sql}")(query)


_smooth("filter_gaussian", lambda f: sm.filter_gaussian(f, 2), sql_gaussian("pose", 2))
_smooth("filter_default", sm.filter_default, sql_gaussian("pose", 3))
_smooth("filter_gaussian_chunked", lambda f: sm.filter_gaussian(f, 3, chunk=256), sql_gaussian("pose", 3))
_smooth("filter_sgolay", sm.filter_sgolay, sql_sgolay("pose"))
_smooth("filter_mean", sm.filter_mean, sql_windowed("pose", "avg", 5))
_smooth("filter_median", sm.filter_median, sql_windowed("pose", "median", 5))
_smooth("filter_meanmed", sm.filter_meanmed, sql_windowed(sql_windowed("pose", "median", 15), "avg", 15))
_smooth("filter_med_gaussian", sm.filter_med_gaussian, f"{sql_gaussian('med', 3)}".replace("(SELECT p.trial_id", f"(WITH med AS (SELECT * FROM {sql_windowed('pose', 'median', 5)}) SELECT p.trial_id", 1))


def sql_butter(fps: float, cutoff: float, order: int = 5) -> str:
    """The recurrence as a recursive query over frames, all trials and columns side by side; a state of ``order`` numbers each."""
    b, a = numerics.butter_coefficients(order, cutoff, fps)
    n = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    out = lambda x: f"({n(b[0])} * {x} + r.s0)"
    step = ", ".join(f"{f'r.s{i + 1} + ' if i + 1 < order else ''}{n(b[i + 1])} * l.v - {n(a[i + 1])} * {out('l.v')} AS s{i}" for i in range(order))
    long = " UNION ALL ".join(f"SELECT trial_id, frame, '{c}' AS c, {c} AS v FROM pose" for c in SHOWN)
    zero = ", ".join(f"CAST(0 AS DOUBLE) AS s{i}" for i in range(order))
    shown = ", ".join(f"{s6(f'max(CASE WHEN c = {chr(39)}{c}{chr(39)} THEN y END)')} AS {c}" for c in SHOWN)
    head = SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{head}, l AS MATERIALIZED ({long}), r AS (SELECT DISTINCT trial_id, c, CAST(-1 AS BIGINT) AS frame, CAST(NULL AS DOUBLE) AS y, {zero} FROM l
 UNION ALL SELECT l.trial_id, l.c, l.frame, {out('l.v')} AS y, {step} FROM r JOIN l ON l.trial_id = r.trial_id AND l.c = r.c AND l.frame = r.frame + 1)
 SELECT trial_id, frame, {shown} FROM r WHERE frame >= 0 GROUP BY trial_id, frame"""


def kalman_gains(fps: float, derivatives: int, most: int = 400) -> list[list[float]]:
    """Gains of one axis, update by update, until they no longer change: they depend on no sample."""
    f, out = numerics.PointFilter(fps, derivatives), []
    while len(out) < most:
        f.predict()
        gain = f.p @ f.h.T @ np.linalg.inv(f.h @ f.p @ f.h.T + f.r)
        f.update(np.zeros(f.dim))
        out.append(gain[:: f.dim, 0].tolist())
    return out


def sql_kalman(fps: float = 30, derivatives: int = 2, carry: bool = True) -> str:
    """The filter as a recursive query over the known samples of each point's axis. With ``carry`` the gains go on from one keypoint to the next."""
    gains = kalman_gains(fps, derivatives)
    n = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    values = ", ".join(f"({i}, {', '.join(n(v) for v in g)})" for i, g in enumerate(gains))
    states = range(derivatives + 1)
    dt = [1 / fps**k / math.factorial(k) for k in states]
    ahead = {i: " + ".join(f"{n(dt[j - i])} * r.x{j}" for j in states if j >= i) for i in states}
    # Keypoints in the filter's order; those that are not shown count for the gains.
    pairs = list(zip(POSITIONS[0::2], POSITIONS[1::2]))
    long = " UNION ALL ".join(f"SELECT trial_id, frame, {k} AS p, {x} AS vx, {y} AS vy FROM pose WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for k, (x, y) in enumerate(pairs))
    order = "PARTITION BY trial_id ORDER BY p, frame" if carry else "PARTITION BY trial_id, p ORDER BY frame"
    shown = ", ".join(f"round(coalesce(max(CASE WHEN p = {k} AND a = '{c[0]}' THEN x0 END), max(o.{c})) + 1e-7, 3) + CAST(0 AS DOUBLE) AS {c}" for k, pair in enumerate(pairs) for c in pair if c in SHOWN)
    head = SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    first = ", ".join(("l.v + g.k0 * (l.v - l.v)" if i == 0 else "CAST(0 AS DOUBLE)") + f" AS x{i}" for i in states)
    step = ", ".join(f"{ahead[i]} + g.k{i} * (l.v - ({ahead[0]})) AS x{i}" for i in states)
    return f"""{head}, k AS MATERIALIZED (SELECT * FROM (VALUES {values}) t(j, {', '.join(f'k{i}' for i in states)})),
 known AS (SELECT *, row_number() OVER ({order}) - 1 AS j, row_number() OVER (PARTITION BY trial_id, p ORDER BY frame) - 1 AS i FROM ({long})),
 l AS MATERIALIZED (SELECT trial_id, frame, p, 'x' AS a, vx AS v, i, least(j, {len(gains) - 1}) AS j FROM known UNION ALL SELECT trial_id, frame, p, 'y', vy, i, least(j, {len(gains) - 1}) FROM known),
 r AS (SELECT l.trial_id, l.p, l.a, l.i, l.frame, {first} FROM l JOIN k g USING (j) WHERE l.i = 0
 UNION ALL SELECT l.trial_id, l.p, l.a, l.i, l.frame, {step} FROM r JOIN l ON l.trial_id = r.trial_id AND l.p = r.p AND l.a = r.a AND l.i = r.i + 1 JOIN k g ON g.j = l.j)
 SELECT o.trial_id, o.frame, {shown} FROM pose o LEFT JOIN r ON r.trial_id = o.trial_id AND r.frame = o.frame GROUP BY o.trial_id, o.frame"""


def _butter(name: str, chunk: int) -> None:
    @register(name, sql_butter(30, 5))
    def query(spark, sf_dir: str) -> DataFrame:
        return sm.filter_butter(pose(spark, sf_dir).select("trial_id", "frame", *POSITIONS), 30, 5, chunk=chunk).select("trial_id", "frame", *[r6(F.col(c)).alias(c) for c in SHOWN])


# A chunk that holds most trials whole, and one that cuts every trial into several.
_butter("filter_butter", sm.CHUNK)
_butter("filter_butter_chunked", 150)


def r3(c) -> Column:
    """Three decimals, as the recurrence gathers more rounding than one sum does; what lies halfway goes up on either side's rounding."""
    return F.round(c + F.lit(1e-7), 3) + F.lit(0.0)


def _kalman(name: str, chunk: int) -> None:
    @register(name, sql_kalman())
    def query(spark, sf_dir: str) -> DataFrame:
        return sm.filter_kalman(pose(spark, sf_dir).select("trial_id", "frame", *POSITIONS), 30, chunk=chunk).select("trial_id", "frame", *[r3(F.col(c)).alias(c) for c in SHOWN])


_kalman("filter_kalman", sm.CHUNK)
_kalman("filter_kalman_chunked", 150)
