"""Linear recurrences along a trial, in chunks of frames that run in tasks of their own.

A recurrence's state at a chunk's end is a matrix times the state at its start, plus what the chunk gives when it starts from zero. So every chunk but a trial's last first runs from zero;
one row a chunk then goes through a scan of its trial, which gives each chunk its starting state; and every chunk runs once more, from there.
Trials of one chunk skip the first two steps. Chunks go through each step side by side (``batches``), frame by frame.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import GainTable, butter_coefficients
from ..names import KEYPOINTS, POSITIONS
from .batches import Groups, arrays, doubles, headed, in_batches, lists, replaced, with_headers

#: Frames of a chunk.
CHUNK = 16_384
KEYS = ["trial_id", "_chunk"]
_STATE = "array<double>"


def scanned(frames: DataFrame, chunk: int, columns: list[str], facts: list[Column], about: list[Column], respond: Callable, follow: Callable, run: Callable, sizes: tuple[int, int]) -> DataFrame:
    """``frames`` after a recurrence of ``columns``.

    ``facts``: aggregates of a chunk's rows, to which ``before_`` and ``total_`` sums over the trial's earlier chunks and over all of them come for those whose name begins with n.
    ``about``: numbers made of these that every function is given, (chunks, numbers). ``sizes``: how many numbers a state and a response have.
    ``respond(values, groups, about)``: what a chunk from zero tells, (chunks, numbers). ``follow(start, response, about)``: (start as the chunk sees it, state at its end); the response is NaN in a trial's last chunk.
    ``run(values, groups, start, about)``: the new values.
    """
    kind, names, (n_state, n_response), n_about = dict(frames.dtypes)["trial_id"], frames.columns, sizes, len(about)
    rows = frames.withColumn("_chunk", F.floor(F.col("frame") / chunk).cast("long"))
    whole, earlier = Window.partitionBy("trial_id"), Window.partitionBy("trial_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    known = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"), *facts)
    sums = [c for c in known.columns if c.startswith("n")]
    known = known.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums} | {f"total_{c}": F.sum(c).over(whole) for c in sums})
    known = known.select(*KEYS, (F.col("_chunk") < F.max("_chunk").over(whole)).alias("_open"), F.array(*[c.cast("double") for c in about]).alias("_about"))

    def ends(table: pa.Table, groups: Groups) -> pa.Table:
        told, own, groups = headed(table, groups, n_about)
        return own.select(KEYS).take(pa.array(groups.first)).append_column("_response", lists(respond(doubles(own, columns), groups, told)))

    first = [F.col("_about").isNull(), F.col("frame")]
    open_ = known.where("_open").drop("_open")
    going = with_headers(rows.select(*dict.fromkeys([*KEYS, "frame", *columns])).join(open_.select(*KEYS), KEYS, "left_semi"), open_)
    responses = in_batches(going, KEYS, first, ends, f"trial_id {kind}, _chunk long, _response {_STATE}")

    def scan(table: pa.Table, groups: Groups) -> pa.Table:
        told, state, starts = arrays(table["_about"], n_about), np.zeros((len(groups), n_state)), np.zeros((table.num_rows, n_state))
        given = np.full((table.num_rows, n_response), np.nan)
        held = ~table["_response"].is_null().to_numpy()
        given[held] = arrays(table["_response"].filter(pa.array(held)), n_response)
        for own, at in groups.steps():
            starts[at], state[own] = follow(state[own], given[at], told[at])
        return table.select(KEYS).append_column("_about", lists(np.concatenate([starts, told], axis=1)))

    starts = in_batches(known.drop("_open").join(responses, KEYS, "left"), ["trial_id"], [F.col("_chunk")], scan, f"trial_id {kind}, _chunk long, _about {_STATE}")

    def finish(table: pa.Table, groups: Groups) -> pa.Table:
        told, own, groups = headed(table, groups, n_state + n_about)
        return replaced(own.select(names), columns, run(doubles(own, columns), groups, told[:, :n_state], told[:, n_state:]))

    return in_batches(with_headers(rows, starts), KEYS, first, finish, frames.schema)


def butterworth(frames: DataFrame, columns: list[str], fps: float, cutoff: float, order: int, chunk: int = CHUNK) -> DataFrame:
    b, a = butter_coefficients(order, cutoff, fps)
    width = len(columns)
    step = np.zeros((order, order))
    step[:, 0], step[np.arange(order - 1), np.arange(1, order)] = -a[1:], 1.0

    def along(values: np.ndarray, groups: Groups, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filter in transposed direct form through all chunks side by side, and the states at their ends."""
        out, state = np.empty_like(values), start.reshape(-1, order, width).transpose(1, 0, 2).copy()
        for own, at in groups.steps():
            x, s = values[at], state[:, own]
            y = b[0] * x + s[0]
            s[:-1] = s[1:] + b[1:-1, None, None] * x - a[1:-1, None, None] * y
            s[-1] = b[-1] * x - a[-1] * y
            out[at], state[:, own] = y, s
        return out, state.transpose(1, 0, 2).reshape(len(groups), -1)

    def respond(values: np.ndarray, groups: Groups, told: np.ndarray) -> np.ndarray:
        return along(values, groups, np.zeros((len(groups), order * width)))[1]

    def follow(start: np.ndarray, response: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths, which = np.unique(told[:, 0].astype(int), return_inverse=True)
        powers = np.stack([np.linalg.matrix_power(step, n) for n in lengths])[which]
        return start, (powers @ start.reshape(-1, order, width)).reshape(start.shape) + response

    def run(values: np.ndarray, groups: Groups, start: np.ndarray, told: np.ndarray) -> np.ndarray:
        return along(values, groups, start)[0]

    return scanned(frames, chunk, columns, [], [F.col("n_rows")], respond, follow, run, (order * width, order * width))


def kalman(frames: DataFrame, fps: float, derivatives: int, reset_covariance: bool, chunk: int = CHUNK) -> DataFrame:
    """The gains depend on the number of updates alone, not on the data, so a filter is a linear recurrence whose matrices are known beforehand."""
    points, states = len(KEYPOINTS), derivatives + 1
    table = GainTable(fps, derivatives)
    facts, about = [], []
    for i, p in enumerate(KEYPOINTS):
        both = F.col(f"x{p}").isNotNull() & F.col(f"y{p}").isNotNull() & ~F.isnan(f"x{p}") & ~F.isnan(f"y{p}")
        facts += [F.count_if(both).alias(f"n_{p}"), *[F.min_by(F.when(both, F.col(f"{a}{p}")), F.when(both, F.col("frame"))).alias(f"first_{a}{p}") for a in "xy"]]
        # Updates that the keypoint's filter had before the chunk, its updates in it, and where it begins if it does so here.
        ahead = sum((F.col(f"total_n_{q}") for q in KEYPOINTS[:i]), F.lit(0)) if not reset_covariance else F.lit(0)
        begins = (F.col(f"before_n_{p}") == 0) & (F.col(f"n_{p}") > 0)
        about += [F.col(f"before_n_{p}") + ahead, F.col(f"n_{p}"), *[F.when(begins, F.col(f"first_{a}{p}")) for a in "xy"]]

    def along(values: np.ndarray, groups: Groups, state: np.ndarray, before: np.ndarray, zeros: int = 0) -> np.ndarray:
        """Filters the points of all chunks side by side, in place. ``state``: (states, chunks, points, 2 + zeros), of which the last filter zeros; it is led to the chunks' ends."""
        seen = values.reshape(-1, points, 2)
        held = ~np.isnan(seen).any(axis=2)
        ahead = np.cumsum(held, axis=0) - held
        ahead += (before - ahead[groups.first])[groups.each()].astype(int)
        table.upto(int(ahead.max(initial=0)) + 1)
        gains = np.array(table.gains).T
        for own, at in groups.steps():
            old = state[:, own]
            new = (table.filter.f @ old.reshape(states, -1)).reshape(old.shape)
            z = np.zeros(old.shape[1:])
            z[..., :2] = seen[at]
            new += gains[:, np.minimum(ahead[at], gains.shape[1] - 1)][..., None] * (z - new[0])
            now = held[at][..., None]
            state[:, own] = np.where(now, new, old)
            seen[at] = np.where(now, new[0, ..., :2], seen[at])
        return state

    def respond(values: np.ndarray, groups: Groups, told: np.ndarray) -> np.ndarray:
        """The state at the end from zero, and where each number of a state at the start leads when all samples are zero."""
        state = np.zeros((states, len(groups), points, 2 + states))
        state[np.arange(states), :, :, 2 + np.arange(states)] = 1
        return along(values.copy(), groups, state, told.reshape(-1, points, 4)[..., 0], states).transpose(1, 2, 0, 3).reshape(len(groups), -1)

    def follow(start: np.ndarray, response: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, told = start.reshape(-1, points, states, 2).copy(), told.reshape(-1, points, 4)
        own[:, :, 0] = np.where(np.isnan(told[..., 2:]), own[:, :, 0], told[..., 2:])
        way = response.reshape(-1, points, states, 2 + states)
        return own.reshape(start.shape), (way[..., 2:] @ own + way[..., :2]).reshape(start.shape)

    def run(values: np.ndarray, groups: Groups, start: np.ndarray, told: np.ndarray) -> np.ndarray:
        out = values.copy()
        along(out, groups, start.reshape(-1, points, states, 2).transpose(2, 0, 1, 3).copy(), told.reshape(-1, points, 4)[..., 0])
        return out

    size = points * states
    return scanned(frames, chunk, POSITIONS, facts, about, respond, follow, run, (size * 2, size * (2 + states)))
