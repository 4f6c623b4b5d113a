"""Cubic splines along a trial, in chunks of frames that run in tasks of their own.

The slopes of a spline at its knots solve one tridiagonal system for a trial. Each chunk eliminates its own knots, which leaves the slopes at its first and last knot as linear
functions of the slopes just outside. One row a chunk goes through a scan of its trial, forward and back, that solves for these; with them
known, every chunk solves for the slopes inside and fills its gaps. Before all this one more scan tells each chunk the two knots before and after it. Trials of one
chunk have no part in the scans, as they are solved where they are filled; a table of only such trials is made and dealt once. Chunks, and trials in the scans, go through each step side by side (``batches``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Groups, arrays, doubles, headed, in_batches, lists, replaced, with_headers

#: Frames of a chunk.
CHUNK = 16_384
#: Rows of a batch; each has a knot for every column.
ROWS = 32_768
#: Frames of a partition in large tables of short trials, which is how such tables of frames are dealt when they are made.
PARTITION = 100_000
KEYS = ["trial_id", "_chunk"]


class Knots:
    """Knots of many splines' parts, one part for each column of each chunk (columns first), in the order of place: a part's own knots, up to two before it and up to two after it."""

    def __init__(self, frame: np.ndarray, values: np.ndarray, groups: Groups, near: np.ndarray):
        """``near``: (chunks, columns, 2, 2, 2) of side, nearest first, place and value; NaN where there is none."""
        chunks, width = near.shape[:2]
        row, column = np.nonzero(~np.isnan(values))
        part, t, y = [column * chunks + groups.each()[row]], [frame[row]], [values[row, column]]
        for side in near.transpose(2, 3, 1, 0, 4).reshape(4, chunks * width, 2):
            some = np.flatnonzero(~np.isnan(side[:, 0]))
            part.append(some)
            t.append(side[some, 0])
            y.append(side[some, 1])
        own = np.arange(sum(map(len, part))) < len(row)
        part, t, y = np.concatenate(part), np.concatenate(t), np.concatenate(y)
        order = np.lexsort((t, part))
        self.part, self.t, self.y, self.own = part[order], t[order], y[order], own[order]
        #: Whether the knot before, and the one after, is of the same part.
        same = self.part[1:] == self.part[:-1]
        self.follows, self.goes_on = np.append(False, same), np.append(same, False)

    def find(self, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The knot at or before each place, in its part; -1 if there is none or none after it."""
        low = min(self.t.min(initial=0), at.min(initial=0))
        span = max(self.t.max(initial=0), at.max(initial=0)) - low + 1
        place = lambda p, x: p * int(span) + (x - low).astype(int)
        k = np.searchsorted(place(self.part, self.t), place(part, at), side="right") - 1
        return np.where((k >= 0) & (self.part[k] == part) & self.goes_on[k], k, -1) if len(self.t) else np.full(len(at), -1)

    def eliminated(self) -> tuple[np.ndarray, np.ndarray]:
        """Own knots, and (own knots, 3): the slope of each as p + q * (slope before its part) + r * (slope after it).

        The first and last knot of a whole spline are ends of the kind not-a-knot. Parts whose spline has fewer than four knots give nothing of use.
        """
        i = np.flatnonzero(self.own)
        h, d = np.zeros((4, len(i))), np.zeros((4, len(i)))
        last = max(len(self.t) - 2, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(4):  # the two intervals before a knot and the two after it
                a = np.clip(i + k - 2, 0, last)
                b = np.minimum(a + 1, len(self.t) - 1)
                h[k] = self.t[b] - self.t[a]
                d[k] = (self.y[b] - self.y[a]) / h[k]
            (hb2, hb, ha, ha2), (db2, db, da, da2) = h, d
            begins, ends = ~self.follows[i], ~self.goes_on[i]
            low = np.where(begins, 0, np.where(ends, hb + hb2, ha))
            up = np.where(ends, 0, np.where(begins, ha + ha2, hb))
            mid = np.where(begins, ha2, np.where(ends, hb2, 2 * (ha + hb)))
            at_first = ((ha + 2 * (ha + ha2)) * ha2 * da + ha**2 * da2) / (ha + ha2)
            at_last = (hb**2 * db2 + (2 * (hb + hb2) + hb) * hb2 * db) / (hb + hb2)
            right = np.where(begins, at_first, np.where(ends, at_last, 3 * (ha * db + hb * da)))
            p, q, m, out = right.copy(), -low, mid.copy(), np.zeros((len(i), 3))
            groups = Groups(np.unique(self.part[i], return_counts=True)[1])
            for k, (_, at) in enumerate(groups.steps()):
                if k:
                    w = low[at] / m[at - 1]
                    m[at] -= w * up[at - 1]
                    p[at] -= w * p[at - 1]
                    q[at] = -w * q[at - 1]
            for k, (_, at) in enumerate(groups.steps(back=True)):
                after = out[at + 1] if k else np.array([0.0, 0.0, 1.0])  # the slope after the last own knot is itself
                out[at] = (np.stack([p[at], q[at], np.zeros(len(at))], axis=1) - up[at, None] * after) / m[at, None]
        return i, out


def fill_by_spline(frames: DataFrame, columns: list[str], max_segment: int, chunk: int = CHUNK) -> DataFrame:
    """Gaps of at most max_segment + 1 frames between known samples of each column, filled by the not-a-knot cubic spline through all known samples of the trial.

    A column with fewer than four known samples in a trial is filled by the polynomial through them.
    """
    kind, names, width = dict(frames.dtypes)["trial_id"], frames.columns, len(columns)
    rows = frames.withColumn("_chunk", F.floor(F.col("frame") / chunk).cast("long"))
    shape = f"trial_id {kind}, _chunk long"

    def frame_of(table: pa.Table) -> np.ndarray:
        return table["frame"].to_numpy().astype(float)

    def edges(table: pa.Table, groups: Groups) -> pa.Table:
        """Of every chunk and column: the number of knots, the first two and the last two, the outermost first."""
        frame, values, each = frame_of(table), doubles(table, columns), groups.each()
        out = np.full((len(groups), width, 9), np.nan)
        for j in range(width):
            held = np.flatnonzero(~np.isnan(values[:, j]))
            n = np.bincount(each[held], minlength=len(groups))
            end, out[:, j, 0] = np.cumsum(n), n
            for k, (at, least) in enumerate(((end - n, 1), (end - n + 1, 2), (end - 1, 1), (end - 2, 2))):
                some = n >= least
                place = held[at[some]]
                out[some, j, 1 + 2 * k], out[some, j, 2 + 2 * k] = frame[place], values[place, j]
        return table.select(KEYS).take(pa.array(groups.first)).append_column("_about", lists(out))

    def neighbours(table: pa.Table, groups: Groups) -> pa.Table:
        """Of every chunk and column: knots before it, in it and after it, and the two nearest on either side."""
        told = arrays(table["_about"], width * 9).reshape(-1, width, 9)
        n, ends = told[..., 0], told[..., 1:].reshape(-1, width, 2, 2, 2)
        near = np.full((len(told), width, 2, 2, 2), np.nan)
        for side in (0, 1):
            held = np.full((len(groups), width, 2, 2), np.nan)
            for trial, at in groups.steps(back=side == 1):
                near[at, :, side] = before = held[trial]
                own, count = ends[at, :, 1 - side], n[at][..., None, None]
                one = np.stack([own[:, :, 0], before[:, :, 0]], axis=2)
                held[trial] = np.where(count >= 2, own, np.where(count == 1, one, before))
        each, so_far = groups.each(), np.cumsum(n, axis=0)
        total = np.add.reduceat(n, groups.first, axis=0)
        before = so_far - n - (so_far - n)[groups.first][each]
        counts = np.stack([before, n, total[each] - before - n], axis=2)
        told = np.concatenate([x.reshape(len(told), -1) for x in (counts, near)], axis=1)
        return table.select(KEYS).append_column("_many", pa.array(groups.size[each] > 1)).append_column("_about", lists(told))

    def parts(told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, near = np.split(told[:, : width * 11], [width * 3], axis=1)
        return counts.reshape(-1, width, 3), near.reshape(-1, width, 2, 2, 2)

    def reduce(table: pa.Table, groups: Groups) -> pa.Table:
        told, own, groups = headed(table, groups, width * 11)
        counts, near = parts(told)
        knots = Knots(frame_of(own), doubles(own, columns), groups, near)
        at, ways = knots.eliminated()
        part, first = np.unique(knots.part[at], return_index=True)
        last = np.append(first[1:], len(at)) - 1
        out = np.zeros((width * len(groups), 2, 3))
        out[part] = np.stack([ways[first], ways[last]], axis=1)
        out = out.reshape(width, len(groups), 6).transpose(1, 0, 2)
        out[counts.sum(axis=2) < 4] = 0
        return own.select(KEYS).take(pa.array(groups.first)).append_column("_ways", lists(out))

    def solve(table: pa.Table, groups: Groups) -> pa.Table:
        """Slopes of the knots just before and just after every chunk."""
        told, ways = arrays(table["_about"], width * 11), np.zeros((table.num_rows, width, 2, 3))
        held = ~table["_ways"].is_null().to_numpy()
        ways[held] = arrays(table["_ways"].filter(pa.array(held)), width * 6).reshape(-1, width, 2, 3)
        some = parts(told)[0][..., 1] > 0
        # Forward: the first slope of each chunk, and the last one of the chunk before it, as functions of the slope after the chunk; then back.
        firsts, lasts, slopes = np.zeros((len(told), width, 2)), np.zeros((len(told), width, 2)), np.zeros((len(told), width, 2))
        state = np.zeros((len(groups), width, 2))
        for trial, at in groups.steps():
            (pa_, qa, ra), (pb, qb, rb) = ways[at].transpose(2, 3, 0, 1)
            a, b = lasts[at, :, 0], lasts[at, :, 1] = state[trial].transpose(2, 0, 1)
            one, more = (pa_ + qa * a) / (1 - qa * b), ra / (1 - qa * b)
            firsts[at] = np.stack([one, more], axis=2)
            state[trial] = np.where(some[at][..., None], np.stack([pb + qb * (a + b * one), qb * b * more + rb], axis=2), state[trial])
        # A chunk without a knot lies between the last slope before the next one that has some and the first slope in that one.
        state = np.zeros((len(groups), width, 2))
        for trial, at in groups.steps(back=True):
            following = state[trial, :, 1]
            first = firsts[at, :, 0] + firsts[at, :, 1] * following
            before = lasts[at, :, 0] + lasts[at, :, 1] * first
            slopes[at] = np.where(some[at][..., None], np.stack([before, following], axis=2), state[trial])
            state[trial] = np.where(some[at][..., None], np.stack([before, first], axis=2), state[trial])
        return table.select(KEYS).append_column("_about", lists(np.concatenate([told, slopes.reshape(len(told), -1)], axis=1)))

    def fill(table: pa.Table, groups: Groups) -> pa.Table:
        told, own, groups = headed(table, groups, width * 13)
        frame, values = frame_of(own), doubles(own, columns)
        alone = np.isnan(told[:, 0])
        told[alone, width * 11 :] = 0
        (counts, near), slopes = parts(told), told[:, width * 11 :].reshape(-1, width, 2).transpose(1, 0, 2).reshape(-1, 2)
        knots = Knots(frame, values, groups, near)
        counts = np.where(alone[:, None], np.bincount(knots.part, minlength=width * len(groups)).reshape(width, -1).T, counts.sum(axis=2))
        row, column = np.nonzero(np.isnan(values))
        part, at = column * len(groups) + groups.each()[row], frame[row]
        k = knots.find(part, at)
        short = k >= 0
        short[short] = knots.t[k[short] + 1] - knots.t[k[short]] <= max_segment + 2
        row, column, part, at, k = row[short], column[short], part[short], at[short], k[short]
        i, ways = knots.eliminated()
        # Of the knots outside only the nearest on either side has a slope that is used.
        before = knots.t < frame[groups.first][knots.part % len(groups)]
        s = np.where(before, slopes[knots.part, 0], slopes[knots.part, 1])
        s[i] = ways[:, 0] + ways[:, 1] * slopes[knots.part[i], 0] + ways[:, 2] * slopes[knots.part[i], 1]
        h, x = knots.t[k + 1] - knots.t[k], at - knots.t[k]
        d = (knots.y[k + 1] - knots.y[k]) / h
        new = knots.y[k] + x * (s[k] + x * ((3 * d - 2 * s[k] - s[k + 1]) / h + x * (s[k] + s[k + 1] - 2 * d) / h**2))
        # Around a gap in so few knots all of these are known: two at most lie on either side.
        scarce = (counts < 4).T.ravel()[part]
        for p in np.unique(part[scarce]):
            some, now = slice(*np.searchsorted(knots.part, [p, p + 1])), part == p
            t, y = knots.t[some], knots.y[some]
            new[now] = np.polyval(np.polyfit(t - t[0], y, len(t) - 1), at[now] - t[0])
        values[row, column] = new
        return replaced(own.select(names), columns, values)

    by_frame, by_chunk, array = [F.col("_about").isNull(), F.col("frame")], [F.col("_chunk")], "array<double>"
    count, last = frames.agg(F.count(F.lit(1)), F.max("frame")).first()
    if count == 0 or last < chunk:
        n = -(-count // PARTITION)
        return in_batches(frames.withColumn("_about", F.lit(None).cast(array)), ["trial_id"], by_frame, fill, frames.schema, ROWS, n if n > frames.sparkSession.sparkContext.defaultParallelism else None)
    long = frames.where(F.col("frame") >= chunk).select("trial_id").distinct()
    lean = rows.select(*dict.fromkeys([*KEYS, "frame", *columns])).join(long, "trial_id", "left_semi")
    found = in_batches(lean, KEYS, [F.col("frame")], edges, f"{shape}, _about {array}")
    near = in_batches(found, ["trial_id"], by_chunk, neighbours, f"{shape}, _many boolean, _about {array}")
    many = near.where("_many").drop("_many")
    going = with_headers(lean.join(many.select(*KEYS), KEYS, "left_semi"), many)
    ways = in_batches(going, KEYS, by_frame, reduce, f"{shape}, _ways {array}", ROWS)
    slopes = in_batches(near.drop("_many").join(ways, KEYS, "left"), ["trial_id"], by_chunk, solve, f"{shape}, _about {array}")
    return in_batches(with_headers(rows, slopes), KEYS, by_frame, fill, frames.schema, ROWS)
