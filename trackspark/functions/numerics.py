"""Numerics of grouped-map and stateful functions, in numpy. They run in Python workers and need no session."""

from __future__ import annotations

import math

import numpy as np

from ..names import KEYPOINTS


def butter_coefficients(order: int, cutoff: float, fps: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a low-pass Butterworth filter by the bilinear transform."""
    if not 0 < cutoff < fps / 2:
        raise ValueError("the cutoff must lie between 0 and half the frame rate")
    warped = 4 * math.tan(math.pi * cutoff / fps)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    z = (4 + poles) / (4 - poles)
    a = np.real(np.poly(z))
    b = np.poly(-np.ones(order))
    return b * a.sum() / b.sum(), a


def recursive_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(result, state at the end) of a causal filter in transposed direct form; x is (frames, columns), the state (order, columns), by default zero."""
    state, out = np.zeros((len(a) - 1, x.shape[1])) if state is None else state.copy(), np.empty_like(x)
    for i, row in enumerate(x):
        out[i] = b[0] * row + state[0]
        state[:-1] = state[1:] + b[1:-1, None] * row - a[1:-1, None] * out[i]
        state[-1] = b[-1] * row - a[-1] * out[i]
    return out, state


class PointFilter:
    """Constant-derivative Kalman filter of one point in the plane."""

    def __init__(self, fps: float, derivatives: int = 2, noise: float = 1000.0, dim: int = 2):
        size = dim * (derivatives + 1)
        self.dim, dt = dim, 1 / fps
        self.f = np.eye(size)
        for k in range(1, derivatives + 1):
            at = np.arange(size - k * dim)
            self.f[at, at + k * dim] = dt**k / math.factorial(k)
        self.h = np.eye(dim, size)
        self.q, self.r, self.p = noise * np.eye(size), noise * np.eye(dim), noise * np.eye(size)
        self.x = np.zeros(size)

    def begin(self, z: np.ndarray) -> None:
        self.x[:] = 0
        self.x[: self.dim] = z

    def predict(self) -> None:
        self.x = self.f @ self.x
        self.p = self.f @ self.p @ self.f.T + self.q

    def update(self, z: np.ndarray) -> np.ndarray:
        gain = self.p @ self.h.T @ np.linalg.inv(self.h @ self.p @ self.h.T + self.r)
        self.x = self.x + gain @ (z - self.h @ self.x)
        self.p = (np.eye(len(self.x)) - gain @ self.h) @ self.p
        return self.x[: self.dim]


def kalman_trial(points: np.ndarray, fps: float, derivatives: int = 2, reset_covariance: bool = False) -> np.ndarray:
    """Filtered (frames, 8) positions. Each keypoint begins at its first frame with both coordinates; frames with a missing one are skipped.

    The covariance goes on from one keypoint to the next unless ``reset_covariance``.
    """
    out, f = points.copy(), PointFilter(fps, derivatives)
    for k in range(len(KEYPOINTS)):
        own = points[:, 2 * k : 2 * k + 2]
        if reset_covariance:
            f = PointFilter(fps, derivatives)
        rows = np.flatnonzero(~np.isnan(own).any(axis=1))
        for j, i in enumerate(rows):
            if j == 0:
                f.begin(own[i])
            f.predict()
            out[i, 2 * k : 2 * k + 2] = f.update(own[i])
    return out


class GainTable:
    """Gains of the filter of one coordinate, by the number of updates before; they settle, and are then the same for all that follow."""

    def __init__(self, fps: float, derivatives: int = 2):
        self.filter = PointFilter(fps, derivatives, dim=1)
        self.gains: list[np.ndarray] = []
        self.steady = False

    def upto(self, n: int) -> None:
        while len(self.gains) < n and not self.steady:
            f, before = self.filter, self.filter.p
            f.predict()
            self.gains.append((f.p @ f.h.T / (f.h @ f.p @ f.h.T + f.r)).ravel())
            f.update(np.zeros(1))
            self.steady = bool(np.abs(f.p - before).max() <= 1e-15 * np.abs(f.p).max())

    def some(self, first: int, count: int) -> np.ndarray:
        """(count, states): gains of the updates after the first so many."""
        self.upto(first + count)
        return np.array(self.gains)[np.minimum(np.arange(first, first + count), len(self.gains) - 1)]

    def _step(self, gain: np.ndarray) -> np.ndarray:
        size = len(gain)
        return (np.eye(size) - np.outer(gain, np.eye(size)[0])) @ self.filter.f

    def transition(self, first: int, count: int) -> np.ndarray:
        """The matrix by which the state goes through so many updates of zeros."""
        self.upto(first + count)
        early = max(0, min(count, len(self.gains) - first))
        out = np.eye(len(self.filter.f))
        for gain in self.gains[first : first + early]:
            out = self._step(gain) @ out
        return np.linalg.matrix_power(self._step(self.gains[-1]), count - early) @ out if count > early else out


def kalman_run(z: np.ndarray, table: GainTable, first: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filtered, state at the end) of points (frames, 2) without gaps, from a state (states, 2) that ``first`` updates led to."""
    out, state, f = np.empty_like(z), state.copy(), table.filter.f
    for i, gain in enumerate(table.some(first, len(z))[:, :, None] if len(z) else ()):
        state = f @ state
        state += gain * (z[i] - state[0])
        out[i] = state[0]
    return out, state


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (x, y) with not-a-knot ends; fewer than four points give the polynomial through them."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0]) if n else np.full(len(at), np.nan)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    # Slopes s solve a tridiagonal system but for its first and last rows; eliminate forward, then back.
    low, mid, up, rhs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    low[1:-1], up[1:-1] = h[1:], h[:-1]
    mid[1:-1] = 2 * (h[1:] + h[:-1])
    rhs[1:-1] = 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    mid[0], up[0] = h[1], h[0] + h[1]
    rhs[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
    mid[-1], low[-1] = h[-2], h[-1] + h[-2]
    rhs[-1] = (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2])
    for i in range(1, n):
        w = low[i] / mid[i - 1]
        mid[i] -= w * up[i - 1]
        rhs[i] -= w * rhs[i - 1]
    s = np.zeros(n)
    s[-1] = rhs[-1] / mid[-1]
    for i in range(n - 2, -1, -1):
        s[i] = (rhs[i] - up[i] * s[i + 1]) / mid[i]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t, hk = at - x[k], h[k]
    c = (3 * d[k] - 2 * s[k] - s[k + 1]) / hk
    e = (s[k] + s[k + 1] - 2 * d[k]) / hk**2
    return y[k] + t * (s[k] + t * (c + t * e))


def one_sided_fft(x: np.ndarray, fps: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and amplitudes; the sample distance is (n / fps) / (n - 1)."""
    n = len(x)
    x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
    return np.fft.fftfreq(n, n / fps / (n - 1))[: n // 2], np.abs(np.fft.fft(x))[: n // 2]


def welch(x: np.ndarray, fps: float, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Power density by half-overlapping, mean-free Hann segments."""
    size = min(size, len(x))
    step = size - size // 2
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
    parts = np.array([x[a : a + size] for a in range(0, len(x) - size + 1, step)])
    parts = (parts - parts.mean(axis=1, keepdims=True)) * w
    p = np.abs(np.fft.rfft(parts, axis=1)) ** 2 / (fps * (w * w).sum())
    p[:, 1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / fps), p.mean(axis=0)
