"""Trailing windows over the samples of one trace or session, in order of time; times in whole microseconds, so that edges are exact."""

from __future__ import annotations

import numpy as np


def whole_micros(t: np.ndarray) -> np.ndarray:
    return np.rint(t * 1_000_000).astype(np.int64)


def trailing_slope(us: np.ndarray, v: np.ndarray, window_us: int) -> np.ndarray:
    """Least-squares slope a second over the trailing window at each sample; 0 for under three samples or no spread in time."""
    n, st, sv, stv, stt = (np.zeros(len(us)) for _ in range(5))
    for back in range(len(us)):
        apart = us[: len(us) - back] - us[back:]
        inside = -apart <= window_us
        if not inside.any():
            break
        dt, dv, at = apart / 1e6 * inside, (v[: len(v) - back] - v[back:]) * inside, slice(back, None)
        n[at] += inside
        st[at] += dt
        sv[at] += dv
        stv[at] += dt * dv
        stt[at] += dt * dt
    spread = stt - st * st / np.maximum(n, 1)
    good = (n >= 3) & (spread > 1e-12)
    return np.where(good, (stv - st * sv / np.maximum(n, 1)) / np.where(good, spread, 1.0), 0.0)


def trailing_average(t: np.ndarray, us: np.ndarray, v: np.ndarray, window_us: int) -> np.ndarray:
    """Time average over the trailing window by trapezoids that lie in it whole; 0 for under two samples."""
    dt = np.maximum(np.diff(t, prepend=t[:1]), 0.0)
    area, span = np.cumsum(dt * (v + np.concatenate((v[:1], v[:-1]))) / 2), np.cumsum(dt)
    low = np.searchsorted(us, us - window_us)
    wide = span - span[low]
    return np.where(wide > 1e-9, (area - area[low]) / np.where(wide > 1e-9, wide, 1.0), 0.0)


def trailing_sums(t: np.ndarray, values: np.ndarray, window_us: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each row the sum of values and the count of rows in the trailing window, and the time of its oldest row. Rows of the same time count
    for each other. starts: where the rows of each session begin, with the end; windows end at their session."""
    us, starts = whole_micros(t), np.array([0, len(t)]) if starts is None else np.asarray(starts)
    heads, sizes = starts[:-1], np.diff(starts)
    if len(heads) > 1:
        # one session after the other on one axis, further apart than a window reaches
        spans = us[starts[1:] - 1] - us[heads] + window_us + 1
        us = us - np.repeat(us[heads] - np.concatenate(([0], np.cumsum(spans)[:-1])), sizes)
    low, high = np.searchsorted(us, us - window_us), np.searchsorted(us, us, "right")
    # sums of each session by itself, so that none is rounded by another's
    upto, before = np.zeros(len(t)), np.zeros(len(t))
    for i, j in zip(heads.tolist(), starts[1:].tolist(), strict=True):
        np.cumsum(values[i:j], out=upto[i:j])
        before[i + 1 : j] = upto[i : j - 1]
    return upto[high - 1] - before[low], high - low, t[low]
