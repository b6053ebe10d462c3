"""Isotonic fits of weighted points, as the slopes of a greatest convex minorant.

With points in order of raw, let W be the cumulated weights and S the cumulated positives. The best rising step function is
the slope of the largest convex function under (W, S); its corners are where blocks of equal value end.
"""

from __future__ import annotations

import numpy as np


def corners(weight: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """How many points lie before each corner of the greatest convex minorant of (W, S), from 0 to all."""
    x, y = (np.concatenate(([0.0], np.cumsum(v, dtype=float))) for v in (weight, positive))
    found, at, last = [0], 0, len(x) - 1
    while at < last:
        slopes = (y[at + 1 :] - y[at]) / (x[at + 1 :] - x[at])
        # the nearest point on the lowest line: blocks of equal value stay apart
        at += 1 + int(np.flatnonzero(slopes <= slopes.min() + 1e-12)[0])
        found.append(at)
    return np.array(found)


def cuts_of_weight(ends: np.ndarray, least: float) -> np.ndarray:
    """From the cumulated weights at block ends (the first is 0), the places of those that stay when each block must have the least weight."""
    kept = [0]
    while True:
        beyond = int(np.searchsorted(ends, ends[kept[-1]] + least))
        if beyond >= len(ends):
            break
        kept.append(beyond)
    # what is left over goes to the last block
    return np.array([*(kept[:-1] if len(kept) > 1 else kept), len(ends) - 1])


def fit(raw: np.ndarray, weight: np.ndarray, positive: np.ndarray, least: int | None = None, most_points: int = 24) -> tuple[list[float], list[float]]:
    """The curve (xs, ys) through points of different raw, rising; ends at 0 and 1. Nothing to fit: the identity."""
    if not len(raw):
        return [0.0, 1.0], [0.0, 1.0]
    weight, positive = np.asarray(weight, float), np.asarray(positive, float)
    totals = np.stack([np.concatenate(([0.0], np.cumsum(v))) for v in (weight, positive)])
    least = max(40, int(totals[0, -1]) // 25) if least is None else least
    edges = corners(weight, positive)
    if least > 1 and len(edges) > 2:
        edges = edges[cuts_of_weight(totals[0, edges], least)]
        # larger blocks may fall again
        w, s = np.diff(totals[:, edges], axis=1)
        edges = edges[corners(w, s)]
    w, s = np.diff(totals[:, edges], axis=1)
    xs, ys = np.asarray(raw, float)[edges[1:] - 1], s / w
    if len(xs) > most_points:
        # evenly spread, both ends among them
        thin = np.unique(np.rint(np.linspace(0, len(xs) - 1, most_points)).astype(int))
        xs, ys = xs[thin], ys[thin]
    # level up to 0 and to 1
    ends = (int(xs[0] > 0), int(xs[-1] < 1))
    return np.pad(xs, ends, constant_values=(0.0, 1.0)).tolist(), np.pad(ys, ends, mode="edge").tolist()
