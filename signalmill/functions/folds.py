"""Choices among ordered rows whose next one depends on the last: which hits stay, when the gate opens.

Each choice names the row that comes next after it, found for all rows at once by binary search. The rows that are reached from the
first are then marked by doubling: after k rounds all within 2^k steps are known, so n rows take log n rounds of array work.
"""

from __future__ import annotations

import numpy as np


def orbit(start: int, following: np.ndarray) -> np.ndarray:
    """Marks of the rows reached from ``start`` by following, each of which leads on, or to len(following) as the end."""
    n = len(following)
    marks, jump = np.zeros(n + 1, bool), np.append(following, n)
    marks[min(start, n)] = marks[n] = True
    while True:
        reached = jump[np.flatnonzero(marks)]
        if marks[reached].all():
            return marks[:n]
        marks[reached] = True
        jump = jump[jump]


def first_at_least(t: np.ndarray, since: np.ndarray, gap: float, strictly: bool = False) -> np.ndarray:
    """For each time the first row of t, which never falls, with t - since >= gap (or > gap), by this very difference."""
    met = (lambda d: d > gap) if strictly else (lambda d: d >= gap)
    n = len(t)
    at = np.searchsorted(t, since + gap, "right" if strictly else "left")
    # the sum may be rounded to one side of the difference
    while (back := (at > 0) & met(t[np.maximum(at - 1, 0)] - since)).any():
        at = at - back
    while (on := (at < n) & ~met(t[np.minimum(at, n - 1)] - since)).any():
        at = at + on
    return at


def spaced(t: np.ndarray, gap: float, last: float = np.nan) -> np.ndarray:
    """Which hits of one key stay: the first, and each that is at least ``gap`` after the one kept before. last: the time of one kept earlier."""
    n = len(t)
    after = np.maximum(first_at_least(t, t, gap), np.arange(1, n + 1))
    start = 0 if np.isnan(last) else int(first_at_least(t, np.array([last]), gap)[0])
    return orbit(start, after) if start < n else np.zeros(n, bool)


REASONS = np.array(["start", "no bank", "stale", "eventful"], object)


def gate_reasons(t: np.ndarray, eventful: np.ndarray, last: float = np.nan, start_s: float = 3.0, stale_s: float = 8.0, level: float = 0.62) -> np.ndarray:
    """Why the gate opens at each row of one session, None where it stays shut: in its first seconds, while there is no bank answer yet, when
    the last one is stale, or when something happens (eventful, NaN for unknown). last: the time of an earlier opening."""
    n = len(t)
    always = (t < start_s) | (eventful >= level)
    next_always = np.minimum.accumulate(np.where(always, np.arange(n), n)[::-1])[::-1]
    after = np.append(next_always[1:], n)
    after = np.minimum(after, np.maximum(first_at_least(t, t, stale_s, strictly=True), np.arange(1, n + 1)))
    first = 0 if np.isnan(last) else int(first_at_least(t, np.array([last]), stale_s, strictly=True)[0])
    opens = orbit(min(first, int(next_always[0])), after)
    before = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
    before = np.concatenate(([-1], before[:-1]))
    since = np.where(before >= 0, t[before], last)
    why = np.select([t < start_s, np.isnan(since), t - since > stale_s], [0, 1, 2], 3)
    return np.where(opens, REASONS[why], None)


def over_keys(starts: list[int], choose, carried: float) -> np.ndarray:
    """What ``choose(rows, last)`` gives for each run of rows of one key; the first goes on from ``carried``."""
    return np.concatenate([choose(slice(i, j), carried if k == 0 else np.nan) for k, (i, j) in enumerate(zip(starts[:-1], starts[1:], strict=True))])


def run_starts(keys: list) -> list[int]:
    """Where runs of equal keys begin, with the end."""
    return [*(i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]), len(keys)]
