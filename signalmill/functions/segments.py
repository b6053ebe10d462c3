"""What a chunk of a trace does to the state that comes into it, without knowing that state: pieces of a scan over chunks.

Three summaries, each found when the ones before are known at the chunk's start: of smoothed values (affine maps, which compose), of the band
and the slope's window, and of the latch. The latch's summary holds, for each row from which a fire may begin, where the chain of fires
and releases that begins there ends; which row that is depends on the incoming state alone.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np

from .trace import TraceState, _next, measured, scan


@dataclass
class Smoothing:
    """The first row (t, value, alt) and what the rows after it do: ema -> keep * ema + add, disagreement likewise by calm_keep and calm_add;
    alone is the disagreement after them if there was none before (NaN: none still)."""

    t: float
    value: float
    alt: float
    last_t: float
    keep: float = 1.0
    add: float = 0.0
    calm_keep: float = 1.0
    calm_add: float = 0.0
    alone: float = math.nan

    def then(self, other: Smoothing, tau: float) -> Smoothing:
        """Both chunks as one."""
        keep, calm = _gap(self.last_t, other.t, tau)
        ema = keep * other.keep, other.keep * (1 - keep) * other.value + other.add
        if math.isnan(other.alt):
            calm_map, alone = (other.calm_keep, other.calm_add), other.alone
        else:
            apart = abs(other.value - other.alt)
            calm_map = calm * other.calm_keep, other.calm_keep * (1 - calm) * apart + other.calm_add
            alone = other.calm_keep * apart + other.calm_add
        joined = alone if math.isnan(self.alone) else calm_map[0] * self.alone + calm_map[1]
        return Smoothing(self.t, self.value, self.alt, other.last_t, self.keep * ema[0], ema[0] * self.add + ema[1], self.calm_keep * calm_map[0], calm_map[0] * self.calm_add + calm_map[1], joined)

    def after(self, state: TraceState, tau: float) -> dict:
        """The smoothed values and times after the chunk."""
        keep, calm = _gap(state.last_t, self.t, tau)
        ema = self.value if math.isnan(state.ema) else keep * state.ema + (1 - keep) * self.value
        dis = state.disagreement
        if not math.isnan(self.alt):
            apart = abs(self.value - self.alt)
            dis = apart if math.isnan(dis) else calm * dis + (1 - calm) * apart
        dis = self.alone if math.isnan(dis) else self.calm_keep * dis + self.calm_add
        first = self.t if math.isnan(state.first_t) else state.first_t
        return {"ema": self.keep * ema + self.add, "disagreement": dis, "last_t": self.last_t, "first_t": first}


def _gap(before: float, t: float, tau: float) -> tuple[float, float]:
    """What the time between two rows leaves of ema and of disagreement; a time before of exactly 0 counts as none for the latter."""
    gap = 0.0 if math.isnan(before) else max(t - before, 0.0)
    return math.exp(-gap / tau), math.exp(-(0.0 if before == 0.0 else gap) / (3.0 * tau))


def smoothing(t: np.ndarray, value: np.ndarray, alt: np.ndarray, tau: float) -> Smoothing:
    """The summary of rows in order, at least one."""
    gap = np.maximum(np.diff(t, prepend=t[0]), 0.0)
    before = np.concatenate(([math.nan], t[:-1]))
    keep = np.exp(-gap / tau)
    add = (1 - keep) * value
    there = ~np.isnan(alt)
    there[0] = False
    calm = np.where(there, np.exp(-np.where(before == 0.0, 0.0, gap) / (3.0 * tau)), 1.0)
    apart = np.where(there, np.abs(value - np.where(there, alt, 0.0)), 0.0)
    first = int(there.argmax())
    alone_keep = np.where(np.arange(len(t)) == first, 0.0, calm)
    keep_all, calm_all = float(np.prod(keep)), float(np.prod(calm))
    keep[0] = add[0] = 0.0
    calm_add = (1 - calm) * apart
    start = calm.copy()
    start[0] = 0.0
    alone = scan(alone_keep, (1 - alone_keep) * apart)[-1] if there.any() else math.nan
    return Smoothing(float(t[0]), float(value[0]), float(alt[0]), float(t[-1]), keep_all, float(scan(keep, add)[-1]), calm_all, float(scan(start, calm_add)[-1]), float(alone))


@dataclass
class Band:
    """since: when the band was entered that is open at the end (NaN: none), all: whether every row is inside, and the slope's window at the end."""

    since: float
    all: bool
    recent: list

    def after(self, state: TraceState, window: float) -> dict:
        since = state.band_since if self.all and not math.isnan(state.band_since) else self.since
        t, ema = np.concatenate((np.asarray(state.recent, float).reshape(2, -1), np.asarray(self.recent, float).reshape(2, -1)), axis=1)
        left = t >= t[-1] - window if len(t) else np.zeros(0, bool)
        return {"band_since": since, "recent": [t[left].tolist(), ema[left].tolist()]}


@dataclass
class Latch:
    """Chains of fires and releases by the row they begin at, in pieces of rows whose chains end alike: until (time of the piece's last row), and at
    the end latched, last (time of the last fire; NaN: none) and count. released: the first piece after the first release; None if the chunk
    has no release."""

    until: list
    latched: list
    last: list
    count: list
    released: int | None

    def after(self, state: TraceState, refractory: float) -> dict:
        at = 0
        if state.latched:
            if self.released is None:
                return {"latched": True, "last_fire": state.last_fire, "fire_count": state.fire_count}
            at = self.released
        while at < len(self.until) and self.until[at] - state.last_fire < refractory:
            at += 1
        if at == len(self.until):
            return {"latched": False, "last_fire": state.last_fire, "fire_count": state.fire_count}
        last = state.last_fire if math.isnan(self.last[at]) else self.last[at]
        return {"latched": self.latched[at], "last_fire": last, "fire_count": state.fire_count + self.count[at]}


def latch(t: np.ndarray, may_fire: np.ndarray, released: np.ndarray, unreliable: np.ndarray, refractory: float) -> Latch:
    """The summary of all rows of a chunk, with times that never fall."""
    n = len(t)
    ends = np.full(n, n)
    to_fire, to_release = np.append(_next(may_fire, ends), n), _next(released, ends)
    rows = np.flatnonzero(may_fire)
    out = to_release[rows]
    # the next row that may fire, after the release and, behind a fire, when the refractory time is over
    cooled = np.searchsorted(t, t[rows] + refractory)
    cooled = np.where((cooled > 0) & (t[np.maximum(cooled - 1, 0)] - t[rows] >= refractory), cooled - 1, cooled)
    cooled = np.where((cooled < n) & (t[np.minimum(cooled, n - 1)] - t[rows] < refractory), cooled + 1, cooled)
    fires = ~unreliable[rows]
    free = np.minimum(np.maximum(out + 1, np.where(fires, cooled, 0)), n)
    following = np.where(out < n, to_fire[free], n)
    # chains end at a node of their own; each step joins a chain with the one that goes on from its end
    place = np.searchsorted(rows, following)
    m = len(rows)
    link = np.append(place, m)
    count, last = np.append(fires.astype(np.int64), 0), np.append(np.where(fires, t[rows], math.nan), math.nan)
    end = np.append(np.arange(m), m)
    while (link[:m] < m).any():
        on = link < m
        count = count + count[link]
        last = np.where(np.isnan(last[link]), last, last[link])
        end = np.where(on, end[link], end)
        link = link[link]
    latched = (out == n)[end[:m]]
    same = np.zeros(m, bool)
    if m:
        a, b = last[: m - 1], last[1:m]
        same[:-1] = (latched[1:] == latched[:-1]) & (count[1:m] == count[: m - 1]) & ((a == b) | (np.isnan(a) & np.isnan(b)))
    keep = np.flatnonzero(~same)
    first = int(to_release[0]) if n else 0
    released_at = None if first == n else int(np.searchsorted(keep, np.searchsorted(rows, first + 1)))
    return Latch(t[rows[keep]].tolist(), latched[keep].tolist(), last[:m][keep].tolist(), count[:m][keep].tolist(), released_at)


def state_of(values: dict) -> TraceState:
    """A state from its values, of which some may be missing."""
    state = TraceState(**{k: v for k, v in values.items() if k != "recent"})
    if "recent" in values:
        state.recent = np.asarray(values["recent"], float).reshape(2, -1)
    return state


def values_of(state: TraceState) -> dict:
    return {**asdict(state), "recent": state.recent.tolist()}


def inside_of(specs: np.ndarray, ema: np.ndarray) -> np.ndarray:
    """Which smoothed values lie in the band."""
    return specs[2] * ema >= specs[2] * specs[0]


__all__ = ["Band", "Latch", "Smoothing", "inside_of", "latch", "measured", "smoothing", "state_of", "values_of"]
