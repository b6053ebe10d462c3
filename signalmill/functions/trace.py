"""The trace recurrence: smoothing, disagreement, bands, latching and fired edges, for the rows of many traces at once.

A trace is the series of one signal in one session. Its state is a handful of numbers, so a trace of any
length runs in bounded memory: rows come in order, in pieces, and the state is carried from piece to piece.

Nothing goes row by row. A smoothed value is an affine map of the one before, and such maps compose, so all rows of all traces are
smoothed by one segmented scan in log(rows) steps. Bands are runs of rows. The latch is walked from event to event: the next row that may fire,
then the next one that releases it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Specification of a trace, in the order of the columns of a spec row. polarity: 1 high, -1 low.
SPEC = ("fire", "release", "polarity", "tau", "dwell", "refractory", "min_slope", "slope_window", "warmup", "unreliable_at")
NAN = float("nan")
OUT = ("ema", "disagreement", "slope", "in_band_for", "warm", "unreliable", "fired", "latched", "fire_count")


def _no_samples() -> np.ndarray:
    return np.zeros((2, 0))


@dataclass
class TraceState:
    """What a trace remembers; NaN stands for nothing yet. recent: times and smoothed values of the slope's window."""

    ema: float = NAN
    disagreement: float = NAN
    latched: bool = False
    fire_count: int = 0
    last_fire: float = NAN
    band_since: float = NAN
    last_t: float = NAN
    first_t: float = NAN
    recent: np.ndarray = field(default_factory=_no_samples)


def scan(keep: np.ndarray, add: np.ndarray) -> np.ndarray:
    """x[i] = keep[i] * x[i - 1] + add[i]; a keep of 0 begins a new series."""
    keep, add, step = keep.copy(), add.copy(), 1
    while step < len(keep) and keep.any():
        add[step:] += keep[step:] * add[:-step]
        keep[step:] *= keep[:-step]
        keep[:step] = 0
        step *= 2
    return add


def slopes(t: np.ndarray, v: np.ndarray, window: float) -> np.ndarray:
    """At each sample the least-squares slope over those not older than the window; 0 for under three or no spread in time."""
    n, st, sv, stv, stt = (np.zeros(len(t)) for _ in range(5))
    for back in range(len(t)):
        dt, dv = t[: len(t) - back] - t[back:], v[: len(t) - back] - v[back:]
        inside = -dt <= window
        if not inside.any():
            break
        dt, dv, at = dt * inside, dv * inside, slice(back, None)
        n[at] += inside
        st[at] += dt
        sv[at] += dv
        stv[at] += dt * dv
        stt[at] += dt * dt
    spread = stt - st * st / np.maximum(n, 1)
    good = (n >= 3) & (spread > 1e-12)
    return np.where(good, (stv - st * sv / np.maximum(n, 1)) / np.where(good, spread, 1.0), 0.0)


def _next(mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each row the first from it on where the mask holds; the end of its trace if none does."""
    at = np.where(mask, np.arange(len(mask)), len(mask))
    return np.minimum(np.minimum.accumulate(at[::-1])[::-1], ends)


def measured(starts: np.ndarray, t: np.ndarray, value: np.ndarray, alt: np.ndarray, specs: np.ndarray, states: list[TraceState]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """What needs no latch: the outputs up to ``unreliable``, the rows that may fire and those that release. States are brought up to date so far."""
    heads, n = starts[:-1], len(t)
    of = np.repeat(np.arange(len(heads)), np.diff(starts))
    fire, release, polarity, tau, dwell, refractory, min_slope, window, warmup, unreliable_at = specs[of].T
    old = {c: np.array([getattr(s, c) for s in states], float) for c in ("ema", "disagreement", "band_since", "last_t", "first_t")}
    first = np.zeros(n, bool)
    first[heads] = True

    before = np.concatenate(([NAN], t[:-1]))
    before[heads] = old["last_t"]
    gap = np.where(np.isnan(before), 0.0, np.maximum(t - before, 0.0))
    ema = _smoothed(np.exp(-gap / tau), value, heads, of, old["ema"], np.ones(n, bool))
    # a last time of exactly 0 counts as none
    calm = np.where(before == 0.0, 0.0, gap)
    disagreement = _smoothed(np.exp(-calm / (3.0 * tau)), np.abs(value - alt), heads, of, old["disagreement"], ~np.isnan(alt))

    slope = np.full(n, NAN)
    for i in np.flatnonzero(~np.isnan(specs[:, 6])):
        rows = slice(starts[i], starts[i + 1])
        both = np.concatenate((states[i].recent, [t[rows], ema[rows]]), axis=1)
        slope[rows] = slopes(*both, specs[i, 7])[-(rows.stop - rows.start) :] * specs[i, 2]
        states[i].recent = both[:, both[0] >= both[0, -1] - specs[i, 7]]

    inside = polarity * ema >= polarity * fire
    enters = inside & (first | ~np.concatenate(([False], inside[:-1])))
    since = t[np.maximum.accumulate(np.where(enters, np.arange(n), 0))]
    # a band that the last piece left open
    open_ = ~np.isnan(old["band_since"]) & inside[heads]
    leaves = _next(~inside, np.repeat(starts[1:], np.diff(starts)))
    carried = (np.arange(n) < leaves[heads][of]) & open_[of]
    since = np.where(inside, np.where(carried, old["band_since"][of], since), NAN)
    began = np.where(np.isnan(old["first_t"]), t[heads], old["first_t"])
    out = {
        "ema": ema,
        "disagreement": disagreement,
        "slope": slope,
        "in_band_for": np.where(inside, t - since, 0.0),
        "warm": t - began[of] >= warmup,
        "unreliable": disagreement > unreliable_at,
    }
    may_fire = inside & (out["in_band_for"] >= dwell) & out["warm"] & (np.isnan(min_slope) | (slope >= min_slope))
    for i, (state, z) in enumerate(zip(states, starts[1:] - 1, strict=True)):
        state.ema, state.disagreement, state.band_since, state.last_t, state.first_t = (float(x) for x in (ema[z], disagreement[z], since[z], t[z], began[i]))
    return out, may_fire, polarity * ema <= polarity * release


def run(starts: np.ndarray, t: np.ndarray, value: np.ndarray, alt: np.ndarray, specs: np.ndarray, states: list[TraceState]) -> dict[str, np.ndarray]:
    """The outputs for rows of some traces: trace i has rows starts[i] to starts[i + 1], at least one, spec specs[i] and state states[i],
    which is brought up to date."""
    heads, sizes = starts[:-1], np.diff(starts)
    out, may_fire, released = measured(starts, t, value, alt, specs, states)
    fired, latched = _edges(starts, t, may_fire, released, out["unreliable"], np.repeat(specs[:, 5], sizes), states)
    upto = np.cumsum(fired)
    count = np.repeat(np.array([s.fire_count for s in states], np.int64) - (upto[heads] - fired[heads]), sizes) + upto
    for state, z in zip(states, starts[1:] - 1, strict=True):
        state.latched, state.fire_count = bool(latched[z]), int(count[z])
    return {**out, "fired": fired, "latched": latched, "fire_count": count}




def _smoothed(keep: np.ndarray, value: np.ndarray, heads: np.ndarray, of: np.ndarray, old: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Averages of the values that are there, from the old ones on; NaN before the first."""
    order = np.cumsum(there)
    at_head, known = (order[heads] - there[heads])[of], ~np.isnan(old)[of]
    initial = there & ~known & (order - at_head == 1)
    k = np.where(there, np.where(initial, 0.0, keep), 1.0)
    add = np.where(there, (1.0 - k) * np.where(there, value, 0.0), 0.0)
    add[heads] += k[heads] * np.where(np.isnan(old), 0.0, old)
    k[heads] = 0.0
    return np.where(known | (order > at_head), scan(k, add), NAN)


def _edges(starts, t, may_fire, released, unreliable, refractory, states) -> tuple[np.ndarray, np.ndarray]:
    """Rows that fire and rows after which the trace is latched. An unreliable edge latches without firing."""
    ends = np.repeat(starts[1:], np.diff(starts))
    to_fire, to_release = _next(may_fire, ends), _next(released, ends)
    fired, latched = np.zeros(len(t), bool), np.zeros(len(t), bool)
    for i, state in enumerate(states):
        at, end = int(starts[i]), int(starts[i + 1])
        while at < end:
            if not state.latched:
                at = int(to_fire[at])
                if at < end and t[at] - state.last_fire < refractory[at]:
                    # on to where the refractory time is over
                    over = t[at:end] - state.last_fire >= refractory[at]
                    at = at + int(over.argmax()) if over.any() else end
                    continue
                if at == end:
                    break
                if not unreliable[at]:
                    fired[at], state.last_fire = True, float(t[at])
            until = int(to_release[at])
            latched[at:until] = True
            state.latched = until == end
            at = until + 1
    return fired, latched
