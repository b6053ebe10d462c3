"""The scan over chunks against the recurrence over whole traces, and its summaries against running through."""

import math
import random

import numpy as np
import pytest

from signalmill.functions import segments as S
from signalmill.functions import trace as core
from signalmill.operators import long_traces, traces

SCHEMA = "session_id string, key string, t double, tick long, value double, alt double, " + ", ".join(f"{c} double" for c in core.SPEC)
SPECS = {
    "high": (0.6, 0.45, 1.0, 0.6, 0.0, 3.0, None, 2.0, 1.0, 0.3),
    "low": (0.4, 0.55, -1.0, 0.3, 1.0, 0.0, None, 2.0, 0.0, 0.35),
    "rising": (0.5, 0.4, 1.0, 0.4, 0.4, 1.0, 0.02, 2.0, 0.5, 0.4),
    "held": (0.55, 0.3, 1.0, 0.8, 2.0, 12.0, None, 2.0, 4.0, 1.0),
}


def wandering(rnd, n, session, key):
    """Rows of a trace that crosses its band often, with pauses, equal times, missing alternatives and a time of exactly 0."""
    out, t, level = [], rnd.choice((-1.0, 0.0, 5.0)), rnd.random()
    for i in range(n):
        level = min(1.0, max(0.0, level + rnd.gauss(0, 0.2))) if rnd.random() < 0.9 else rnd.random()
        out.append((session, key, t, i, level, None if rnd.random() < 0.4 else min(1.0, max(0.0, level + rnd.gauss(0, 0.3))), *SPECS[key]))
        t = round(t + rnd.choice((0.0, 0.2, 0.2, 0.2, 1.0, 20.0 * (rnd.random() < 0.05))), 6)
    return out


def arrays(rows):
    c = [np.array([math.nan if r[i] is None else r[i] for r in rows], float) for i in (2, 4, 5)]
    return (*c, np.array([math.nan if x is None else x for x in rows[0][6:]], float))


@pytest.mark.parametrize("seed", range(60))
def test_summaries_of_chunks_give_the_states_of_running_through(seed):
    rnd = random.Random(seed)
    key = rnd.choice(list(SPECS))
    t, value, alt, spec = arrays(wandering(rnd, rnd.randint(2, 120), "s", key))
    cuts = sorted({0, len(t), *(rnd.randrange(len(t)) for _ in range(rnd.randint(1, 12)))})
    through, folded = core.TraceState(), core.TraceState()
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        before = S.state_of(S.values_of(through))
        part = t[i:j], value[i:j], alt[i:j]
        smooth = S.smoothing(*part, spec[3])
        if j - i > 1:
            k = (j - i) // 2
            halves = S.smoothing(*(c[:k] for c in part), spec[3]).then(S.smoothing(*(c[k:] for c in part), spec[3]), spec[3])
            assert all(a == pytest.approx(b, nan_ok=True) for a, b in zip(vars(halves).values(), vars(smooth).values(), strict=True))
        own = S.state_of({c: getattr(before, c) for c in ("ema", "disagreement", "last_t", "first_t")})
        out, _, _ = core.measured(np.array([0, j - i]), *part, spec[None], [own])
        band = S.Band(own.band_since, bool(S.inside_of(spec, out["ema"]).all()), own.recent.tolist())
        known = S.state_of({**S.values_of(before), "latched": False, "last_fire": math.nan, "fire_count": 0})
        out, may_fire, released = core.measured(np.array([0, j - i]), *part, spec[None], [known])
        found = S.latch(part[0], may_fire, released, out["unreliable"], spec[5])
        got = S.state_of({**smooth.after(before, spec[3]), **band.after(before, spec[7]), **found.after(before, spec[5])})
        core.run(np.array([0, j - i]), *part, spec[None], [through])
        for name, want in S.values_of(through).items():
            if name == "recent":
                assert np.array(S.values_of(got)["recent"]) == pytest.approx(np.array(want)) or math.isnan(spec[6])
            else:
                assert getattr(got, name) == pytest.approx(want, nan_ok=True), name
    assert folded is not through


def test_ranges_of_a_few_rows_equal_whole_traces(spark):
    rnd = random.Random(2)
    rows = [r for key in SPECS for r in wandering(rnd, 130, "long", key)]
    rows += [r for s in range(12) for r in wandering(rnd, rnd.randint(1, 4), f"s{s}", "high")]
    rows += [("nulls", "high", None, 0, 0.5, None, *SPECS["high"]), ("nulls", "high", 1.0, 0, None, None, *SPECS["high"])]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    names = ["session_id", "key", "tick", *core.OUT]
    want = {tuple(r[:3]): r[3:] for r in traces.run_traces(frame).select(*names).collect()}
    for ranges in (100, 3):
        done = long_traces.run_long_traces(frame, ranges)
        got = {tuple(r[:3]): r[3:] for r in done.select(*names).collect()}
        assert got.keys() == want.keys() and sum(r[core.OUT.index("fired")] for r in got.values()) >= 5
        for k, r in got.items():
            for name, a, b in zip(core.OUT, r, want[k], strict=True):
                assert a == b or a == pytest.approx(b, abs=1e-9), (k, name)
    assert long_traces.run_long_traces(frame.limit(0), 3).collect() == []
