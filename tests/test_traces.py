import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.functions import trace as core
from signalmill.operators import traces


def spec(fire, release, tau, polarity=1.0, dwell=0.0, refractory=25.0, min_slope=core.NAN, warmup=None, unreliable_at=0.3):
    return (fire, release, polarity, tau, dwell, refractory, min_slope, 2.0, 2 * tau if warmup is None else warmup, unreliable_at)


def take(state, t, v, alt, s):
    """Some samples of one trace."""
    t, v, alt = (np.atleast_1d(np.asarray(x, float)) for x in (t, v, alt))
    return core.run(np.array([0, len(t)]), t, v, np.broadcast_to(alt, t.shape), np.array([s], float), [state])


def fires(values, s, hz=5.0, alts=None, times=None):
    state, t = core.TraceState(), np.array(times if times else np.arange(len(values)) / hz)
    return t[take(state, t, values, core.NAN if alts is None else alts, s)["fired"]].tolist(), state


def by_definition(samples, s):
    """The outputs at the last of some samples (t, value, alt or None): each one from the whole history."""
    fire, release, polarity, tau, dwell, refractory, min_slope, window, warmup, unreliable_at = s
    smooth, apart, edges, count, latched, last_fire, out = [], None, [], 0, False, None, None
    for k, (t, v, alt) in enumerate(samples):
        # weights of all samples so far
        old = samples[k - 1][0] if k else None
        w = 0.0 if old is None else math.exp(-max(t - old, 0.0) / tau)
        smooth.append(v if old is None else w * smooth[-1] + (1 - w) * v)
        if alt is not None:
            w = 1.0 if not old else math.exp(-max(t - old, 0.0) / (3 * tau))
            apart = abs(v - alt) if apart is None else w * apart + (1 - w) * abs(v - alt)
        inside = [polarity * e >= polarity * fire for e in smooth]
        outside = [i for i, x in enumerate(inside) if not x]
        held = t - samples[outside[-1] + 1 if outside else 0][0] if inside[-1] else 0.0
        near = [(x[0], e) for x, e in zip(samples, smooth) if t - x[0] <= window]
        slope = None if min_slope is None or math.isnan(min_slope) else polarity * least_squares(near)
        warm, ill = t - samples[0][0] >= warmup, apart is not None and apart > unreliable_at
        rests = last_fire is not None and t - last_fire < refractory
        edge = inside[-1] and not latched and not rests and warm and held >= dwell and (slope is None or slope >= min_slope)
        if edge and not ill:
            count, last_fire = count + 1, t
        latched = (latched or edge) and polarity * smooth[-1] > polarity * release
        edges.append(edge)
        out = (smooth[-1], apart, slope, held, warm, ill, edge and not ill, latched, count)
        yield out


def least_squares(points):
    if len(points) < 3:
        return 0.0
    t, v = (np.array(x) for x in zip(*points))
    spread = ((t - t.mean()) ** 2).sum()
    return float(((t - t.mean()) * (v - v.mean())).sum() / spread) if spread > 1e-12 else 0.0


def test_dithering_fires_once():
    assert len(fires([0.95, 0.60] * 24, spec(0.75, 0.45, 0.05, refractory=0))[0]) == 1


def test_rearms_after_release():
    assert len(fires([0.95] * 8 + [0.05] * 12 + [0.95] * 8, spec(0.75, 0.45, 0.05, refractory=0))[0]) == 2


def test_a_standing_condition_fires_once():
    assert len(fires([0.98] * 300, spec(0.7, 0.4, 0.1))[0]) == 1


def test_slope_gates():
    s = spec(0.7, 0.4, 0.4, min_slope=0.05)
    assert not fires([0.9] * 60, s)[0]
    assert fires([min(0.98, i / 60) for i in range(60)], s)[0]


def test_low_polarity_with_dwell():
    at = fires([0.9] * 10 + [0.05] * 40, spec(0.25, 0.55, 0.3, -1.0, dwell=2.0))[0]
    assert len(at) == 1 and at[0] >= 4.0


def test_dwell_blocks_a_spike():
    assert not fires([0.99] * 5 + [0.0] * 10, spec(0.7, 0.4, 0.05, dwell=3.0))[0]


def test_disagreeing_wordings_are_silent():
    s = spec(0.7, 0.4, 0.1)
    at, state = fires([0.95] * 40, s, alts=[0.10] * 40)
    assert not at and state.latched
    assert fires([0.95] * 40, s, alts=[0.92] * 40)[0]


def test_smoothing_follows_the_clock():
    s = spec(0.9, 0.1, 1.0)
    for gap, low, high in ((0.04, 0.0, 0.1), (4.0, 0.9, 1.0)):
        state = core.TraceState()
        take(state, 0.0, 0.0, core.NAN, s)
        assert low <= take(state, gap, 1.0, core.NAN, s)["ema"][0] <= high


def test_slope_is_signed_by_polarity():
    s = spec(0.25, 0.55, 0.2, -1.0, min_slope=0.0)
    t = np.arange(40)
    assert take(core.TraceState(), t / 5, 1 - t / 40, core.NAN, s)["slope"][-1] > 0


def test_a_last_time_of_zero_counts_as_none_for_disagreement():
    s = spec(0.9, 0.1, 1.0)
    state = core.TraceState()
    take(state, 0.0, 0.5, 0.5, s)
    assert take(state, 3.0, 0.9, 0.1, s)["disagreement"][0] == 0.0


def test_recall_and_false_positives():
    rng = np.random.default_rng(7)
    s = spec(0.548, 0.452, 2.795, dwell=1.0, refractory=999, unreliable_at=1.0)
    found = {}
    for truth in (True, False):
        n = 0
        for _ in range(200):
            right = rng.random(100) < 0.70
            n += bool(fires(np.where(right == truth, 0.9, 0.1), s)[0])
        found[truth] = n / 200
    assert found[True] >= 0.97 and found[False] <= 0.03


def random_rows(seed, traces_n=40):
    rnd = random.Random(seed)
    rows, specs = [], {}
    for k in range(traces_n):
        fire = rnd.uniform(0.4, 0.6)
        polarity = rnd.choice((1.0, -1.0))
        specs[f"k{k % 7}"] = (fire, fire - 0.15 * polarity, polarity, rnd.uniform(0.1, 3), rnd.choice((0.0, 1.0)), rnd.choice((0.0, 5.0)), rnd.choice((None, 0.01)), 2.0, rnd.choice((0.0, 1.0)), rnd.choice((0.3, 1.0)))
        t = rnd.choice((0.0, 5.0))
        for tick in range(rnd.choice((1, 3, 60, 200 if k < 3 else 20))):
            t += rnd.choice((0.0, 0.2, 0.2, 1.0, 0.04))
            rows.append((f"s{k // 7}", f"k{k % 7}", t, tick, rnd.random(), rnd.choice((None, rnd.random()))))
    return rows, specs


def test_on_spark_against_row_by_row(spark):
    rows, specs = random_rows(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # traces go on over batches
    try:
        data = spark.createDataFrame(rows, "session_id string, key string, t double, tick long, value double, alt double").repartition(5)
        table = spark.createDataFrame([(k, *v) for k, v in specs.items()], "key string, " + ", ".join(f"{c} double" for c in core.SPEC))
        got = {(r.session_id, r.key, r.tick): r for r in traces.run_traces(traces.with_specs(data, table)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    by = {}
    for s, k, t, tick, v, alt in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        by.setdefault((s, k), []).append((tick, t, v, alt))
    for (s, k), one in by.items():
        for (tick, *_), want in zip(one, by_definition([x[1:] for x in one], specs[k])):
            r = got[s, k, tick]
            for name, x in zip(core.OUT, want):
                assert getattr(r, name) == (x if x is None or isinstance(x, (bool, int)) else pytest.approx(x, abs=1e-11)), name


def test_window_measures_against_loops(spark):
    rows, _ = random_rows(5, 14)
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
    data = spark.createDataFrame([(*r[:4], r[4]) for r in rows], "session_id string, key string, t double, tick long, ema double")
    out = traces.ema_integral(traces.ema_slope(data, 2.0), 3.0)
    out = traces.in_band_for(out, traces.in_band(F.col("ema"), F.lit(0.5), F.lit(-1.0)))
    got = {(r.session_id, r.key, r.tick): r for r in out.collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        by.setdefault(r[:2], []).append(r)
    for one in by.values():
        since = None
        for i, r in enumerate(one):
            us = lambda x: round(x * 1e6)
            window = lambda w: [x for x in one[: i + 1] if us(r[2]) - us(x[2]) <= w * 1e6]  # noqa: E731,B023
            assert got[r[0], r[1], r[3]].slope == pytest.approx(least_squares([(x[2], x[4]) for x in window(2.0)]), abs=1e-8)
            part = window(3.0)
            area = sum((b[2] - a[2]) * (a[4] + b[4]) / 2 for a, b in zip(part, part[1:]))
            span = part[-1][2] - part[0][2]
            assert got[r[0], r[1], r[3]].integral == pytest.approx(area / span if span > 1e-9 else 0.0, abs=1e-8)
            since = (r[2] if since is None else since) if r[4] <= 0.5 else None
            assert got[r[0], r[1], r[3]].in_band_for == pytest.approx(0.0 if since is None else r[2] - since, abs=1e-9)


def test_silent_channels_do_not_fire(spark):
    data = spark.createDataFrame([("s", "floor:me", True), ("s", "confusion", True), ("s", "confusion", False)], "session_id string, key string, fired boolean")
    table = spark.createDataFrame([("floor", True), ("confusion", False)], "id string, silent boolean")
    assert [r.key for r in traces.fired_edges(data, table).collect()] == ["confusion"]
