"""Rolling contexts against a plain reading of their definition."""

import random

import pytest

from signalmill.operators import context


def lines_of(t, said, window_s, max_chars, most):
    """said: (t, seq, line) in order."""
    out, used = [], 0
    if t is None:
        return out
    for s, _, line in reversed([x for x in said if x[0] <= t]):
        used += len(line) + 1
        if t - s > window_s or used > max_chars or len(out) == most:
            break
        out.append(line)
    return out[::-1]


@pytest.mark.parametrize(("window_s", "max_chars", "most"), [(45.0, 300, 400), (3.0, 10_000, 400), (2000.0, 10_000, 3)])
def test_contexts_are_those_of_the_definition(spark, window_s, max_chars, most):
    rnd = random.Random(7)
    said = [(s, i, round(rnd.randrange(0, 6000) / 5, 1), rnd.choice(("ME", "THEM", None)), rnd.choice((None, "é" * rnd.randrange(1, 120), "ok"))) for s in "ab" for i in range(150)]
    ticks = [(s, i, round(i * 5.2, 1) if i % 50 else None, "kept") for s in ("a", "b", "silent", None) for i in range(260)]
    a = spark.createDataFrame(ticks, "session_id string, tick long, t double, said string").repartition(3)
    b = spark.createDataFrame([*said, (None, 0, 1.0, "ME", "no session"), ("a", 999, None, "ME", "no time")], "session_id string, seq long, t double, speaker string, text string").repartition(3)
    rows = context.rolling_context(a, b, window_s, max_chars, most)
    assert rows.columns == [*a.columns, "lines"]
    got = {(r.session_id, r.tick): r for r in rows.collect()}
    assert len(got) == len(ticks)
    for s, i, t, kept in ticks:
        known = sorted((x[2], x[1], f"{x[3] or ''}: {x[4] or ''}") for x in said if x[0] == s)
        assert got[s, i].lines == lines_of(t, known, window_s, max_chars, most) and got[s, i].said == kept
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "Join" not in plan and plan.count("Exchange hash") == 1
    assert context.rolling_context(a, b.limit(0)).filter("size(lines) > 0").count() == 0


def test_measures_keep_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    from signalmill.operators import meter, traces

    rows = spark.createDataFrame([("s", "k", float(i), i, 0.9, 1, 2, 3, 4, 5) for i in range(6)], "session_id string, key string, t double, tick long, ema double, dt int, term int, within int, run int, nth int")
    done = traces.latest_samples(traces.in_band_for(traces.ema_integral(rows, 3.0), F.col("ema") > 0.5), 2)
    assert done.columns == [*rows.columns, "integral", "in_band_for"]
    assert sorted((r.tick, round(r.integral, 9), r.in_band_for, r.dt, r.term, r.within, r.run, r.nth) for r in done.collect()) == [(4, 0.9, 4.0, 1, 2, 3, 4, 5), (5, 0.9, 5.0, 1, 2, 3, 4, 5)]
    assert meter.latency_percentiles(rows.withColumn("latency_ms", F.col("t")), latest=3).first().p50_ms == 4.0
