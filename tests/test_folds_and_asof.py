"""Jumps against plain loops, and as-of values by buckets against a window over whole sessions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from signalmill.functions import folds
from signalmill.operators import asof, gate, rules


def times(rnd, n):
    t = np.cumsum([rnd.choice((0.0, 0.1, 0.2, 0.3, 5.0)) for _ in range(n)])
    return np.round(t - 3, 6)


@pytest.mark.parametrize("seed", range(40))
def test_spaced_hits_are_those_of_a_loop(seed):
    rnd = random.Random(seed)
    t, gap, last = times(rnd, rnd.randint(1, 300)), rnd.choice((0.0, 0.3, 1.0, 7.7)), rnd.choice((math.nan, -3.05, 4.0))
    want, kept = [], last
    for x in t:
        keep = math.isnan(kept) or x - kept >= gap
        kept = x if keep else kept
        want.append(keep)
    assert folds.spaced(t, gap, last).tolist() == want


@pytest.mark.parametrize("seed", range(40))
def test_gate_reasons_are_those_of_a_loop(seed):
    rnd = random.Random(seed)
    t, last = times(rnd, rnd.randint(1, 300)), rnd.choice((math.nan, -4.0, 2.0))
    eventful = np.array([math.nan if rnd.random() < 0.3 else rnd.random() * rnd.choice((0.6, 1.0)) for _ in t])
    want, opened = [], last
    for x, e in zip(t, eventful, strict=True):
        reason = "start" if x < 0.5 else "no bank" if math.isnan(opened) else "stale" if x - opened > 2.0 else "eventful" if e >= 0.62 else None
        opened = x if reason else opened
        want.append(reason)
    assert folds.gate_reasons(t, eventful, last, 0.5, 2.0, 0.62).tolist() == want


def test_ten_million_level_hits_take_seconds():
    t = np.arange(2_000_000) * 0.2
    assert folds.spaced(t, 30.0).sum() == math.ceil(2_000_000 / 150)
    assert folds.spaced(t, 0.0).all()


def test_state_is_carried_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = [(s, i, i * 1.0, None) for s in "ab" for i in range(60)]
        got = gate.gate_decisions(spark.createDataFrame(data, "session_id string, tick long, t double, eventful double"))
        assert {(r.session_id, r.tick) for r in got.filter("reason = 'stale'").collect()} == {(s, i) for s in "ab" for i in range(11, 60, 9)}
        hits = spark.createDataFrame([(s, "r", float(i), i, 4.0) for s in "ab" for i in range(60)], "session_id string, rule string, t double, tick long, refractory_s double")
        assert sorted((r.session_id, r.tick) for r in rules.cooled_down(hits).collect()) == [(s, i) for s in "ab" for i in range(0, 60, 4)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("bucket_s", [0.5, 7.0, 1e9])
def test_last_known_equals_a_window_over_the_session(spark, bucket_s):
    rnd = random.Random(6)
    data = [(rnd.choice("abc"), rnd.randrange(-40, 40) / 4, i, rnd.random() if rnd.random() < 0.2 else None, "x" if rnd.random() < 0.1 else None, i % 3) for i in range(400)]
    data += [("quiet", 1.0, 1000, None, None, 0)]
    rows = spark.createDataFrame(data, "session_id string, t double, tick long, a double, slot string, final int").repartition(5)
    upto = Window.partitionBy("session_id").orderBy("t", "tick").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in ("a", "slot")})
    got = asof.last_known(rows, ["a", "slot"], ("t", "tick"), bucket_s=bucket_s)
    assert got.columns == rows.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "session_id" in plan and asof.last_known(rows.limit(0), ["a"], ("t", "tick")).collect() == []


def test_rows_before_a_window_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(300).selectExpr("CAST(id % 3 AS STRING) AS session_id", "CAST(id AS DOUBLE) AS t", "id AS tick", "CASE WHEN id % 7 = 0 THEN id END AS a", "id AS other").mapInArrow(note, "session_id string, t double, tick long, a long, other long")
    assert asof.last_known(rows, ["a"], ("t", "tick"), bucket_s=10.0).count() == 300
    asof.last_known(rows, ["a"], ("t", "tick"), bucket_s=10.0).write.format("noop").mode("overwrite").save()
    assert seen.value <= 900
