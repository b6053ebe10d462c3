import datetime

import pytest
from pyspark.sql import functions as F

from signalmill.functions import trace as core
from signalmill.operators import traces
from signalmill.streaming import traces as streams

SCHEMA = "session_id string, key string, t double, tick long, value double, alt double, " + ", ".join(f"{c} double" for c in core.SPEC)


def rows():
    out = []
    for s in ("a", "b"):
        for k, low in (("x", False), ("y", True)):
            for i in range(60):
                v = 0.9 if (i // 15) % 2 == low else 0.1
                spec = (0.4, 0.6, -1.0) if low else (0.6, 0.4, 1.0)
                out.append((s, k, i / 5, i, v, v if i % 3 else None, *spec, 0.3, 0.2, 1.0, None, 2.0, 0.5, 0.3))
    return out


def run(spark, frame, make, tmp_path, parts, mode="memory"):
    """The stream's rows over so many files in order of time, one micro-batch each."""
    source = str(tmp_path / "in")
    for i in range(parts):
        frame.filter(F.floor(F.col("tick") * parts / 60) == i).coalesce(1).write.mode("append").parquet(source)
    return again(spark, frame.schema, make, tmp_path)


def again(spark, schema, make, tmp_path):
    """Goes on from the checkpoint over what is new in the folder; the rows of all runs."""
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    with streams.on_rocksdb(spark):
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None and not query.isActive
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_stream_equals_batch(spark, tmp_path):
    frame = spark.createDataFrame(rows(), SCHEMA)
    batch = {(r.session_id, r.key, r.tick): r for r in traces.run_traces(frame).collect()}
    got = run(spark, frame, streams.stream_traces, tmp_path, 3).collect()
    assert len(got) == len(batch) and any(r.fired for r in got)
    for r in got:
        want = batch[r.session_id, r.key, r.tick]
        assert r.ema == pytest.approx(want.ema) and (r.fired, r.latched, r.fire_count, r.unreliable) == (want.fired, want.latched, want.fire_count, want.unreliable)


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    frame = spark.createDataFrame(rows(), SCHEMA)
    want = sorted((r.session_id, r.key, r.tick, round(r.ema, 9), r.fired, r.fire_count) for r in traces.run_traces(frame).collect())
    make = lambda s: streams.stream_traces(s, streams.Ends(buckets=3))
    assert run(spark, frame.filter("tick < 23"), make, tmp_path, 5).count() == 92
    frame.filter("tick >= 23").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = again(spark, frame.schema, make, tmp_path)
    assert sorted((r.session_id, r.key, r.tick, round(r.ema, 9), r.fired, r.fire_count) for r in got.collect()) == want


def default_calls(spark):
    """Judgments of all traces of the default channels in some sessions, with questions."""
    import random

    from signalmill.functions import channels as ch

    rnd, specs = random.Random(12), ch.derive_specs(ch.default_channels(spark))
    keys = sorted(r.key for r in specs.select("key").collect())
    data, said = [], []
    for s in range(2):
        level = dict.fromkeys(keys, 0.3)
        for tick in range(600):
            if tick % 40 == 0:
                for k in keys:
                    level[k] = rnd.choice((0.05, 0.5, 0.95))
            for k in keys:
                # some traces come at some ticks only
                if k.startswith("floor") or tick % 3 == 0:
                    data.append((f"s{s}", k, tick / 5, tick, min(1.0, max(0.0, level[k] + rnd.gauss(0, 0.08))), None))
            if tick % 130 == 7:
                said.append((f"s{s}", tick, tick / 5, "THEM", rnd.choice(("How? ", "What does it cost " + "x" * 90 + "?", "Fine."))))
    judged = spark.createDataFrame(data, "session_id string, key string, t double, tick long, raw double, alt double")
    utterances = spark.createDataFrame(said, "session_id string, seq long, t double, speaker string, text string")
    return judged, specs, keys, utterances


def test_cards_of_a_stream_are_those_of_the_batch_job(spark, tmp_path):
    from signalmill.jobs import workloads

    judged, specs, keys, utterances = default_calls(spark)
    batch = workloads.cards_from_judgments(judged, specs, utterances=utterances)
    want = sorted((r.session_id, r.rule, r.tick, r.t, r.body, r.severity, tuple(sorted(r.evidence.items()))) for r in batch.collect())
    rows_in = judged.withColumn("value", F.col("raw")).select("session_id", "key", "t", "tick", "value", "alt", F.lit(None).cast("string").alias("text"))
    rows_in = rows_in.unionByName(utterances.select("session_id", "t", "text"), allowMissingColumns=True)
    source = str(tmp_path / "in")
    for i in range(3):
        rows_in.filter(F.floor(F.col("t") / 41) == i).coalesce(1).write.mode("append").parquet(source)

    def make(stream):
        calls = traces.with_specs(stream.filter("tick IS NOT NULL"), specs)
        return streams.stream_sessions(calls, keys, utterances=stream.filter("tick IS NULL"))

    got = again(spark, rows_in.schema, make, tmp_path)
    found = sorted((r.session_id, r.rule, r.tick, r.t, r.body, r.severity, tuple(sorted(r.evidence.items()))) for r in got.collect())
    assert found == want and len({c[1] for c in want}) >= 8 and any("How?" in c[4] for c in want)


def test_rates_are_those_of_the_batch_meter(spark, tmp_path):
    import random

    from signalmill.operators import meter

    rnd, data = random.Random(3), []
    for s in "ab":
        t = 0.0
        for tick in range(60):
            t = round(t + rnd.choice((0.0, 1.0, 5.0, 20.0, 31.0)), 3)
            data.append((s, tick, t, rnd.randrange(1, 500)))
    frame = spark.createDataFrame(data, "session_id string, tick long, t double, input_tokens long")
    got = run(spark, frame, lambda s: streams.stream_meter(s, 20.0, streams.Ends("30 seconds", 60.0)), tmp_path, 5)
    told = {(r.session_id, r.tick): r for r in got.collect()}
    want = {(r.session_id, r.tick): r for r in meter.rolling_rates(frame, 20.0).collect()}
    last = max(t for *_, t, _ in data)
    # parts are cut by tick, so a session may run ahead; rows later than the watermark aren't told
    assert told.keys() <= want.keys() and len(told) >= 60
    assert all(k in told for k, r in want.items() if k[0] == max("ab", key=lambda s: max(d[2] for d in data if d[0] == s)) and r.t < last - 31)
    whole = max("ab", key=lambda s: max(d[2] for d in data if d[0] == s))
    for k, r in told.items():
        if k[0] == whole:
            for c in ("tokens_per_sec", "requests_per_min", "dollars_per_hour", "tok_limit_pct", "req_limit_pct"):
                assert r[c] == pytest.approx(want[k][c]), (k, c)


def test_states_end_and_late_rows_are_left_out(spark, tmp_path):
    # session a is quiet after 12 s; b goes on for two hours and lets the watermark pass; at last a comes again, once late
    data = [(*r[:2], r[2] + (0 if r[0] == "a" else 7200 * (r[3] >= 20)), *r[3:]) for r in rows() if r[0] == "b" or r[3] < 20]
    extra = [("a", "x", 8000.0, 58, 0.9, None, *rows()[0][6:]), ("a", "y", 13.0, 59, 0.9, None, *rows()[0][6:])]
    frame = spark.createDataFrame([*data, *extra], SCHEMA)
    ends = streams.Ends("10 seconds", 600.0)
    out = run(spark, frame, lambda s: streams.stream_traces(s, ends), tmp_path, 6)
    again = out.filter("session_id = 'a' AND tick = 58").first()
    # nothing is known of the session's first part any more, and it is no part of the state store
    assert again.ema == 0.9 and again.fire_count == 0
    assert out.filter("tick = 59").filter("session_id = 'a'").count() == 0
    left = spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "cp")).select("user_map_key.session_id", "user_map_key.key").collect()
    assert {tuple(r) for r in left} == {("a", "x")}


def test_quota_is_kept_over_batches(spark, tmp_path):
    frame = spark.createDataFrame(rows(), SCHEMA).withColumn("raw", F.col("value"))
    got = run(spark, frame, lambda s: streams.stream_quota(s, 5), tmp_path, 3)
    assert {tuple(r) for r in got.groupBy("key", "bin").count().collect()} == {("x", 1, 10), ("x", 9, 10), ("y", 1, 10), ("y", 9, 10)}


def test_rates_and_replayed_cards(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    calls = [("a", start + datetime.timedelta(seconds=i), 100, i) for i in range(60)] + [("a", start + datetime.timedelta(minutes=9), 1, 59)]
    frame = spark.createDataFrame(calls, "session_id string, ts timestamp, input_tokens long, tick long")
    got = run(spark, frame, lambda s: streams.stream_rates(s, step="20 seconds"), tmp_path, 1).orderBy("window").collect()
    assert [(r.tokens, r.calls) for r in got][:3] == [(2000, 20)] * 3
    cards = frame.select("session_id", F.lit("r").alias("rule"), (F.col("tick") % 10).alias("tick"), "ts")
    once = cards.filter("ts < TIMESTAMP'2024-01-01 00:00:50'")
    path = str(tmp_path / "cards")
    once.write.parquet(path)
    stream = streams.stream_cards_once(spark.readStream.schema(once.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("cards_once").trigger(availableNow=True).start()
    query.awaitTermination(100)
    assert spark.table("cards_once").count() == 10


class Store:
    """A map or value state that counts its calls."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.kept[key] = value

    def exists(self):
        return True

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)


def test_calls_of_the_store_grow_with_blocks_not_names():
    import types

    import pandas as pd

    from signalmill.streaming import processors

    maps = {}
    store = lambda name, *_: maps.setdefault(name, Store())
    handle = types.SimpleNamespace(getMapState=store, getValueState=store)
    quotas = processors.Quotas(3600.0, 2)
    quotas.init(handle)
    now = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    n = 3000
    rows = pd.DataFrame({"session_id": [f"s{i % 1000}" for i in range(n)], "key": "k", "bin": 1, "t": range(n), "tick": range(n), "raw": 0.5, "ts": pd.Timestamp("2024-01-01"), "block": [i % 1000 % 8 for i in range(n)]})
    (first,) = quotas.handleInputRows((0,), iter([rows.iloc[:1500]]), now)
    (second,) = quotas.handleInputRows((0,), iter([rows.iloc[1500:]]), now)
    # 1000 names; a session's first two rows are taken, whichever micro-batch they come in
    assert sorted(first["tick"]) == list(range(1500)) and sorted(second["tick"]) == list(range(1500, 2000))
    # eight blocks: written, then read and written; the index: read twice, written once
    assert maps["state"].calls == 3 * 8 and maps["state_index"].calls == 3


class Records(Store):
    """One that can also be read whole and emptied."""

    def iterator(self):
        return iter(list(self.kept.items()))

    def removeKey(self, key):
        del self.kept[key]

    def exists(self):
        return bool(self.kept)

    def clear(self):
        self.kept.clear()


def stored(processor):
    """The processor with its states, by their names."""
    import types

    maps = {}
    store = lambda name, *_: maps.setdefault(name, Records())
    processor.init(types.SimpleNamespace(getMapState=store, getValueState=store, registerTimer=lambda at: None))
    return maps


def at(ms):
    import types

    return types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


def test_calls_wait_as_bytes_and_are_told_with_their_window():
    import numpy as np
    import pandas as pd

    from signalmill.functions.windows import trailing_sums
    from signalmill.streaming import processors

    meter = processors.Meter(3600.0, 20.0)
    maps, n = stored(meter), 400
    t = np.arange(n) // 4 * 1.5
    calls = pd.DataFrame({"session_id": [f"s{i % 4}" for i in range(n)], "t": t, "tick": range(n), "tokens": (np.arange(n) * 7 % 13).astype(float), "ts": pd.to_datetime(t * 1e9), "block": np.arange(n) % 4 % 3})
    told = []
    for i, j, now in ((0, 150, 40_000), (150, 280, 90_000), (280, n, 200_000)):
        assert not list(meter.handleInputRows((0,), iter([calls.iloc[i:j]]), at(0)))
        # one value of bytes a block, whatever it holds
        assert set(maps["state"].kept) == {(0,), (1,), (2,)} and all(len(r) == 1 and type(r[0]) is bytes for r in maps["state"].kept.values())
        told += meter.handleExpiredTimer((0,), at(now), None)
    told = pd.concat(told).set_index("tick")
    assert sorted(told.index) == list(range(n))
    for _, mine in calls.groupby("session_id"):
        sums, counts, oldest = trailing_sums(mine["t"].to_numpy(), mine["tokens"].to_numpy(), 20_000_000)
        got = told.loc[mine["tick"]]
        assert np.array_equal(got["tokens"], sums) and np.array_equal(got["calls"], counts) and np.array_equal(got["oldest"], oldest)
    # once all are idle, nothing stays
    assert not sum(map(len, meter.handleExpiredTimer((0,), at(10**10), None))) and not maps["state"].kept


def test_states_of_sessions_are_bytes(monkeypatch):
    import numpy as np
    import pandas as pd

    from signalmill.streaming import processors

    pdf = pd.DataFrame(rows(), columns=[c.split()[0] for c in SCHEMA.split(", ")]).assign(silent=False, text=None, block=1)
    pdf["ts"] = pd.to_datetime(pdf["t"] * 1e9)
    options = ({"x": ["ema", "integral30", "warm"], "y": ["ema"]}, ["x"], {"x": "x", "y": "y"}, 2.0, 5.0, 45.0, 90)
    whole = processors.Sessions(3600.0, *options)
    stored(whole)
    (want,) = whole.handleInputRows((0,), iter([pdf]), at(0))
    # a slope that no rule reads is not measured
    monkeypatch.delattr(processors, "trailing_slope")
    parts = processors.Sessions(3600.0, *options)
    maps = stored(parts)
    got = pd.concat([x for k in range(3) for x in parts.handleInputRows((0,), iter([pdf[pdf["tick"] // 20 == k]]), at(0))])
    assert all(len(r) == 1 and type(r[0]) is bytes for name in ("state", "state_index") for r in maps[name].kept.values()) and len(maps["state"].kept) == 1
    want, got = (x.sort_values(["session_id", "tick"], ignore_index=True) for x in (want, got))
    assert len(want) == 120 and np.array_equal(want["x__fired"], got["x__fired"]) and want["x__fired"].any()
    for c in ("x__ema", "x__integral30", "y__ema"):
        assert np.allclose(want[c], got[c], rtol=0, atol=1e-9)


def test_windows_of_many_sessions_at_once():
    import numpy as np

    from signalmill.functions.windows import trailing_sums

    rnd = np.random.default_rng(3)
    sizes = [1, 40, 7, 90]
    times = [np.sort(rnd.integers(0, 60, n) / 2) for n in sizes]
    # a huge value in one session rounds no sum of another
    values = [np.array([1e20]), *(rnd.random(n) for n in sizes[1:])]
    got = trailing_sums(np.concatenate(times), np.concatenate(values), 5_000_000, np.cumsum([0, *sizes]))
    for g, w in zip(got, zip(*(trailing_sums(t, v, 5_000_000) for t, v in zip(times, values, strict=True)), strict=True), strict=True):
        assert np.array_equal(g, np.concatenate(w))
