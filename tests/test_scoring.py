import json
import time

import pytest

from signalmill.operators import answers, meter
from signalmill.sources import scoring

CHANNELS = "id string, kind string, criteria array<struct<option:string,label:string>>, watch array<string>, alt string"


def lines_model():
    """What loads the model; nested, so that workers get it by value."""

    def load():
        def model(payloads):
            if any(p.get("bad") for p in payloads):
                raise RuntimeError("bad row")
            for p in payloads:
                yield {"answers": {"ask": p["x"], "pick": {"choice": "a", "probabilities": {"a": 0.7, "b": 0.3}}, "none": None}, "input_tokens": p["n"], "model": "m"}

        return model

    return load


def rows_of(spark, payloads, load=None, **options):
    frame = spark.createDataFrame([(i % 2, i, float(i), p, "x") for i, p in enumerate(payloads)], "session_id int, tick int, t double, payload string, answers string")
    return scoring.score_calls(frame.repartition(3), load or lines_model(), **options)


def test_failures_are_rows_of_their_own(spark):
    payloads = [json.dumps({"x": i / 10, "n": i}) for i in range(10)] + [json.dumps({"x": 0, "n": 1, "bad": True}), None, "", "{", "[]"]
    calls = rows_of(spark, payloads, batch_rows=4)
    got = {r.tick: r for r in calls.collect()}
    assert len(got) == 15
    for i in range(10):
        r = got[i]
        assert r.error is None and r.answers["ask"].noul == i / 10 and r.answers["pick"].probabilities == {"a": 0.7, "b": 0.3} and set(r.answers) == {"ask", "pick"}
        assert (r.input_tokens, r.output_tokens, r.model, r.stage, r.session_id) == (i, 0, "m", "bank", str(i % 2)) and r.latency_ms >= 0
    assert got[10].error == "RuntimeError: bad row" and got[11].error == "no payload" and got[12].error == got[13].error == "the payload is no JSON" and got[14].error.startswith("AttributeError")
    assert all(got[i].answers == {} and got[i].input_tokens == 0 for i in range(10, 15))


def test_a_log_of_calls_feeds_answers_and_the_meter(spark):
    calls = rows_of(spark, [json.dumps({"x": i / 10, "n": 5, "bad": i == 3}) for i in range(6)])
    table = spark.createDataFrame([("ask", "noul", [], [], ""), ("pick", "choice", [("a", "A"), ("b", "B")], ["b"], "")], CHANNELS)
    judged = {(r.tick, r.key): r.raw for r in answers.parse_answers(calls, table).collect()}
    assert judged == {**{(i, "ask"): i / 10 for i in range(6) if i != 3}, **{(i, "pick:b"): 0.3 for i in range(6) if i != 3}}
    totals = {r.session_id: (r.calls, r.tokens, r.errors) for r in meter.totals(calls).collect()}
    assert totals == {"0": (3, 15, 0), "1": (3, 10, 1)}


def test_verdicts_of_another_form_are_failures():
    ok = {"answers": {"q": 1}}
    one = lambda scorer, n=2: scoring.scored(scorer, [{}] * n)
    assert all("0 verdicts for 1" in r[-1] for r in one(lambda p: []))
    assert [r[-1] for r in one(lambda p: [ok] * len(p))] == [None, None]
    assert all(r[-1].startswith("ValueError") for r in one(lambda p: [{"answers": {"q": "yes"}}] * len(p)))
    assert all(r[-1].startswith("AttributeError") for r in one(lambda p: [3] * len(p)))
    assert [r[-1] for r in one(lambda p: [{**ok, "error": "down"}] * len(p))] == ["down"] * 2 and one(lambda p: [{**ok, "error": "down"}] * len(p))[0][0] == []
    slow = lambda p: [time.sleep(0.02) or ok for _ in p]
    assert all(r[3] >= 40 for r in one(slow))


def test_loading(spark, tmp_path):
    marks = str(tmp_path / "loads")

    def load():
        with open(marks, "a") as f:
            f.write("x")
        return lambda payloads: [{"answers": {"q": 0.5}} for _ in payloads]

    assert rows_of(spark, ["{}"] * 200, load, batch_rows=1).filter("answers['q'].noul = 0.5").count() == 200
    with open(marks) as f:
        assert 1 <= len(f.read()) <= 4
    assert rows_of(spark, ["{}"], load).limit(0).count() == 0

    def broken():
        raise OSError("no weights")

    with pytest.raises(Exception, match="no weights"):
        rows_of(spark, ["{}"], broken).collect()


def test_payloads_are_read_a_few_at_a_time():
    import pyarrow as pa

    asked = []

    def model(payloads):
        asked.append(len(payloads))
        return [{"input_tokens": p["n"]} for p in payloads]

    n = 1000
    batch = pa.RecordBatch.from_pydict({"session_id": ["a"] * n, "tick": list(range(n)), "t": [0.0] * n, "stage": ["bank"] * n, "payload": [f'{{"n": {i}}}' for i in range(n)]})
    parts = scoring.score_batch(model, batch, 64)
    first = next(parts)
    assert asked == [64] and first.num_rows == 64
    assert [x for p in (first, *parts) for x in p.column("input_tokens").to_pylist()] == list(range(n))
