import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.functions import channels as ch
from signalmill.functions import isotonic
from signalmill.operators import answers, calibration, context, evaluate, gate, meter, rules, sampling
from signalmill.sources import transcripts

# Derived specs at 5 ticks a second with the gate open for 0.4 of them: fire, release, tau, unreliable_at.
GOLDEN = {
    "eventful": (0.5720, 0.4280, 0.943, 0.472),
    "floor:me": (0.4839, 0.3428, 0.488, 0.4113),
    "question_answered": (0.4280, 0.5720, 0.943, 0.472),
    "confusion": (0.5499, 0.4501, 3.587, 1.0),
    "objection:price": (0.4592, 0.3458, 2.907, 1.0),
    "commitment": (0.5720, 0.4280, 2.358, 0.472),
    "commitment_bound": (0.4376, 0.5624, 3.587, 1.0),
    "claim_checkable": (0.5672, 0.4328, 2.907, 0.4627),
    "interest": (0.5461, 0.4539, 4.442, 1.0),
    "repetition": (0.5576, 0.4424, 4.442, 1.0),
    "off_agenda": (0.4376, 0.5624, 3.587, 1.0),
    "decision_ready": (0.5528, 0.4472, 5.542, 1.0),
}


def test_derived_specs(spark):
    table = ch.default_channels(spark)
    rows = {r.key: r for r in ch.derive_specs(table).collect()}
    assert len(rows) == 17 and answers.questions(table).count() == 24
    for key, want in GOLDEN.items():
        r = rows[key]
        assert (r.fire, r.release, r.tau, r.unreliable_at) == pytest.approx(want, abs=2e-4) and r.status == "ok"
    bad = table.filter("id = 'commitment'").withColumn("accuracy", F.lit(0.52))
    assert ch.derive_specs(bad).first().status == "gap too small"
    with pytest.raises(Exception, match="gap too small"):
        ch.derive_specs(bad, strict=True).collect()
    taus = spark.range(1).select(*(F.round(ch.required_tau(F.lit(0.70), F.lit(hz), F.lit(0.9), F.lit(0.1), F.lit(0.65)), 3) for hz in (3.0, 5.0, 12.0, 20.0))).first()
    assert tuple(taus) == (4.658, 2.795, 1.164, 0.699)


def test_parse_answers(spark):
    said = {"commitment": {"noul": 0.7}, "commitment~alt": {"noul": 0.6}, "objection": {"choice": "price", "probabilities": {"price": 0.8}}, "confusion": {"score": 1.5}, "unknown": {"noul": 1.0}, "interest~alt": {"score": 1.0}}
    path_rows = [("s", 1, 0.5, json.dumps(said)), ("s", 2, 0.7, "{}")]
    calls = spark.createDataFrame(path_rows, "session_id string, tick long, t double, a string").withColumn("answers", F.from_json("a", transcripts.ANSWERS)).drop("a")
    got = {r.key: (r.raw, r.alt) for r in answers.parse_answers(calls, ch.default_channels(spark)).collect()}
    assert got == {"commitment": (0.7, 0.6), "objection:price": (0.8, None), "objection:timing": (0.0, None), "objection:authority": (0.0, None), "objection:trust": (0.0, None), "confusion": (0.75, None)}
    q = answers.plain_question(spark.createDataFrame([("objection:price",), ("interest",)], "key string"), ch.default_channels(spark)).collect()
    assert q[0].question.endswith("is it 'price' (price)?") and q[1].question == "How keen are they?"
    merged = answers.merged_answers(calls, calls.withColumn("answers", F.from_json(F.lit('{"commitment": {"noul": 0.1}}'), transcripts.ANSWERS))).orderBy("tick").collect()
    assert merged[0].answers["commitment"].noul == 0.1 and merged[0].answers["confusion"].score == 1.5


def test_gate_on_spark(spark):
    data = spark.createDataFrame([(s, i, i * 1.0, None) for s in "ab" for i in range(30)], "session_id string, tick long, t double, eventful double")
    opened = sorted((r.session_id, r.tick) for r in gate.gate_decisions(data).filter("open").collect())
    assert opened == [(s, t) for s in "ab" for t in (0, 1, 2, 11, 20, 29)]
    assert gate.on_open_ticks(data, gate.gate_decisions(data)).count() == 12


def test_sources(spark):
    lines = ['{"t": 1.5, "speaker": "ME", "text": "hi?", "truth": {"floor": "me", "eventful": true, "confusion": 1.5}}', "", "  // note", '{"text": "x"}', "{}"]
    script = transcripts.parse_scripts(spark.createDataFrame([("s", x) for x in lines], "session_id string, value string"))
    assert [(r.t, r.speaker, r.text) for r in script.collect()] == [(1.5, "ME", "hi?"), (0.0, "THEM", "x"), (0.0, "THEM", "")]
    assert {(r.channel, r.value) for r in transcripts.truth_changes(script).collect()} == {("floor", "me"), ("eventful", "true"), ("confusion", "1.5")}
    typed = ["ME: x", " them : y", "bare", "Bob: z", "ME:", "ME: a: b", " ", "silence: -"]
    got = [(r.speaker, r.text) for r in transcripts.parse_speaker_lines(spark.createDataFrame([(x,) for x in typed], "value string")).collect()]
    assert got == [("ME", "x"), ("THEM", "y"), ("THEM", "bare"), ("THEM", "Bob: z"), ("THEM", "ME:"), ("ME", "a: b"), ("SILENCE", "-")]
    events = [{"type": "TurnInfo", "transcript": " a "}, {"type": "TurnInfo", "event": "EndOfTurn", "transcript": "b"}, {"type": "TurnInfo", "event": "EagerEndOfTurn", "transcript": "c"}, {"type": "TurnInfo", "event": "TurnResumed", "transcript": "d"}, {"type": "X", "transcript": "e"}, {"type": "TurnInfo", "transcript": "  "}]
    frame = spark.createDataFrame([(json.dumps(e),) for e in events] + [("{bad",)], "value string")
    assert [r.text for r in transcripts.parse_turn_events(frame).collect()] == ["a", "b"]
    assert [r.text for r in transcripts.parse_turn_events(frame, eager=True).collect()] == ["a", "b", "c"]
    one = spark.createDataFrame([(1.0, "x")], "t double, text string")
    assert {(r.speaker, r.text) for r in transcripts.merged_streams({"ME": one, "THEM": one.limit(0)}).collect()} == {("ME", "x")}


def test_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "s")
    (tmp_path / "calls.jsonl").write_text('{"session_id": "a", "tick": 1, "stage": "gate", "error": "x"}\n')
    assert transcripts.read_calls(spark, str(tmp_path / "calls.jsonl")).first().answers == {}
    curves = spark.createDataFrame([("k", [0.0, 1.0], [0.1, 0.9], 0.8, 90, 0.2, 0.1, "keep")], "key string, xs array<double>, ys array<double>, accuracy double, n long, ece_before double, ece_after double, verdict string")
    transcripts.write_calibration(curves, path)
    assert transcripts.read_calibration(spark, path).collect() == curves.collect()
    (tmp_path / "a.jsonl").write_text('// x\n{"t": 2, "text": "é"}\n')
    assert transcripts.read_scripts(spark, str(tmp_path / "a.jsonl")).first().text == "é"
    rows = spark.createDataFrame([("s", "k", 0.5, 1)], "session_id string, key string, raw double, tick long")
    for _ in range(2):
        transcripts.write_samples(rows, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 2
    scored = transcripts.score_windows(rows, lambda pdf: pdf.assign(raw=pdf.raw * 2), rows.schema)
    assert scored.first().raw == 1.0


def test_context_drops_the_oldest(spark):
    said = spark.createDataFrame([("s", i, float(i), "ME", "x" * 10) for i in range(6)] + [("big", 0, 0.0, "ME", "y" * 99)], "session_id string, seq long, t double, speaker string, text string")
    ticks = spark.createDataFrame([("s", 0, 5.0), ("s", 1, 60.0), ("big", 0, 1.0)], "session_id string, tick long, t double")
    got = {(r.session_id, r.tick): r.lines for r in context.rolling_context(ticks, said, 45.0, 48).collect()}
    assert got[("s", 0)] == ["ME: " + "x" * 10] * 3 and got[("s", 1)] == [] and got[("big", 0)] == []
    assert context.rolling_context(ticks, said, 3.0, 3000).filter("session_id = 's' AND tick = 0").first().lines == ["ME: " + "x" * 10] * 4
    q = context.last_question(ticks, said.withColumn("text", F.concat("text", F.lit("? "), F.repeat(F.lit("z"), 90))), "?").orderBy("session_id", "tick").collect()
    assert len(q[1].last_question) == 90 and q[1].last_question.endswith("...") and q[2].last_question == ""
    assert context.tick_grid(said.filter("session_id = 's'"), 5.0).count() == 55


def test_default_deck(spark):
    keys = ["confusion", "interest", "floor:me", "floor:silence", "floor:overlap", "question_answered", "commitment", "commitment_bound", "decision_ready"]
    rows = [("s", 1, 1.0, "interest", False, 0.4, 0.0, 0.0, True, 0.5), ("s", 2, 2.0, "confusion", True, 0.7, 0.1, 0.0, True, 0.5), ("s", 3, 3.0, "floor:me", False, 0.9, 0.0, 0.8, True, 0.48), ("s", 4, 70.0, "commitment", True, 0.7, 0.0, 0.0, True, 0.5), ("s", 5, 80.0, "decision_ready", True, 0.7, 0.0, 0.0, True, 0.5)]
    samples = spark.createDataFrame(rows, "session_id string, tick long, t double, key string, fired boolean, ema double, slope double, integral30 double, warm boolean, fire double")
    wide = rules.wide_state(samples, keys)
    got = rules.cards(rules.cooled_down(rules.candidates(wide)))
    assert {(r.rule, r.tick) for r in got.collect()} == {("losing_them", 2), ("monologue", 3), ("monologue", 4), ("clean_commitment", 4), ("wrap_up", 5)} - {("clean_commitment", 4)}
    card = got.filter("rule = 'losing_them'").first()
    assert card.evidence == {"confusion": 0.7, "interest": 0.4} and card.severity == "alert"
    assert rules.floor_holder(wide).filter("tick = 3").first().floor == "me"
    shown = {r.tick: r for r in rules.frames(samples, keys, found=got).collect()}
    assert shown[2].cards == ["losing_them"] and {k: v.ema for k, v in shown[1].traces.items()} == {"interest": 0.4}


def test_quotas(spark):
    frame = lambda rows: spark.createDataFrame(rows, "session_id string, key string, t double, tick long, raw double")
    same = frame([("s", "k", float(i), i, 0.93) for i in range(500)])
    assert sampling.quota_sample(same, 5).count() == 5
    spread = sampling.quota_sample(frame([("s", "k", float(i), i, (i % 10) / 10 + 0.05) for i in range(200)]), 3)
    assert sampling.coverage(spread).first()[1:] == (30, 10)
    assert sampling.quota_sample(frame([("s", k, float(i), i, 0.5) for k in "abc" for i in range(10)]), 2).count() == 6
    assert sampling.quota_sample(frame([("s", "k", 0.0, 0, 1.0)]), 2).first().bin == 9
    assert sampling.sample_rows(spread).first().truth is None
    labels = spark.createDataFrame([("s", "k", 1, True)], "session_id string, key string, tick long, truth boolean")
    done = transcripts.merge_labels(sampling.sample_rows(spread), labels)
    assert sampling.label_progress(done, 1).first()[1:] == (1, 29, 30, True)
    assert sampling.label_queue(done, "k").count() == 29 and sampling.label_queue(done, "zz").count() == 0


def plain_fit(pairs, least):
    """Isotonic values at distinct raws by max-min averages (least = 1)."""
    xs = sorted({x for x, _ in pairs})
    n = [sum(x == v for v, _ in pairs) for x in xs]
    y = [sum(b for v, b in pairs if v == x) for x in xs]
    return {x: max(min(sum(y[j : k + 1]) / sum(n[j : k + 1]) for k in range(i, len(xs))) for j in range(i + 1)) for i, x in enumerate(xs)}


def test_isotonic_fit():
    rng = np.random.default_rng(2)
    raw = np.round(rng.random(80), 2)
    yes = (rng.random(80) < raw).astype(int)
    xs, n = np.unique(raw, return_counts=True)
    y = np.array([yes[raw == x].sum() for x in xs])
    got = isotonic.fit(xs, n, y, least=1, most_points=10_000)
    want = plain_fit(list(zip(raw.tolist(), yes.tolist())), 1)
    ends = {}
    for x, v in want.items():
        ends[round(v, 9)] = x
    for x, v in zip(*got):
        if 0 < x < 1:
            assert round(v, 9) in ends
    assert isotonic.fit(np.zeros(0), np.zeros(0), np.zeros(0)) == ([0.0, 1.0], [0.0, 1.0])
    many = np.arange(1, 2000) / 2000
    xs, ys = isotonic.fit(many, np.full(len(many), 100), (many * 100).astype(int), least=1)
    assert len(xs) <= 26 and ys == sorted(ys)
    # blocks of 10, 35, 50 and 5 rows, where each must have 40
    assert isotonic.cuts_of_weight(np.array([0.0, 10, 45, 95, 100]), 40).tolist() == [0, 2, 4]
    assert isotonic.cuts_of_weight(np.array([0.0, 10, 20]), 40).tolist() == [0, 2]


def test_apply_and_holdout(spark):
    curve = spark.createDataFrame([("k", [0.0, 0.2, 0.5, 0.5, 0.8], [0.1, 0.3, 0.4, 0.6, 0.9])], "key string, xs array<double>, ys array<double>")
    raws = [None, -1.0, 0.0, 0.1, 0.2, 0.5, 0.65, 0.8, 2.0]
    data = spark.createDataFrame([(i, "k", r, None) for i, r in enumerate(raws)] + [(99, "other", 0.37, 0.2)], "i long, key string, raw double, alt double")
    got = {r.i: (r.value, r.alt) for r in calibration.apply_curves(data, curve).collect()}
    assert [got[i][0] for i in range(9)] == pytest.approx([0.0, 0.1, 0.1, 0.2, 0.3, 0.4, 0.75, 0.9, 0.9])
    assert got[99] == (0.37, 0.2) and got[0][1] is None
    rnd = random.Random(1)
    rows = [(i, "over", 0.97, rnd.random() < 0.75) for i in range(400)] + [(1000 + i, "few", 0.5, True) for i in range(79)]
    found = {r.key: r for r in calibration.holdout_fit(spark.createDataFrame(rows, "i long, key string, raw double, truth boolean"), ["i"]).collect()}
    assert found["over"].verdict == "keep" and found["over"].ece_after < found["over"].ece_before and found["over"].xs
    assert found["few"].verdict == "too few" and found["few"].xs is None and found["few"].accuracy is None
    bounds = {r.key: r.bound for r in calibration.decision_bounds(ch.default_channels(spark)).collect()}
    assert bounds["commitment"] == 0.5 and bounds["objection:price"] == pytest.approx((0.74 + 0.065) / 2)
    again = calibration.with_accuracies(ch.default_channels(spark), spark.createDataFrame([("objection:price", 0.9), ("objection:trust", 0.8)], "key string, accuracy double"))
    assert again.filter("id = 'objection'").first().accuracy == 0.8


def test_meter(spark):
    rows = [("s", i, i * 0.5, "gate" if i % 2 else "bank", 100 + i, float(i), None) for i in range(50)]
    calls = spark.createDataFrame(rows, "session_id string, tick long, t double, stage string, input_tokens long, latency_ms double, error string")
    total = meter.totals(calls).first()
    assert total.calls == 50 and total.gate_open_rate == 1.0 and total.errors == 0
    single = sum(r[4] for r in rows if r[3] == "bank")
    assert total.gate_saving == pytest.approx((single - total.tokens) / single)
    assert tuple(meter.latency_percentiles(calls).first())[1:] == (25.0, 47.0)
    r = meter.rolling_rates(calls).filter("tick = 49").first()
    inside = [x for x in rows if 24.5 - x[2] <= 20]
    assert r.tokens_per_sec == pytest.approx(sum(x[4] for x in inside) / (24.5 - inside[0][2]))
    only = meter.totals(calls.filter("stage = 'gate'")).first()
    assert only.gate_saving == 0.0 and only.gate_open_rate == 0.0
    assert meter.budget_grid(calls).count() == 12


def test_evaluation(spark):
    cards = spark.createDataFrame([("a", "r", 5.0, 1), ("a", "r", 20.0, 2), ("b", "r", 22.0, 1)], "session_id string, rule string, t double, tick long")
    windows = spark.createDataFrame([("r", 15.0, 32.0)], "rule string, lo double, hi double")
    hits = evaluate.causal_hits(cards, windows)
    assert {tuple(r) for r in hits.collect()} == {("a", "r", 20.0, 1), ("b", "r", 22.0, 0)}
    assert tuple(evaluate.hit_summary(hits, cards).first()) == ("r", 2, pytest.approx(2**0.5), 0.5)


NAMES = ["trigger_edges", "card_cooldown", "gate_decisions", "context_window", "isotonic_curve", "truth_asof", "label_queue", "default_deck", "sloped_edges", "frames", "recorded_rows"]
NAMES += ["payload_questions", "thinned_curve", "holdout_verdict", "scripts", "turn_events", "call_log", "channel_specs", "relabelled", "stream_traces", "stream_sessions"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_against_sql(spark, name):
    from pathlib import Path

    from __spark_entry__ import _signals

    QUERIES, ORACLES = _signals()
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rows = con.sql(ORACLES[name])
    columns = sorted(rows.columns)
    want = sorted((tuple(dict(zip(rows.columns, r))[c] for c in columns) for r in rows.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(folder)).collect()), key=str)
    assert got == want


def test_saved_rows_are_swapped_in_whole(spark, tmp_path):
    path = str(tmp_path / "rows")
    old = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n long")
    transcripts.save_samples(old, path)
    rows = spark.read.schema("key string, n long").json(path)
    transcripts.save_samples(rows.withColumn("n", F.col("n") * 10), path)
    assert {tuple(r) for r in spark.read.schema("key string, n long").json(path).collect()} == {("a", 10), ("b", 20)}
    with pytest.raises(Exception):  # noqa: B017
        transcripts.save_samples(old.withColumn("n", F.raise_error(F.lit("broken"))), path)
    assert spark.read.schema("key string, n long").json(path).count() == 2
    assert [p.name for p in tmp_path.iterdir() if "." not in p.name] == ["rows"]


def test_label_queue_by_ranges(spark):
    rows = [("s", "hot" if i % 10 else "rare", (i * 7) % 100 / 100, i, None if i % 4 else True, i) for i in range(900)]
    frame = spark.createDataFrame(rows, "session_id string, key string, raw double, tick long, truth boolean, part long").repartition(5)
    got = sampling.label_queue(frame).collect()
    want = {}
    for r in sorted((r for r in rows if r[4] is None), key=lambda r: (r[1], r[2], r[0], r[3])):
        want.setdefault(r[1], []).append(r[3])
    assert {(r.key, r.tick): (r.place, r.remaining) for r in got} == {(k, t): (i + 1, len(v)) for k, v in want.items() for i, t in enumerate(v)}
    assert sampling.label_queue(frame.limit(0)).count() == 0
