"""End to end on a simulated conversation: a schedule of what is true, and a sensor that is right as often as each channel says."""

import json
import random

import pytest
from pyspark.sql import functions as F

from signalmill.functions import channels as ch
from signalmill.jobs import workloads
from signalmill.operators import evaluate, gate, meter
from signalmill.sources import transcripts

# (channel, from, to): when it is true (false for those that are watched for collapse)
SCHEDULE = [("floor:me", 8, 44), ("objection:price", 50, 66), ("confusion", 66, 84), ("commitment", 90, 100), ("claim_checkable", 16, 24)]
LOW_WHILE = {"interest": [(62, 90)], "question_answered": [(30, 50)], "commitment_bound": [(85, 105)]}
WINDOWS = [("monologue", 14.0, 50.0), ("objection_price", 47.0, 70.0), ("check_that", 15.0, 34.0), ("hanging_question", 30.0, 54.0)]


def simulated(seeds):
    channels = {row[0]: row for row in ch._BANK}
    rows = []
    for seed in seeds:
        rnd = random.Random(seed)
        last = -10.0
        for tick in range(116 * 5):
            t = tick / 5
            opened = t < 3 or t - last > 8 or rnd.random() < 0.4
            last = t if opened else last
            for name, row in channels.items():
                if row[2] == "bank" and not opened:
                    continue
                for option in row[6] or (None,):
                    key = name if option is None else f"{name}:{option}"
                    hit, miss = {"choice": (0.74, 0.26 / (max(len(row[5]), 2) - 1)), "score": (0.82, 0.18)}.get(row[1], (0.9, 0.1))
                    truth = any(k == key and a <= t < b for k, a, b in SCHEDULE)
                    if name in ("interest", "question_answered", "commitment_bound", "off_agenda"):
                        truth = not any(a <= t < b for a, b in LOW_WHILE.get(name, []))
                    draw = lambda: hit if (rnd.random() < row[7]) == truth else miss  # noqa: B023,E731
                    rows.append((f"s{seed}", tick, t, key, draw(), draw()))
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rows = simulated(range(6))
    judgments = spark.createDataFrame(rows, "session_id string, tick long, t double, key string, raw double, alt double")
    said = spark.createDataFrame([(f"s{s}", 0, 28.0, "THEM", "And when would that be?") for s in range(6)], "session_id string, seq long, t double, speaker string, text string")
    specs = ch.derive_specs(ch.default_channels(spark))
    return workloads.cards_from_judgments(judgments, specs, utterances=said).cache(), judgments


def test_cards_come_after_their_cause_and_in_time(spark, found):
    cards, _ = found
    windows = spark.createDataFrame(WINDOWS, "rule string, lo double, hi double")
    hits = {r.rule: r for r in evaluate.hit_summary(evaluate.causal_hits(cards, windows), found[1]).collect()}
    assert hits["monologue"].hits >= 5 and hits["objection_price"].hits >= 4 and hits["hanging_question"].hits >= 4
    assert all(r.early_mean <= 0.2 for r in hits.values())
    assert cards.filter("rule IN ('drifted', 'talking_over')").count() == 0
    question = cards.filter("rule = 'hanging_question'").select("body").first()[0]
    assert question.startswith("And when would that be?") or question.startswith("that question")


def test_few_ticks_speak(found):
    cards, judgments = found
    ticks = judgments.select("session_id", "tick", "t").distinct()
    rows = evaluate.session_report(ticks, ticks, cards).collect()
    assert all(r.speak_rate < 0.04 and 3 <= r.cards <= 20 for r in rows)


def test_recalibration(spark, found):
    _, judgments = found
    truth = F.when(F.col("key") == "floor:me", F.col("t").between(8, 44)).when(F.col("key") == "eventful", F.lit(False))
    kept = workloads.record(judgments, 40)
    assert kept.filter("truth IS NOT NULL").count() == 0
    labelled = kept.withColumn("truth", truth)
    fitted, specs = workloads.recalibrate(labelled, ch.default_channels(spark), ["session_id", "tick", "key"])
    verdicts = {r.key: r for r in fitted.collect()}
    assert set(verdicts) == {"floor:me", "eventful"} and all(r.verdict in ("keep", "drop") for r in verdicts.values())
    assert verdicts["floor:me"].accuracy > 0.5
    floor = specs.filter("key = 'floor:me'").first()
    assert floor.status == "ok" and floor.tau > 0


def test_gate_then_bank(spark):
    answer = lambda **a: json.dumps(a)
    rows = [("s", i, i / 5, answer(eventful={"noul": 0.9 if i == 40 else 0.1}), answer(commitment={"noul": 0.5})) for i in range(60)]
    calls = spark.createDataFrame(rows, "session_id string, tick long, t double, g string, b string")
    part = lambda c: calls.select("session_id", "tick", "t", F.from_json(c, transcripts.ANSWERS).alias("answers"))
    merged = workloads.open_calls(part("g"), part("b"))
    opened = sorted(r.tick for r in merged.filter(F.map_contains_key("answers", F.lit("commitment"))).collect())
    assert opened == [*range(15), 40] and merged.count() == 60
    assert gate.gate_decisions(part("g").select("session_id", "tick", "t", F.lit(None).cast("double").alias("eventful"))).filter("open").count() == 16
    usage = spark.createDataFrame([("s", i, i / 5, "gate" if i % 2 else "bank", 100, 50.0 + i, None) for i in range(20)], "session_id string, tick long, t double, stage string, input_tokens long, latency_ms double, error string")
    r = workloads.report(usage, usage, usage.limit(0).withColumn("rule", F.lit("x"))).first()
    assert r.cards == 0 and r.tokens == 2000 and r.p50_ms == 60.0 and r.spent == pytest.approx(2000 / 1e6 * meter.PRICE)
