"""The three workloads end to end: calls to cards, recordings to calibrated specs, calls and cards to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import channels as ch
from ..functions.scratch import checkpointed
from ..operators import answers, calibration, context, evaluate, gate, meter, rules, sampling, traces


def open_calls(gate_calls: DataFrame, bank_calls: DataFrame) -> DataFrame:
    """One row for each tick with the answers of both stages; the bank's only where the gate is open."""
    eventful = F.try_element_at("answers", F.lit("eventful"))["noul"]
    ticks = gate_calls.select("session_id", "tick", "t", eventful.alias("eventful"))
    return answers.merged_answers(gate_calls, gate.on_open_ticks(bank_calls, gate.gate_decisions(ticks)))


def measured(judgments: DataFrame, specs: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """Judgments (session_id, tick, t, key, raw, alt) to trace outputs with the measures that rules read."""
    rows = judgments.withColumn("value", F.coalesce("raw", F.lit(0.0))) if curves is None else calibration.apply_curves(judgments, curves)
    out = traces.run_traces(traces.with_specs(rows, specs))
    out = traces.ema_integral(traces.ema_slope(out.drop("slope"), 2.0, "slope"), 30.0, "integral30")
    about = specs.select("key", "fire", "silent")
    return out.join(about, "key").withColumn("fired", F.col("fired") & ~F.coalesce("silent", F.lit(False)))


def cards_from_judgments(judgments: DataFrame, specs: DataFrame, curves: DataFrame | None = None, utterances: DataFrame | None = None, deck=rules.DEFAULT_RULES) -> DataFrame:
    """Cards of all sessions. The keys of the wide state are those that the specs name, a short list."""
    keys = [r[0] for r in specs.select("key").distinct().orderBy("key").collect()]
    wide = rules.wide_state(measured(judgments, specs, curves), keys, deck=deck)
    hits = rules.cooled_down(rules.candidates(wide, deck))
    if utterances is not None:
        # sparse rows that are read twice below
        hits = checkpointed(hits)
        asked = context.last_question(hits.select("session_id", "tick", "t").distinct(), utterances)
        hits = hits.join(asked.select("session_id", "tick", "last_question"), ["session_id", "tick"], "left")
    return rules.cards(hits, deck)


def recalibrate(samples: DataFrame, channels: DataFrame, id_columns: list[str], rate_hz: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Labelled samples to fitted curves (with verdicts) and to specs derived from the measured accuracies."""
    pairs = samples.filter("truth IS NOT NULL")
    fitted = calibration.holdout_fit(pairs, id_columns, bounds=calibration.decision_bounds(channels))
    return fitted, ch.derive_specs(calibration.with_accuracies(channels, fitted), rate_hz)


def record(judgments: DataFrame, per_bin: int = 25) -> DataFrame:
    """The stratified rows to label."""
    return sampling.sample_rows(sampling.quota_sample(judgments, per_bin))


def report(ticks: DataFrame, calls: DataFrame, cards: DataFrame) -> DataFrame:
    """By session: activity, tokens, cost and latency."""
    rows = evaluate.session_report(ticks, calls, cards)
    return rows.join(meter.totals(calls).drop("calls"), "session_id", "left").join(meter.latency_percentiles(calls), "session_id", "left")
