"""Rules over the state of all traces at each tick, and the cards they raise.

The wide state has, for trace k, the columns ``k__ema``, ``k__fired``, ``k__slope``, ``k__integral30``, ``k__warm``, ``k__fire`` and ``k__in_band_for``
(a colon in a key becomes an underscore). A rule is a SQL condition over them; null counts as false.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import over_keys, run_starts, spaced
from ..functions.scratch import unused
from .asof import BUCKET_S, last_known
from .context import last_lines

MEASURES = ("ema", "slope", "integral30", "warm", "fire", "in_band_for")


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    body: str
    when: str
    refractory_s: float = 45.0
    severity: str = "nudge"
    evidence: tuple[str, ...] = ()


def _fired(key: str) -> str:
    return f"{column(key)}__fired"


def column(key: str) -> str:
    return key.replace(":", "_")


# Conditions, refractory seconds and severities of the default deck. Wordings are our own.
DEFAULT_RULES = (
    Rule("losing_them", "They drift away", "They follow less and care less. Ask what they took from it.", "confusion__fired AND coalesce(interest__ema, 0.5) < 0.5", 40, "alert", ("confusion", "interest")),
    Rule("confusion_only", "Go back a step", "They lost the thread just now. Return to the last agreed point.", "confusion__fired AND coalesce(interest__ema, 0.5) >= 0.5", 45, "nudge", ("confusion",)),
    Rule("hanging_question", "Open question", "{q} has no answer yet. Give one, or put it off openly.", "question_answered__fired", 50, "alert", ("question_answered",)),
    Rule("vague_commitment", "Who and when?", "A promise without a name or a date. Ask for both.", "commitment__fired AND coalesce(commitment_bound__ema, 1.0) < 0.45", 25, "alert", ("commitment", "commitment_bound")),
    Rule("clean_commitment", "Noted", "A promise with a name and a date.", "commitment__fired AND coalesce(commitment_bound__ema, 0.0) >= 0.45", 15, "info", ("commitment", "commitment_bound")),
    Rule("objection_price", "It costs too much", "Talk about what waiting costs.", "objection_price__fired", 45, "alert", ("objection:price",)),
    Rule("objection_timing", "Not now", "Ask what must happen first.", "objection_timing__fired", 45, "nudge", ("objection:timing",)),
    Rule("objection_authority", "Someone else decides", "Ask who, and what they need.", "objection_authority__fired", 45, "nudge", ("objection:authority",)),
    Rule("objection_trust", "They doubt it", "Show a proof.", "objection_trust__fired", 45, "alert", ("objection:trust",)),
    Rule("monologue", "Long turn", "You have talked for most of half a minute. Ask something.", "floor_me__integral30 > coalesce(floor_me__fire, 0.6) AND floor_me__ema > coalesce(floor_me__fire, 0.6) AND floor_me__warm", 60, "nudge", ("floor:me",)),
    Rule("awkward_silence", "Your turn", "It is quiet and the answer is yours.", "floor_silence__ema > coalesce(floor_silence__fire, 0.6) AND coalesce(question_answered__ema, 1.0) < 0.5", 30, "alert", ("question_answered",)),
    Rule("talking_over", "Two at once", "Let them finish.", "floor_overlap__fired", 20, "nudge", ("floor:overlap",)),
    Rule("repeating", "Said before", "This point is made. Go on.", "repetition__fired", 90, "nudge", ("repetition",)),
    Rule("drifted", "Another topic", "The talk left its topic a while ago.", "off_agenda__fired", 120, "nudge", ("off_agenda",)),
    Rule("check_that", "A fact to check", "A figure was named. Look it up.", "claim_checkable__fired", 25, "info", ("claim_checkable",)),
    Rule("wrap_up", "Ask for the decision", "All that is needed is there.", "decision_ready__fired AND coalesce(interest__slope, 0.0) <= 0", 150, "alert", ("decision_ready", "interest")),
)


def wide_state(samples: DataFrame, keys: list[str], ticks: DataFrame | None = None, bucket_s: float = BUCKET_S, deck=None) -> DataFrame:
    """One row for each session and tick: each trace's latest measures, and whether it fired at that very tick.

    ``samples`` has session_id, tick, t, key, fired and any of the measures; the keys are given, so one pass pivots them. ``ticks`` adds
    ticks without samples. With a ``deck``, only what its rules read is carried. Values are carried over buckets of ``bucket_s`` seconds, so a
    long session is no single task's.
    """
    measures, fires = read_by(deck, keys, [m for m in MEASURES if m in samples.columns])
    held = {k: f"{column(k)}__all" for k in keys if measures[k]}
    per_tick = [F.max(F.when(F.col("key") == k, F.struct("t", *measures[k]))).alias(name) for k, name in held.items()]
    fired = [F.max(F.when(F.col("key") == k, F.col("fired"))).alias(_fired(k)) for k in fires]
    rows = samples
    if ticks is not None:
        used = [m for m in MEASURES if any(m in own for own in measures.values())]
        rows = samples.select("session_id", "tick", "t", "key", "fired", *used).unionByName(ticks.select("session_id", "tick", "t"), allowMissingColumns=True)
    wide = rows.groupBy("session_id", "tick").agg(F.max("t").alias("t"), *per_tick, *fired)
    if held:
        wide = last_known(wide, list(held.values()), ("t", "tick"), bucket_s=bucket_s)
    out = [F.col(name)[m].alias(f"{column(k)}__{m}") for k, name in held.items() for m in measures[k]]
    return wide.select("session_id", "tick", "t", *out, *(F.coalesce(_fired(k), F.lit(False)).alias(_fired(k)) for k in fires))


def read_by(deck, keys: list[str], measures) -> tuple[dict[str, list[str]], list[str]]:
    """For each key the measures that the rules read, and the keys whose edges they read; all without a deck."""
    if deck is None:
        return {k: list(measures) for k in keys}, list(keys)
    read = {c for rule in deck for c in _columns_of(rule.when)} | {f"{column(k)}__ema" for rule in deck for k in rule.evidence}
    return {k: [m for m in measures if f"{column(k)}__{m}" in read] for k in keys}, [k for k in keys if _fired(k) in read]


def _columns_of(condition: str) -> set[str]:
    """The wide columns that a condition names."""
    return set(re.findall(r"\b\w+__(?:fired|ema|slope|integral30|warm|fire|in_band_for)\b", condition))


def candidates(wide: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Rows (session_id, tick, t, place, rule, refractory_s, evidence) for each rule that holds at a tick, in deck order. Evidence is the map of the
    rule's own smoothed values (0 for missing ones), so the wide state goes no further; of other columns ``last_question`` and ``ts`` stay.

    A rule over columns that the state lacks never holds.
    """
    marks, have = [], set(wide.columns)
    for place, rule in enumerate(rules):
        if not _columns_of(rule.when) <= have:
            continue
        pairs = [x for k in rule.evidence for x in (F.lit(k), F.coalesce(F.col(f"{column(k)}__ema"), F.lit(0.0)) if f"{column(k)}__ema" in have else F.lit(0.0))]
        evidence = F.create_map(*pairs).cast("map<string,double>").alias("evidence")
        marks.append(F.when(F.coalesce(F.expr(rule.when), F.lit(False)), F.struct(F.lit(place).alias("place"), F.lit(rule.id).alias("rule"), F.lit(float(rule.refractory_s)).alias("refractory_s"), evidence)))
    stay = [c for c in ("last_question", "ts") if c in have]
    if not marks:
        marks = [F.lit(None).cast(_HIT)]
    # a plain array of all rules, of which most are null: array_compact here would be written out in filters that Spark infers and compares at length
    rows = wide.select("session_id", "tick", "t", *stay, F.explode(F.array(*marks)).alias("hit")).filter("hit IS NOT NULL")
    return rows.select("session_id", "tick", "t", "hit.*", *stay)


_HIT = "struct<place:int,rule:string,refractory_s:double,evidence:map<string,double>>"


def cooled_down(hits: DataFrame) -> DataFrame:
    """Hits of each session and rule that are at least ``refractory_s`` (the same for all hits of a rule) after the one kept before. Rows stream; one
    number is carried."""
    rows = hits.repartition("session_id", "rule").sortWithinPartitions("session_id", "rule", "t", "tick")
    s, r, t, gap = (hits.columns.index(c) for c in ("session_id", "rule", "t", "refractory_s"))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, np.nan
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column(s).to_pylist(), batch.column(r).to_pylist(), strict=True))
            starts = run_starts(keys)
            times, gaps = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (t, gap))
            keep = over_keys(starts, lambda rows, since, t=times, g=gaps: spaced(t[rows], g[rows][0], since), last if keys[0] == now else np.nan)
            own = np.flatnonzero(keep[starts[-2] :])
            if len(own):
                last = times[starts[-2] + own[-1]]
            now = keys[-1]
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(thin, hits.schema)


def cards(kept: DataFrame, rules=DEFAULT_RULES, question: str = "last_question") -> DataFrame:
    """Cards: title, body with the question filled in, severity, t to 2 places and the evidence's smoothed values to 3."""
    q = F.coalesce(F.when(F.length(question) > 0, F.col(question)), F.lit("that question")) if question in kept.columns else F.lit("that question")
    by = {"title": F.lit(""), "body": F.lit(""), "severity": F.lit("nudge")}
    for rule in rules:
        is_it = F.col("rule") == rule.id
        by = {
            "title": F.when(is_it, rule.title).otherwise(by["title"]),
            "body": F.when(is_it, F.replace(F.lit(rule.body), F.lit("{q}"), q)).otherwise(by["body"]),
            "severity": F.when(is_it, rule.severity).otherwise(by["severity"]),
        }
    by["evidence"] = F.transform_values("evidence", lambda _, v: F.round(v, 3))
    return kept.select("session_id", "rule", *(c.alias(n) for n, c in by.items()), F.round("t", 2).alias("t"), "tick")


def recent_cards(found: DataFrame, most: int = 60) -> DataFrame:
    """The last cards of each session, once for each rule and tick."""
    order = Window.partitionBy("session_id").orderBy(F.desc("t"), F.desc("tick"), "rule")
    nth = unused(found, "nth")
    return found.dropDuplicates(["session_id", "rule", "tick"]).withColumn(nth, F.row_number().over(order)).filter(F.col(nth) <= most).drop(nth)


def floor_holder(wide: DataFrame, at: float = 0.42):
    """Who holds the floor at each tick: the watched option with the largest value over ``at``, the first of equals, else them."""
    options = [F.struct(F.col(f"floor_{o}__ema").alias("v"), F.lit(-i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(("me", "silence", "overlap"))]
    best = F.array_max(F.array(*options))
    return wide.withColumn("floor", F.when(best["v"] > at, best["o"]).otherwise("them"))


#: What a frame shows of each trace.
SHOWN = ("raw", "alt", "ema", "disagreement", "slope", "latched", "warm", "unreliable", "fire_count")


def frames(outputs: DataFrame, keys: list[str], gate: DataFrame | None = None, found: DataFrame | None = None, lines: DataFrame | None = None, meter: DataFrame | None = None, digits: int = 4, most_cards: int = 40, bucket_s: float = BUCKET_S) -> DataFrame:
    """A snapshot for each tick: ``traces``, a map of each trace to its latest sample at that tick (numbers to 4 places), and where given the
    gate's decision (``open``), that tick's cards, the last lines, and the meter as a struct of the other columns of its rows.

    ``outputs`` are trace outputs with session_id, tick, t, key and any of ``SHOWN``; the keys are a short list, so one pass pivots them.
    All parts meet by session and tick, which Spark shuffles once.
    """
    shown = [m for m in SHOWN if m in outputs.columns]
    rounded = [F.round(m, digits).alias(m) if m in ("raw", "alt", "ema", "disagreement", "slope") else F.col(m) for m in shown]
    latest = [F.max_by(F.when(F.col("key") == k, F.struct(*rounded)), F.when(F.col("key") == k, F.col("t"))).alias(f"trace{i}") for i, k in enumerate(keys)]
    wide = outputs.groupBy("session_id", "tick").agg(F.max("t").alias("t"), *latest)
    wide = last_known(wide, [f"trace{i}" for i in range(len(keys))], ("t", "tick"), bucket_s=bucket_s)
    pairs = [x for i, k in enumerate(keys) for x in (F.lit(k), F.col(f"trace{i}"))]
    out = wide.select("session_id", "tick", "t", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("traces"))
    at = ["session_id", "tick"]
    if gate is not None:
        out = out.join(gate.select(*at, "open"), at, "left")
    if found is not None:
        raised = found.groupBy(*at).agg(F.slice(F.sort_array(F.collect_list("rule")), 1, most_cards).alias("cards"))
        out = out.join(raised, at, "left").withColumn("cards", F.coalesce("cards", F.array().cast("array<string>")))
    if lines is not None:
        out = out.join(lines.select(*at, last_lines(F.col("lines"), 8).alias("transcript")), at, "left")
    if meter is not None:
        out = out.join(meter.select(*at, F.struct(*(c for c in meter.columns if c not in at)).alias("meter")), at, "left")
    return out
