"""Structured Streaming jobs: traces and edges, whole sessions with the rule deck, exact rates, quotas, sliding rates, card replay.

The stateful jobs run on ``transformWithStateInPandas`` (processors in ``processors.py``), which needs the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass`` names it when a query starts; ``on_rocksdb`` sets it for a block of code. Groups are hash buckets of
sessions and keys, so a micro-batch makes one Python call a bucket, however many traces it has. State is kept in one value of bytes for each block of
names in a bucket.

Every state ends: event time is ``ts`` or, where there is no such column, ``t`` seconds after a day in 1970; rows later than the watermark are left
out, and what has had no row for ``idle`` after its last one is removed once the watermark is past that. Rows without a session or key are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import trace as core
from ..operators import meter, rules
from ..operators.sampling import bin_of
from . import processors

#: Records of a bucket's state, by hash of the name. A call of the store takes about half a millisecond, however long a record is.
_BLOCKS = 16
#: Watermarks begin at 1970, so that a time of 0 must lie beyond it.
_DAY = 86_400
_OUT = "session_id string, key string, t double, tick long, value double, ema double, disagreement double, in_band_for double, warm boolean, unreliable boolean, fired boolean, latched boolean, fire_count long"


@dataclass(frozen=True)
class Ends:
    """late: how far the watermark is behind the newest row. idle_s: seconds without a row after which a state is removed. buckets: groups that
    states are dealt into, some for each task (as many as the session's shuffle partitions, if none is given); a bucket's rows of a micro-batch and their
    states are in a task's memory together."""

    late: str = "1 minute"
    idle_s: float = 3600.0
    buckets: int | None = None


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Sets a setting of the session for this block; the one before comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def on_rocksdb(spark: SparkSession):
    """Queries that start in this block keep their state in RocksDB."""
    return setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _event_time(rows: DataFrame):
    return F.col("ts") if "ts" in rows.columns else F.timestamp_micros(((F.col("t") + _DAY) * 1_000_000).cast("long"))


def _bucket(rows: DataFrame, ends: Ends, *keys: str) -> DataFrame:
    count = ends.buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumns({"bucket": F.pmod(F.hash(*keys), F.lit(count)), "block": F.pmod(F.xxhash64(*keys), F.lit(_BLOCKS)).cast("int")})


def _numbers(*names: str) -> list:
    return [F.col(c).cast("double").alias(c) for c in names]


def _keyed(*names: str) -> list:
    return [F.col(c).cast("string").alias(c) for c in names]


def _tick():
    return F.col("tick").cast("long").alias("tick")


def stream_traces(judgments: DataFrame, ends: Ends = Ends()) -> DataFrame:
    """The trace recurrence on a stream of judgments that carry their spec columns.

    Rows of a micro-batch are taken in order of t; one that is older than what the trace has seen moves no average, as
    in the batch job. State is one small record for each trace.
    """
    rows = judgments.select(*_keyed("session_id", "key"), _tick(), *_numbers("t", "value", "alt", *core.SPEC), _event_time(judgments).alias("ts"))
    rows = _bucket(rows.filter("session_id IS NOT NULL AND key IS NOT NULL AND t IS NOT NULL AND value IS NOT NULL").withWatermark("ts", ends.late), ends, "session_id", "key")
    return rows.groupBy("bucket").transformWithStateInPandas(processors.Traces(ends.idle_s), _OUT, "Append", "EventTime")


def stream_quota(judgments: DataFrame, per_bin: int = 25, bins: int = 10, ends: Ends = Ends()) -> DataFrame:
    """The first ``per_bin`` rows of each session, key and bin as they arrive; the state is one count."""
    rows = judgments.select(*_keyed("session_id", "key"), bin_of(F.col("raw"), bins).cast("long").alias("bin"), _tick(), *_numbers("t", "raw"), _event_time(judgments).alias("ts"))
    rows = _bucket(rows.filter("session_id IS NOT NULL AND key IS NOT NULL AND bin IS NOT NULL").withWatermark("ts", ends.late), ends, "session_id", "key", "bin")
    return rows.groupBy("bucket").transformWithStateInPandas(processors.Quotas(ends.idle_s, per_bin), "session_id string, key string, bin long, t double, tick long, raw double", "Append", "EventTime")


def stream_states(judgments: DataFrame, keys: list[str], deck=rules.DEFAULT_RULES, utterances: DataFrame | None = None, ends: Ends = Ends(), mark: str = "?", question_s: float = 45.0, slope_s: float = 2.0, integral_s: float = 30.0) -> DataFrame:
    """The wide state of whole sessions as the deck reads it, a row for each session and tick, with ``last_question`` and ``ts``.

    Judgments carry their spec columns and may have ``silent``. The state of a session is its traces, the samples that the
    slope and the 30 s average reach back to, and its last question. A tick is told once for each micro-batch that brings rows of it.
    """
    measures, fires = rules.read_by(deck, keys, rules.MEASURES)
    silent = F.coalesce(F.col("silent"), F.lit(False)) if "silent" in judgments.columns else F.lit(False)
    rows = judgments.select(*_keyed("session_id", "key"), _tick(), *_numbers("t", "value", "alt", *core.SPEC), silent.alias("silent"), F.lit(None).cast("string").alias("text"), _event_time(judgments).alias("ts"))
    rows = rows.filter("session_id IS NOT NULL AND key IS NOT NULL AND tick IS NOT NULL AND t IS NOT NULL AND value IS NOT NULL")
    if utterances is not None:
        asked = utterances.filter(F.contains("text", F.lit(mark)) & F.col("session_id").isNotNull() & F.col("t").isNotNull())
        rows = rows.unionByName(asked.select(*_keyed("session_id"), *_numbers("t"), F.trim("text").alias("text"), _event_time(utterances).alias("ts")), allowMissingColumns=True)
    columns = {k: rules.column(k) for k in keys}
    kinds = {"warm": "boolean"}
    wide = ["session_id string", "tick long", "t double", "ts timestamp"]
    for k in dict.fromkeys((*measures, *fires)):
        wide += [f"{columns[k]}__fired boolean"] * (k in fires) + [f"{columns[k]}__{m} {kinds.get(m, 'double')}" for m in measures.get(k, ())]
    processor = processors.Sessions(ends.idle_s, measures, fires, columns, slope_s, integral_s, question_s, 90)
    dealt = _bucket(rows.withWatermark("ts", ends.late), ends, "session_id")
    return dealt.groupBy("bucket").transformWithStateInPandas(processor, ", ".join([*wide, "last_question string"]), "Append", "EventTime", eventTimeColumnName="ts")


def stream_sessions(judgments: DataFrame, keys: list[str], deck=rules.DEFAULT_RULES, utterances: DataFrame | None = None, ends: Ends = Ends(), **options) -> DataFrame:
    """Cards of whole sessions on a stream, as ``workloads.cards_from_judgments`` gives them: the SQL deck over the latest state of all traces at
    each tick, its cooldowns, bodies with the last question, and evidence. Two stateful steps, the rules between them being plain SQL. Options are those of
    ``stream_states``."""
    hits = rules.candidates(stream_states(judgments, keys, deck, utterances, ends, **options), deck)
    # a map crosses to Python and back as JSON
    flat = _bucket(hits.withColumn("evidence", F.to_json("evidence")), ends, "session_id", "rule")
    schema = "session_id string, tick long, t double, place int, rule string, refractory_s double, evidence string, last_question string, ts timestamp"
    kept = flat.groupBy("bucket").transformWithStateInPandas(processors.Cooldowns(ends.idle_s), schema, "Append", "EventTime", eventTimeColumnName="ts")
    return rules.cards(kept.withColumn("evidence", F.from_json("evidence", "map<string,double>")), deck)


def stream_meter(calls: DataFrame, window_s: float = 20.0, ends: Ends = Ends()) -> DataFrame:
    """For each call the rates over the trailing window, exactly as ``meter.rolling_rates``: session_id, tick, t and the rates. A call is told when the
    watermark has passed it, so none that counts is still to come."""
    rows = calls.select(*_keyed("session_id"), _tick(), *_numbers("t"), F.coalesce(F.col("input_tokens").cast("double"), F.lit(0.0)).alias("tokens"), _event_time(calls).alias("ts"))
    rows = _bucket(rows.filter("session_id IS NOT NULL AND t IS NOT NULL").withWatermark("ts", ends.late), ends, "session_id")
    sums = rows.groupBy("bucket").transformWithStateInPandas(processors.Meter(max(ends.idle_s, window_s), window_s), "session_id string, tick long, t double, tokens double, calls long, oldest double", "Append", "EventTime")
    return meter.rates(sums, F.col("tokens"), F.col("calls"), F.col("oldest")).drop("tokens", "calls", "oldest")


def stream_rates(calls: DataFrame, late: str = "10 seconds", window: str = "20 seconds", step: str = "1 second") -> DataFrame:
    """Tokens and calls of each session in windows that slide by a second; rows later than the watermark are left out."""
    rows = calls.withWatermark("ts", late).groupBy(F.window("ts", window, step), "session_id")
    return rows.agg(F.sum("input_tokens").alias("tokens"), F.count("*").alias("calls"))


def stream_cards_once(cards: DataFrame, late: str = "1 minute") -> DataFrame:
    """Cards without replays of the same session, rule and tick."""
    return cards.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "rule", "tick"])
