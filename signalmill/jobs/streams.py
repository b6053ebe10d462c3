"""Registered queries of the streams: the events are read as a stream, to its end, and must give what the batch jobs give."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import checkpointed, remove_folder, scratch_folder
from ..operators.rules import Rule
from ..streaming import traces as streams
from .queries import _BIN, _HOURS, _J, _TRACE, specs

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str):
    """Registers a function as a query of its name."""

    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


#: Micro-batches that the events are read in.
BATCHES = 4
#: Rows of a micro-batch that are to meet in one group.
GROUP_ROWS = 25_000


def _to_the_end(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """What a streaming job over the events has written when it has read them all, in micro-batches of rising time: ``make`` takes the stream and how
    many buckets keep its groups small. Each arrival is written by all tasks, and the job goes on from its checkpoint to read it."""
    # event time as an instant, whatever the session's time zone
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.timestamp_micros(micros))
    folder = scratch_folder(spark)
    low, high, rows = events.agg(F.min(micros), F.max(micros), F.count("*")).first()
    part = F.least(F.floor((micros - low) * BATCHES / (high - low + 1)), F.lit(BATCHES - 1)) if low is not None else F.lit(0)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / BATCHES / GROUP_ROWS))
    last = BATCHES - 1 if low is not None else 0
    for k in range(last + 1):
        events.filter(part == k).write.mode("append").parquet(f"{folder}/in")
        out = make(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), buckets)
        writer = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        # timers of the last arrival run in a batch of their own, others in that of the next
        with streams.on_rocksdb(spark), streams.setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", str(k == last).lower()):
            query = writer.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    found = checkpointed(spark.read.schema(out.schema).parquet(f"{folder}/out"))
    remove_folder(spark, folder)
    return found


def _judgments(events: DataFrame) -> DataFrame:
    """Events as judgments without a second wording."""
    return events.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("key"), F.expr(_HOURS).alias("t"), F.col("event_id").alias("tick"), (1 - F.exp(-F.col("value") / 50)).alias("raw"), F.lit(None).cast("double").alias("alt"), "ts")


def _with_specs(spark: SparkSession, events: DataFrame) -> DataFrame:
    return _judgments(events).withColumn("value", F.col("raw")).join(specs(spark), "key")


# no second wording
_ALONE = _TRACE.replace("lag(1 - exp(-value / 50)) OVER (PARTITION BY user_id ORDER BY ts, event_id)", "CAST(NULL AS DOUBLE)")


@_query(_ALONE + "SELECT CAST(session_id AS VARCHAR) AS session_id, key, tick, round(ema, 6) AS ema, fired, latched, fire_count FROM r")
def stream_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _to_the_end(spark, sf_dir, lambda e, n: streams.stream_traces(_with_specs(spark, e), streams.Ends(idle_s=90 * 86_400.0, buckets=n)))
    return rows.select("session_id", "key", "tick", F.round("ema", 6).alias("ema"), "fired", "latched", "fire_count")


@_query(
    _ALONE
    + """, x AS (SELECT *, coalesce(greatest(t - lag(t) OVER o, 0), 0) AS dt, coalesce(greatest(t - lag(t) OVER o, 0) * (ema + lag(ema) OVER o) / 2, 0) AS term, CAST(round(t * 1000000) AS BIGINT) AS us
  FROM r WINDOW o AS (PARTITION BY session_id, key ORDER BY t, tick)),
y AS (SELECT *, sum(term) OVER w - first_value(term) OVER w AS area, sum(dt) OVER w - first_value(dt) OVER w AS span FROM x WINDOW w AS (PARTITION BY session_id, key ORDER BY us RANGE BETWEEN 200000000 PRECEDING AND CURRENT ROW)),
b AS (SELECT session_id, tick, t, fired AND key = 'view' AS viewed, last_value(CASE WHEN key = 'error' THEN ema END IGNORE NULLS) OVER o AS error, last_value(CASE WHEN key = 'click' THEN ema END IGNORE NULLS) OVER o AS click,
    last_value(CASE WHEN key = 'view' THEN ema END IGNORE NULLS) OVER o AS view, last_value(CASE WHEN key = 'view' THEN CASE WHEN span > 1e-9 THEN area / span ELSE 0 END END IGNORE NULLS) OVER o AS view_average,
    last_value(CASE WHEN key = 'view' THEN warm END IGNORE NULLS) OVER o AS view_warm
  FROM y WINDOW o AS (PARTITION BY session_id ORDER BY t, tick ROWS UNBOUNDED PRECEDING)),
h AS (SELECT session_id, tick, t, 'viewed' AS rule, 30 AS gap, view AS shown FROM b WHERE viewed UNION ALL SELECT session_id, tick, t, 'few_errors', 100, error FROM b WHERE error < 0.45 AND click > 0.6
  UNION ALL SELECT session_id, tick, t, 'long_view', 60, view FROM b WHERE view_average > 0.55 AND view_warm),
a AS (SELECT *, row_number() OVER (PARTITION BY session_id, rule ORDER BY t, tick) AS i FROM h),
c AS (
  SELECT session_id, rule, i, t, tick, true AS keep, t AS last, shown FROM a WHERE i = 1
  UNION ALL
  SELECT a.session_id, a.rule, a.i, a.t, a.tick, a.t - c.last >= a.gap, CASE WHEN a.t - c.last >= a.gap THEN a.t ELSE c.last END, a.shown FROM c JOIN a ON a.session_id = c.session_id AND a.rule = c.rule AND a.i = c.i + 1
) SELECT CAST(session_id AS VARCHAR) AS session_id, rule, tick, round(t, 2) AS t, CASE rule WHEN 'viewed' THEN 'alert' ELSE 'info' END AS severity, round(shown, 3) AS shown FROM c WHERE keep"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL rules over several traces of whole sessions, one on an average over time, with cooldowns and evidence."""
    deck = (
        Rule("viewed", "", "", "view__fired", 30, "alert", ("view",)),
        Rule("few_errors", "", "", "error__ema < 0.45 AND click__ema > 0.6", 100, "info", ("error",)),
        Rule("long_view", "", "", "view__integral30 > 0.55 AND view__warm", 60, "info", ("view",)),
    )
    rows = _to_the_end(spark, sf_dir, lambda e, n: streams.stream_sessions(_with_specs(spark, e), ["click", "error", "purchase", "signup", "view"], deck, ends=streams.Ends(idle_s=90 * 86_400.0, buckets=n), integral_s=200.0))
    return rows.select("session_id", "rule", "tick", "t", "severity", F.element_at(F.map_values("evidence"), 1).alias("shown"))


@_query(
    f"""WITH {_J}, c AS (SELECT session_id, tick, t, CAST(round(t * 1000000) AS BIGINT) AS us, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS tokens, ts FROM j JOIN events e ON e.event_id = j.tick),
s AS (SELECT *, sum(tokens) OVER w AS total, count(*) OVER w AS n, greatest(t - min(t) OVER w, 0.001) AS span FROM c WINDOW w AS (PARTITION BY session_id ORDER BY us RANGE BETWEEN 200000000 PRECEDING AND CURRENT ROW))
SELECT CAST(session_id AS VARCHAR) AS session_id, tick, round(total / span, 6) AS tokens_per_sec, round(n / span * 60, 6) AS requests_per_min, round(total / span * 3600 / 1e6 * 0.042, 6) AS dollars_per_hour
FROM s WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events) - 3600000"""
)
def stream_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact rates of 200 hours at each call that the watermark, an hour behind the last event, has passed."""
    tokens = F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("input_tokens")
    calls = lambda e: e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("tick"), F.expr(_HOURS).alias("t"), tokens, "ts")
    rows = _to_the_end(spark, sf_dir, lambda e, n: streams.stream_meter(calls(e), 200.0, streams.Ends("1 hour", 90 * 86_400.0, n)))
    return rows.select("session_id", "tick", *(F.round(c, 6).alias(c) for c in ("tokens_per_sec", "requests_per_min", "dollars_per_hour")))


@_query(f"WITH {_J} SELECT CAST(session_id AS VARCHAR) AS session_id, key, CAST(bin AS BIGINT) AS bin, tick FROM (SELECT *, {_BIN} AS bin, row_number() OVER (PARTITION BY session_id, key, {_BIN} ORDER BY t, tick) AS n FROM j) WHERE n <= 2")
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _to_the_end(spark, sf_dir, lambda e, n: streams.stream_quota(_judgments(e), 2, ends=streams.Ends(idle_s=90 * 86_400.0, buckets=n)))
    return rows.select("session_id", "key", "bin", "tick")


@_query(
    """WITH e AS (SELECT user_id AS session_id, epoch_us(ts) // 86400000000 AS day, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS tokens FROM events),
w AS (SELECT session_id, day - i AS day, tokens FROM e, range(0, 2) r(i))
SELECT session_id, day, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS calls FROM w WHERE day + 2 < (SELECT max(epoch_us(ts)) // 86400000000 - 1 FROM events) GROUP BY session_id, day"""
)
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two days at a time, by days; windows that the watermark closed well before the last event."""
    tokens = F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("input_tokens")
    rows = _to_the_end(spark, sf_dir, lambda e, n: streams.stream_rates(e.select(F.col("user_id").alias("session_id"), "ts", tokens), "1 hour", "2 days", "1 day"))
    day = F.floor(F.unix_micros(F.col("window.start")) / 86_400_000_000).cast("long")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(max(ts) AS TIMESTAMP_NTZ))")
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg((F.floor(micros / 86_400_000_000) - 1).cast("long").alias("last"))
    return rows.select("session_id", day.alias("day"), "tokens", "calls").crossJoin(last).filter("day + 2 < last").drop("last")


@_query("SELECT DISTINCT user_id AS session_id, event_type AS rule, CAST(floor(value / 10) AS BIGINT) AS tick FROM events")
def stream_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that came more than once, each kept once: a user's events of one type and about the same value stand for replays."""
    cards = lambda e: e.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("rule"), F.floor(F.col("value") / 10).cast("long").alias("tick"), "ts")
    return _to_the_end(spark, sf_dir, lambda e, n: streams.stream_cards_once(cards(e), "90 days")).select("session_id", "rule", "tick")
