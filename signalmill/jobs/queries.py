"""Registered queries for the signal operators, each with the DuckDB SQL of the same result where SQL can state it.

The given tables stand in for the library's own: ``events`` are judgments and model calls (session: user, key: event type,
hours for seconds), ``conversations`` are utterances, ``labels`` with ``documents`` are labelled samples. Floats are rounded to
six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import channels as ch
from ..operators import answers, calibration, context, evaluate, gate, long_traces, meter, rules, sampling, traces
from ..sources import transcripts

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str):
    """Registers a function as a query of its name."""

    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


# ---- events as judgments and as calls

_HOURS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) / 3.6e9"
_J = """
j AS (
  SELECT user_id AS session_id, event_type AS key, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t, event_id AS tick,
    1 - exp(-value / 50) AS raw, lag(1 - exp(-value / 50)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS alt
  FROM events
)"""
_SPECS = (
    ("click", 0.60, 0.45, 1.0, 30.0, 0.0, 60.0, 60.0, 0.30),
    ("view", 0.55, 0.45, 1.0, 20.0, 10.0, 40.0, 40.0, 0.35),
    ("signup", 0.40, 0.55, -1.0, 25.0, 5.0, 50.0, 50.0, 0.40),
    ("purchase", 0.58, 0.42, 1.0, 40.0, 0.0, 30.0, 80.0, 0.30),
    ("error", 0.45, 0.55, -1.0, 15.0, 0.0, 100.0, 30.0, 0.32),
)
_S = f"s(key, fire, release, polarity, tau, dwell, refractory, warmup, unreliable_at) AS (VALUES {', '.join(map(str, _SPECS))})"


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as judgments; alt is the session's judgment before."""
    from pyspark.sql import Window

    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("key"), F.expr(_HOURS).alias("t"), F.col("event_id").alias("tick"), (1 - F.exp(-F.col("value") / 50)).alias("raw"))
    return rows.withColumn("alt", F.lag("raw").over(Window.partitionBy("session_id").orderBy("t", "tick")))


def specs(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(_SPECS), "key string, fire double, release double, polarity double, tau double, dwell double, refractory double, warmup double, unreliable_at double")
    return traces.default_specs(rows)


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.run_traces(traces.with_specs(judgments(spark, sf_dir).withColumn("value", F.col("raw")), specs(spark)))


_TRACE = f"""
WITH RECURSIVE {_J}, {_S},
o AS (
  SELECT j.*, s.* EXCLUDE (key), row_number() OVER w AS rn, min(t) OVER (PARTITION BY session_id, j.key) AS t0
  FROM j JOIN s ON j.key = s.key WINDOW w AS (PARTITION BY session_id, j.key ORDER BY t, tick)
),
n AS (
  SELECT *, 0 AS step, raw AS ema, abs(raw - alt) AS dis, CASE WHEN polarity * raw >= polarity * fire THEN t END AS since,
    false AS was, CAST(NULL AS DOUBLE) AS cooled, CAST(0 AS BIGINT) AS counted
  FROM o WHERE rn = 1
),
f AS (
  SELECT *, since IS NOT NULL AND t - since >= dwell AND t - t0 >= warmup AS edge FROM n
),
r AS (
  SELECT session_id, key, t, tick, rn, ema, dis, since, edge AND NOT coalesce(dis > unreliable_at, false) AS fired,
    edge AND NOT polarity * ema <= polarity * release AS latched,
    CASE WHEN edge AND NOT coalesce(dis > unreliable_at, false) THEN t END AS last_fire,
    CAST(edge AND NOT coalesce(dis > unreliable_at, false) AS BIGINT) AS fire_count, t - t0 >= warmup AS warm
  FROM f
  UNION ALL
  SELECT session_id, key, t, tick, rn, ema, dis, since, fired, (was OR edge) AND NOT polarity * ema <= polarity * release,
    CASE WHEN fired THEN t ELSE last_fire END, fire_count + CAST(fired AS BIGINT), warm
  FROM (
    SELECT *, edge AND NOT coalesce(dis > unreliable_at, false) AS fired FROM (
      SELECT *, since IS NOT NULL AND t - since >= dwell AND (last_fire IS NULL OR t - last_fire >= refractory) AND warm AND NOT was AS edge FROM (
        SELECT *, CASE WHEN polarity * ema >= polarity * fire THEN coalesce(old_since, t) END AS since FROM (
          SELECT o.session_id, o.key, o.t, o.tick, o.rn, o.fire, o.release, o.polarity, o.dwell, o.refractory, o.unreliable_at,
            r.ema + (1 - exp(-(o.t - r.t) / o.tau)) * (o.raw - r.ema) AS ema,
            CASE WHEN o.alt IS NULL THEN r.dis WHEN r.dis IS NULL THEN abs(o.raw - o.alt)
              ELSE r.dis + (1 - exp(-(o.t - r.t) / (3 * o.tau))) * (abs(o.raw - o.alt) - r.dis) END AS dis,
            r.since AS old_since, r.latched AS was, r.last_fire, r.fire_count, o.t - o.t0 >= o.warmup AS warm
          FROM r JOIN o ON o.session_id = r.session_id AND o.key = r.key AND o.rn = r.rn + 1
        )
      )
    )
  )
)
"""


@_query(_TRACE + "SELECT session_id, key, tick, round(t, 6) AS t, round(ema, 6) AS ema FROM r")
def trace_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs(spark, sf_dir).select("session_id", "key", "tick", *_r("t", "ema"))


@_query(_TRACE + "SELECT session_id, r.key, tick, round(dis, 6) AS disagreement, coalesce(dis > unreliable_at, false) AS unreliable FROM r JOIN s ON r.key = s.key")
def trace_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs(spark, sf_dir).select("session_id", "key", "tick", *_r("disagreement"), "unreliable")


@_query(_TRACE + "SELECT session_id, key, tick, round(t, 6) AS t, fire_count FROM r WHERE fired")
def trigger_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.fired_edges(outputs(spark, sf_dir)).select("session_id", "key", "tick", *_r("t"), "fire_count")


@_query(_TRACE + "SELECT session_id, r.key, tick, CASE WHEN coalesce(dis > unreliable_at, false) THEN 'ill-posed' WHEN NOT warm THEN 'warming' WHEN latched THEN 'latched' ELSE 'armed' END AS status FROM r JOIN s ON r.key = s.key")
def trace_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = traces.trace_status(F.col("unreliable"), F.col("warm"), F.col("latched"))
    return outputs(spark, sf_dir).select("session_id", "key", "tick", status.alias("status"))


@_query(
    _TRACE
    + """SELECT session_id, key, fire_count, string_agg(printf('%.2f:%.4f', t2, e2), ',' ORDER BY t, tick) AS series FROM (
  SELECT session_id, key, t, tick, round(t, 2) AS t2, round(ema, 4) AS e2, max(fire_count) OVER (PARTITION BY session_id, key) AS fire_count,
    row_number() OVER (PARTITION BY session_id, key ORDER BY t DESC, tick DESC) AS n FROM r) WHERE n <= 10 GROUP BY session_id, key, fire_count"""
)
def session_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces.session_export(outputs(spark, sf_dir), specs(spark).select("key", "tau"), 10)
    points = F.array_join(F.transform("series", lambda p: F.format_string("%.2f:%.4f", p["t"], p["ema"])), ",")
    # the last points' count of fires is the greatest, as counts never fall
    return rows.select("session_id", "key", "fire_count", points.alias("series"))


# all users as one session
_ONE = _TRACE.replace("SELECT user_id AS session_id", "SELECT CAST(0 AS BIGINT) AS session_id")


@_query(
    _ONE
    + """SELECT session_id, key, tick, round(ema, 6) AS ema, round(dis, 6) AS disagreement, round(CASE WHEN since IS NULL THEN 0 ELSE t - since END, 6) AS in_band_for, warm, fired, latched, fire_count
FROM r"""
)
def trace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of one long session, over tasks by ranges of time of some five rows a trace and range at the smallest scale."""
    rows = judgments(spark, sf_dir).withColumns({"session_id": F.lit(0).cast("long"), "value": F.col("raw")})
    done = long_traces.run_long_traces(traces.with_specs(rows, specs(spark)), 64)
    return done.select("session_id", "key", "tick", *_r("ema", "disagreement", "in_band_for"), "warm", "fired", "latched", "fire_count")


_V = f"WITH {_J}, v AS (SELECT *, raw AS ema, CAST(round(t * 1000000) AS BIGINT) AS us FROM j)"


def _raw_as_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).withColumn("ema", F.col("raw"))


@_query(
    _V
    + """SELECT session_id, key, tick, round(CASE WHEN count(*) OVER w >= 3 AND regr_sxx(ema, t) OVER w > 1e-12 THEN regr_slope(ema, t) OVER w ELSE 0 END, 6) AS slope
FROM v WINDOW w AS (PARTITION BY session_id, key ORDER BY us RANGE BETWEEN 200000000 PRECEDING AND CURRENT ROW)"""
)
def trace_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.ema_slope(_raw_as_ema(spark, sf_dir), 200.0).select("session_id", "key", "tick", *_r("slope"))


@_query(
    _V
    + """, p AS (
  SELECT *, coalesce(greatest(t - lag(t) OVER o, 0), 0) AS dt, coalesce(greatest(t - lag(t) OVER o, 0) * (ema + lag(ema) OVER o) / 2, 0) AS term
  FROM v WINDOW o AS (PARTITION BY session_id, key ORDER BY us, tick)
), q AS (
  SELECT *, sum(term) OVER w - first_value(term) OVER w AS area, sum(dt) OVER w - first_value(dt) OVER w AS span
  FROM p WINDOW w AS (PARTITION BY session_id, key ORDER BY us RANGE BETWEEN 200000000 PRECEDING AND CURRENT ROW)
) SELECT session_id, key, tick, round(CASE WHEN span > 1e-9 THEN area / span ELSE 0 END, 6) AS integral FROM q"""
)
def trace_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.ema_integral(_raw_as_ema(spark, sf_dir), 200.0).select("session_id", "key", "tick", *_r("integral"))


@_query(
    _V
    + """, g AS (SELECT *, ema >= 0.5 AS inside, sum(CASE WHEN ema >= 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, key ORDER BY t, tick ROWS UNBOUNDED PRECEDING) AS run FROM v)
SELECT session_id, key, tick, round(CASE WHEN inside THEN t - min(CASE WHEN inside THEN t END) OVER (PARTITION BY session_id, key, run) ELSE 0 END, 6) AS in_band_for FROM g"""
)
def in_band_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = traces.in_band(F.col("ema"), F.lit(0.5), F.lit(1))
    return traces.in_band_for(_raw_as_ema(spark, sf_dir), inside).select("session_id", "key", "tick", *_r("in_band_for"))


@_query(_V + "SELECT session_id, key, tick, t - min(t) OVER (PARTITION BY session_id, key) >= 100 AS warm FROM v")
def trace_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.warm(_raw_as_ema(spark, sf_dir), F.lit(100.0)).select("session_id", "key", "tick", "warm")


@_query(_V + "SELECT session_id, key, tick FROM (SELECT *, row_number() OVER (PARTITION BY session_id, key ORDER BY t DESC, tick DESC) AS n FROM v) WHERE n <= 5")
def latest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.latest_samples(_raw_as_ema(spark, sf_dir), 5).select("session_id", "key", "tick")


@_query(
    f"""WITH RECURSIVE {_J}, e AS (
  SELECT session_id, tick, t, CASE WHEN key = 'error' THEN raw END AS eventful, row_number() OVER (PARTITION BY session_id ORDER BY t, tick) AS rn FROM j
), g AS (
  SELECT session_id, tick, t, rn, true AS open, CASE WHEN t < 24 THEN 'start' ELSE 'no bank' END AS reason, t AS last FROM e WHERE rn = 1
  UNION ALL
  SELECT session_id, tick, t, rn, reason IS NOT NULL, reason, CASE WHEN reason IS NOT NULL THEN t ELSE last END FROM (
    SELECT e.session_id, e.tick, e.t, e.rn, g.last,
      CASE WHEN e.t < 24 THEN 'start' WHEN e.t - g.last > 72 THEN 'stale' WHEN e.eventful >= 0.62 THEN 'eventful' END AS reason
    FROM g JOIN e ON e.session_id = g.session_id AND e.rn = g.rn + 1)
) SELECT session_id, tick, open, reason FROM g"""
)
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgments(spark, sf_dir).select("session_id", "tick", "t", F.when(F.col("key") == "error", F.col("raw")).alias("eventful"))
    return gate.gate_decisions(rows, 24.0, 72.0, 0.62).select("session_id", "tick", "open", "reason")


# ---- rules

_KEYS = ["click", "view", "signup", "purchase", "error"]
_RULES = (
    rules.Rule("quiet_click", "Click", "{q}", "click__fired AND coalesce(view__ema, 0.5) < 0.6", 40, "alert", ("click", "view")),
    rules.Rule("viewed", "View", "seen", "view__fired", 30, "nudge", ("view",)),
    rules.Rule("few_errors", "Errors", "calm", "error__ema < 0.45", 100, "info", ("error", "purchase")),
    rules.Rule("broken", "Never", "", "refund__fired", 10),
)
_WIDE = (
    _TRACE
    + """, w AS (
  SELECT session_id, tick, t, """
    + ", ".join(f"last_value(CASE WHEN key = '{k}' THEN ema END IGNORE NULLS) OVER o AS {k}, coalesce(key = '{k}' AND fired, false) AS {k}_fired" for k in _KEYS)
    + """ FROM r WINDOW o AS (PARTITION BY session_id ORDER BY t, tick ROWS UNBOUNDED PRECEDING)
), h AS (
  SELECT *, 'quiet_click' AS rule, 40 AS gap FROM w WHERE click_fired AND coalesce(view, 0.5) < 0.6
  UNION ALL SELECT *, 'viewed', 30 FROM w WHERE view_fired
  UNION ALL SELECT *, 'few_errors', 100 FROM w WHERE error < 0.45
)"""
)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rules.wide_state(outputs(spark, sf_dir).select("session_id", "tick", "t", "key", "fired", "ema"), _KEYS)
    return rules.candidates(wide, _RULES)


@_query(_WIDE + "SELECT session_id, tick, " + ", ".join(f"round({k}, 6) AS {k}__ema, {k}_fired AS {k}__fired" for k in _KEYS) + " FROM w")
def wide_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rules.wide_state(outputs(spark, sf_dir).select("session_id", "tick", "t", "key", "fired", "ema"), _KEYS, bucket_s=48.0)
    return wide.select("session_id", "tick", *(c for k in _KEYS for c in (F.round(f"{k}__ema", 6).alias(f"{k}__ema"), f"{k}__fired")))


@_query(_WIDE + "SELECT session_id, tick, rule FROM h")
def rule_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("session_id", "tick", "rule")


_COOL = (
    _WIDE
    + """, a AS (SELECT *, row_number() OVER (PARTITION BY session_id, rule ORDER BY t, tick) AS i FROM h), c AS (
  SELECT session_id, rule, i, t, tick, true AS keep, t AS last FROM a WHERE i = 1
  UNION ALL
  SELECT a.session_id, a.rule, a.i, a.t, a.tick, a.t - c.last >= a.gap, CASE WHEN a.t - c.last >= a.gap THEN a.t ELSE c.last END
  FROM c JOIN a ON a.session_id = c.session_id AND a.rule = c.rule AND a.i = c.i + 1
), k AS (SELECT c.session_id, c.rule, c.t, c.tick, click, view, error, purchase FROM c JOIN w ON w.session_id = c.session_id AND w.tick = c.tick WHERE keep)
"""
)


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.cards(rules.cooled_down(_hits(spark, sf_dir)), _RULES)


@_query(
    _COOL
    + """SELECT session_id, rule, tick, round(t, 2) AS t,
  CASE rule WHEN 'quiet_click' THEN 'that question' WHEN 'viewed' THEN 'seen' ELSE 'calm' END AS body,
  CASE rule WHEN 'quiet_click' THEN 'alert' WHEN 'viewed' THEN 'nudge' ELSE 'info' END AS severity,
  round(coalesce(CASE rule WHEN 'quiet_click' THEN click WHEN 'viewed' THEN view ELSE error END, 0), 3) AS first_evidence FROM k"""
)
def card_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.coalesce(F.col("evidence")["click"], F.when(F.col("rule") == "viewed", F.col("evidence")["view"]), F.col("evidence")["error"])
    return _cards(spark, sf_dir).select("session_id", "rule", "tick", "t", "body", "severity", first.alias("first_evidence"))


@_query(
    _COOL
    + "SELECT session_id, rule, tick FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(t, 2) DESC, tick DESC, rule) AS n FROM k) WHERE n <= 3"
)
def recent_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.recent_cards(_cards(spark, sf_dir), 3).select("session_id", "rule", "tick")


@_query(
    _COOL
    + """, m AS (SELECT session_id, count(*) AS ticks, max(t) AS last_t FROM j GROUP BY session_id), x AS (SELECT session_id, count(*) AS cards FROM k GROUP BY session_id)
SELECT m.session_id, ticks, ticks AS calls, coalesce(cards, 0) AS cards, round(coalesce(cards, 0) / ticks, 6) AS speak_rate,
  round(coalesce(cards, 0) / greatest(last_t, 1) * 60, 6) AS cards_per_min FROM m LEFT JOIN x ON m.session_id = x.session_id"""
)
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir)
    return evaluate.session_report(j, j, _cards(spark, sf_dir)).select("session_id", "ticks", "calls", "cards", *_r("speak_rate", "cards_per_min"))


@_query(_TRACE + "SELECT session_id, key, count(*) FILTER (fired) AS fires FROM r GROUP BY session_id, key")
def fires_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fires_by_key(outputs(spark, sf_dir))


@_query(_COOL + "SELECT session_id, rule, min(round(t, 2)) AS first_t, count(*) AS fires FROM k GROUP BY session_id, rule")
def first_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.first_fires(_cards(spark, sf_dir))


@_query(
    _COOL
    + """, z(rule, lo, hi) AS (VALUES ('viewed', 100.0, 400.0), ('few_errors', 50.0, 300.0), ('none', 0.0, 1.0)), b AS (
  SELECT session_id, k.rule, min(CASE WHEN round(t, 2) BETWEEN lo AND hi THEN round(t, 2) END) AS hit_t, count(*) FILTER (round(t, 2) < lo - 1) AS early
  FROM k JOIN z ON k.rule = z.rule GROUP BY session_id, k.rule)
SELECT rule, count(hit_t) AS hits, round(stddev_samp(hit_t), 4) AS hit_sd, round(sum(early) / (SELECT count(DISTINCT session_id) FROM j), 6) AS early_mean FROM b GROUP BY rule"""
)
def causal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = spark.createDataFrame([("viewed", 100.0, 400.0), ("few_errors", 50.0, 300.0), ("none", 0.0, 1.0)], "rule string, lo double, hi double")
    rows = evaluate.hit_summary(evaluate.causal_hits(_cards(spark, sf_dir), windows), judgments(spark, sf_dir))
    return rows.select("rule", "hits", F.round("hit_sd", 4).alias("hit_sd"), *_r("early_mean"))


@_query(
    _TRACE
    + """, d AS (SELECT session_id, key, max(CAST(fired AS INT)) AS hit FROM r GROUP BY session_id, key), e AS (SELECT session_id, key, avg(raw) > 0.6 AS truth FROM j GROUP BY session_id, key)
SELECT 'all' AS detector, round(avg(hit) FILTER (truth), 6) AS recall, round(avg(hit) FILTER (NOT truth), 6) AS false_positive_rate, count(*) AS episodes
FROM d JOIN e ON d.session_id = e.session_id AND d.key = e.key"""
)
def detector_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    episodes = judgments(spark, sf_dir).groupBy("session_id", "key").agg((F.avg("raw") > 0.6).alias("truth"))
    rows = evaluate.detector_quality(outputs(spark, sf_dir), episodes)
    return rows.select("detector", *_r("recall", "false_positive_rate"), "episodes")


@_query(
    f"""WITH {_J}, c AS (SELECT session_id, t, tick, CASE WHEN raw > 0.5 THEN 'true' ELSE 'false' END AS value FROM j WHERE key = 'signup')
SELECT j.session_id, j.tick, (SELECT value FROM c WHERE c.session_id = j.session_id AND c.t <= j.t ORDER BY c.t DESC, c.tick DESC LIMIT 1) = 'true' AS truth
FROM j WHERE key = 'click' AND EXISTS (SELECT 1 FROM c WHERE c.session_id = j.session_id AND c.t <= j.t)"""
)
def truth_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir)
    value = F.when(F.col("raw") > 0.5, "true").otherwise("false")
    changes = j.filter("key = 'signup'").select("session_id", "t", F.lit("signup").alias("channel"), value.alias("value"))
    rows = context.truth_at(j.filter("key = 'click'").select("session_id", "tick", "t"), changes, 24.0)
    return rows.select("session_id", "tick", context.trace_truth(F.lit("noul"), F.lit(None).cast("string"), F.col("truth")).alias("truth"))


@_query(
    f"""WITH {_J}, q AS (SELECT session_id, tick, raw, alt, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM j JOIN events e ON e.event_id = j.tick)
SELECT session_id, tick, key, round(raw, 6) AS raw, round(alt, 6) AS alt FROM (
  SELECT session_id, tick, 'ask' AS key, raw, alt FROM q
  UNION ALL SELECT session_id, tick, 'pick:a', raw, NULL FROM q
  UNION ALL SELECT session_id, tick, 'pick:b', 1 - raw, NULL FROM q
  UNION ALL SELECT session_id, tick, 'rate', least(k / 25.0 / 2, 1), NULL FROM q)"""
)
def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    rows = judgments(spark, sf_dir).join(_table(spark, sf_dir, "events").select(F.col("event_id").alias("tick"), k.alias("k")), "tick")
    none, some = F.lit(None), "struct<noul:double,choice:string,probabilities:map<string,double>,score:double,confidence:double>"
    one = lambda noul=none, probabilities=none, score=none: F.struct(noul, none, probabilities, score, none).cast(some)
    pairs = F.create_map(F.lit("a"), F.col("raw"), F.lit("b"), 1 - F.col("raw"))
    second = F.when(F.col("alt").isNotNull(), one(F.col("alt")))
    said = F.create_map(F.lit("ask"), one(F.col("raw")), F.lit("ask~alt"), second, F.lit("pick"), one(probabilities=pairs), F.lit("rate"), one(score=F.col("k") / 25), F.lit("rate~alt"), one(score=F.col("k")))
    table = spark.createDataFrame(
        [("ask", "noul", "q", [], []), ("pick", "choice", None, [("a", "a"), ("b", "b"), ("c", "c")], ["a", "b"]), ("rate", "score", None, [("0", "0"), ("1", "1"), ("2", "2")], []), ("gone", "noul", None, [], [])],
        "id string, kind string, alt string, criteria array<struct<option:string,label:string>>, watch array<string>",
    )
    return answers.parse_answers(rows.withColumn("answers", said), table).select("session_id", "tick", "key", *_r("raw", "alt"))


# ---- calls

_C = """
WITH c AS (
  SELECT user_id AS session_id, event_id AS tick, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t,
    CASE WHEN event_type IN ('click', 'view', 'error') THEN 'gate' ELSE 'bank' END AS stage,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS input_tokens, value AS latency_ms,
    CASE WHEN event_type = 'error' AND value > 100 THEN 'slow' END AS error FROM events
)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("tick"),
        F.expr(_HOURS).alias("t"),
        F.when(kind.isin("click", "view", "error"), "gate").otherwise("bank").alias("stage"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("input_tokens"),
        F.col("value").alias("latency_ms"),
        F.when((kind == "error") & (F.col("value") > 100), "slow").alias("error"),
    )


@_query(
    _C
    + """, m AS (SELECT session_id, count(*) AS calls, sum(input_tokens) AS tokens, count(error) AS errors, count(*) FILTER (stage = 'gate') AS g, count(*) FILTER (stage = 'bank') AS b,
  coalesce(sum(input_tokens) FILTER (stage = 'gate'), 0) AS gt, coalesce(sum(input_tokens) FILTER (stage = 'bank'), 0) AS bt FROM c GROUP BY session_id)
SELECT session_id, calls, CAST(tokens AS BIGINT) AS tokens, errors, round(tokens / 1e6 * 0.042, 9) AS spent, round(CASE WHEN g > 0 THEN b / g ELSE 0 END, 6) AS gate_open_rate,
  round(CASE WHEN g > 0 AND b > 0 AND bt > 0 THEN (bt / b * g - gt - bt) / (bt / b * g) ELSE 0 END, 6) AS gate_saving FROM m"""
)
def gate_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = meter.totals(calls(spark, sf_dir))
    return rows.select("session_id", "calls", "tokens", "errors", F.round("spent", 9).alias("spent"), *_r("gate_open_rate", "gate_saving"))


@_query(
    _C
    + """, l AS (SELECT session_id, list(latency_ms ORDER BY latency_ms) AS x FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t DESC, tick DESC) AS n FROM c) WHERE n <= 40 GROUP BY session_id)
SELECT session_id, x[least(CAST(floor(0.5 * len(x)) AS INT), len(x) - 1) + 1] AS p50_ms, x[least(CAST(floor(0.95 * len(x)) AS INT), len(x) - 1) + 1] AS p95_ms FROM l"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meter.latency_percentiles(calls(spark, sf_dir), latest=40)


@_query(
    _C
    + """SELECT session_id, tick, round(sum(input_tokens) OVER w / greatest(t - min(t) OVER w, 0.001), 5) AS tokens_per_sec,
  round(count(*) OVER w / greatest(t - min(t) OVER w, 0.001) * 60, 5) AS requests_per_min
FROM (SELECT *, CAST(round(t * 1000000) AS BIGINT) AS us FROM c) WINDOW w AS (PARTITION BY session_id ORDER BY us RANGE BETWEEN 20000000 PRECEDING AND CURRENT ROW)"""
)
def rolling_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = meter.rolling_rates(calls(spark, sf_dir))
    return rows.select("session_id", "tick", F.round("tokens_per_sec", 5).alias("tokens_per_sec"), F.round("requests_per_min", 5).alias("requests_per_min"))


@_query(
    _C
    + """, m AS (SELECT session_id, avg(input_tokens) FILTER (stage = 'gate') AS g, avg(input_tokens) FILTER (stage = 'bank') AS b FROM c GROUP BY session_id)
SELECT session_id, rate_hz, open_rate, round(rate_hz * (g + open_rate * b) * 3600 / 1e6 * 0.042, 6) AS dollars_per_hour,
  round((rate_hz * b - rate_hz * (g + open_rate * b)) / (rate_hz * b), 6) AS saving, round((b - g) / b, 6) AS break_even
FROM m, (VALUES (1.0::DOUBLE), (2.0), (5.0), (10.0)) r(rate_hz), (VALUES (0.2::DOUBLE), (0.4), (0.8)) o(open_rate) WHERE g IS NOT NULL AND b > 0"""
)
def budget_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = meter.budget_grid(calls(spark, sf_dir))
    return rows.select("session_id", "rate_hz", "open_rate", *_r("dollars_per_hour", "saving", "break_even"))


# ---- samples and labels

_BIN = "least(CAST(floor(raw * 10) AS INT), 9)"
_Q = f"WITH {_J}, q AS (SELECT session_id, key, tick, raw, bin FROM (SELECT *, {_BIN} AS bin, row_number() OVER (PARTITION BY session_id, key, {_BIN} ORDER BY t, tick) AS n FROM j) WHERE n <= 2)"


@_query(_Q + "SELECT session_id, key, tick, bin FROM q")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota_sample(judgments(spark, sf_dir), 2).select("session_id", "key", "tick", "bin")


@_query(f"WITH {_J} SELECT session_id, key, tick FROM (SELECT *, row_number() OVER (PARTITION BY key, {_BIN} ORDER BY t, tick, session_id) AS n FROM j) WHERE n <= 25")
def pooled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota_sample(judgments(spark, sf_dir), 25, pooled=True).select("session_id", "key", "tick")


@_query(_Q + "SELECT key, count(*) AS kept, count(DISTINCT bin) AS bins FROM q GROUP BY key")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.coverage(sampling.quota_sample(judgments(spark, sf_dir), 2))


@_query(_Q + "SELECT key, count(*) AS kept, count(DISTINCT bin) AS bins, round(count(*) / count(DISTINCT bin), 6) AS rows_per_bin FROM q GROUP BY key ORDER BY 4, key LIMIT 3")
def thinnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.thinnest(sampling.coverage(sampling.quota_sample(judgments(spark, sf_dir), 2)))
    return rows.select("key", "kept", "bins", *_r("rows_per_bin"))


@_query(_Q + "SELECT count(*) AS kept, (SELECT count(*) FROM j) AS seen, round(count(*) / (SELECT count(*) FROM j) * 100, 6) AS kept_pct, count(DISTINCT key) AS channels FROM q")
def recording_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir)
    return sampling.recording_summary(j, sampling.quota_sample(j, 2)).select("kept", "seen", *_r("kept_pct"), "channels")


_L = """
WITH l AS (
  SELECT source AS session_id, lang AS key, d.doc_id AS tick, least(n_chars / 5000, 1) AS raw, quality = 1 AS truth
  FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples (session: source, key: language), with the truth of those that are labelled."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")
    return docs.select(F.col("source").alias("session_id"), F.col("lang").alias("key"), F.col("doc_id").alias("tick"), F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("raw"), "truth")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.labelled_rows(samples(spark, sf_dir).select("session_id", "tick", "key", "raw", "truth"))[0]


@_query(_L + "SELECT key, tick, row_number() OVER (PARTITION BY key ORDER BY raw, session_id, tick) AS place, count(*) OVER (PARTITION BY key) AS remaining FROM l WHERE truth IS NULL")
def label_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.label_queue(samples(spark, sf_dir)).select("key", "tick", F.col("place").cast("long").alias("place"), "remaining")


@_query(_L + "SELECT key, count(truth) AS labelled, count(*) - count(truth) AS unlabelled, count(*) AS total, count(truth) >= 80 AS ready FROM l GROUP BY key")
def label_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.label_progress(samples(spark, sf_dir))


@_query(_L + "SELECT session_id, key, tick, coalesce(tick % 2 = 0, truth) AS truth FROM l WHERE tick % 3 = 0 UNION ALL SELECT session_id, key, tick, truth FROM l WHERE tick % 3 <> 0")
def merge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    new = rows.filter("tick % 3 = 0").select("session_id", "key", "tick", (F.col("tick") % 2 == 0).alias("truth"))
    return transcripts.merge_labels(rows, new).select("session_id", "key", "tick", "truth")


@_query(
    _L
    + f""", b AS (SELECT key, {_BIN} AS bin, count(*) AS n, avg(raw) AS p, avg(CAST(truth AS INT)) AS y FROM l WHERE truth IS NOT NULL GROUP BY 1, 2)
SELECT key, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b GROUP BY key"""
)
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.calibration_error(pairs(spark, sf_dir)).select("key", "n", *_r("ece"))


_ACC = _L + ", measured AS (SELECT key, count(*) AS n, round(avg(CAST((raw >= 0.5) = truth AS INT)), 4) AS accuracy FROM l WHERE truth IS NOT NULL GROUP BY key)"


@_query(_ACC + "SELECT key, n, accuracy FROM measured")
def boundary_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.boundary_accuracy(pairs(spark, sf_dir))


@_query(
    _L
    + """, p AS (SELECT key, round(raw, 4) AS x, count(*) AS n, sum(CAST(truth AS INT)) AS y FROM l WHERE truth IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(y) OVER w AS cy FROM p WINDOW w AS (PARTITION BY key ORDER BY x)),
m AS (
  SELECT a.key, a.i AS j, b.i AS k, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS mean FROM o a JOIN o b ON a.key = b.key AND a.i <= b.i
), u AS (SELECT key, j, k, min(mean) OVER (PARTITION BY key, j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS low FROM m),
f AS (SELECT o.key, o.x, max(low) AS y FROM o JOIN u ON u.key = o.key AND u.j <= o.i AND u.k = o.i GROUP BY o.key, o.x)
SELECT key, round(CASE WHEN y = max(y) OVER (PARTITION BY key) THEN 1 ELSE x END, 4) AS x, round(y, 6) AS y FROM (SELECT key, max(x) AS x, y FROM f GROUP BY key, y)"""
)
def isotonic_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = calibration.fit_curves(pairs(spark, sf_dir), least=1, most_points=1_000_000)
    points = curves.select("key", F.explode(F.arrays_zip("xs", "ys")).alias("p"))
    return points.groupBy("key", F.round("p.ys", 6).alias("y")).agg(F.round(F.max("p.xs"), 4).alias("x")).select("key", "x", "y")


@_query(
    _L.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, p AS (SELECT key, round(raw, 4) AS x, count(*) AS n, sum(CAST(truth AS INT)) AS y FROM l WHERE truth IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(y) OVER w AS cy FROM p WINDOW w AS (PARTITION BY key ORDER BY x)),
m AS (SELECT a.key, a.i AS j, b.i AS k, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS mean FROM o a JOIN o b ON a.key = b.key AND a.i <= b.i),
u AS (SELECT key, j, k, min(mean) OVER (PARTITION BY key, j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS low FROM m),
f AS (SELECT o.key, o.x, o.n, o.y, o.cn, o.cy, max(low) AS v FROM o JOIN u ON u.key = o.key AND u.j <= o.i AND u.k = o.i GROUP BY ALL),
e AS (SELECT key, x, cn, cy FROM (SELECT *, sum(y - v * n) OVER (PARTITION BY key ORDER BY x) AS off FROM f) WHERE abs(off) < 1e-9),
s AS (SELECT key, max(cn) AS total, greatest(40, max(cn) // 25) AS least, count(*) AS blocks FROM e GROUP BY key),
g AS (SELECT key, 0::BIGINT AS done FROM s UNION ALL SELECT g.key, min(e.cn)::BIGINT AS done FROM g JOIN s ON s.key = g.key JOIN e ON e.key = g.key AND e.cn >= g.done + s.least GROUP BY g.key, g.done),
h AS (SELECT g.key, done FROM g JOIN s ON s.key = g.key WHERE done > 0 AND done < (SELECT max(done) FROM g z WHERE z.key = g.key) UNION SELECT key, total FROM s),
b AS (SELECT e.key, e.x, e.cn - lag(e.cn, 1, 0) OVER w AS n, e.cy - lag(e.cy, 1, 0) OVER w AS y, row_number() OVER w AS i, e.cn, e.cy
  FROM e JOIN h ON h.key = e.key AND h.done = e.cn WINDOW w AS (PARTITION BY e.key ORDER BY e.x)),
m2 AS (SELECT a.key, a.i AS j, b.i AS k, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS mean FROM b a JOIN b ON a.key = b.key AND a.i <= b.i),
u2 AS (SELECT key, j, k, min(mean) OVER (PARTITION BY key, j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS low FROM m2),
f2 AS (SELECT b.key, b.x, max(low) AS y FROM b JOIN u2 ON u2.key = b.key AND u2.j <= b.i AND u2.k = b.i GROUP BY b.key, b.x)
SELECT key, round(CASE WHEN y = max(y) OVER (PARTITION BY key) THEN 1 ELSE x END, 4) AS x, round(y, 6) AS y FROM (SELECT key, max(x) AS x, y FROM f2 GROUP BY key, y)"""
)
def regular_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves with the default least weight of a block: blocks are joined until each has it, and made to rise again."""
    curves = calibration.fit_curves(pairs(spark, sf_dir), most_points=1_000_000)
    points = curves.select("key", F.explode(F.arrays_zip("xs", "ys")).alias("p"))
    return points.groupBy("key", F.round("p.ys", 6).alias("y")).agg(F.round(F.max("p.xs"), 4).alias("x")).select("key", "x", "y")


@_query(
    _L
    + """, c(key, xs, ys) AS (VALUES ('en', [0.0, 0.3, 0.3, 0.8], [0.1, 0.2, 0.4, 0.7]), ('fr', [0.1, 1.0], [0.0, 1.0])),
b AS (SELECT l.tick, l.key, raw, xs, ys, len(list_filter(xs, lambda x: x < raw)) AS n FROM l LEFT JOIN c ON l.key = c.key)
SELECT tick, key, round(CASE WHEN xs IS NULL THEN raw WHEN n = 0 THEN ys[1] WHEN n >= len(xs) THEN ys[len(ys)] WHEN xs[n + 1] = xs[n] THEN ys[n + 1]
  ELSE ys[n] + (ys[n + 1] - ys[n]) * (raw - xs[n]) / (xs[n + 1] - xs[n]) END, 6) AS value FROM b"""
)
def apply_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = spark.createDataFrame([("en", [0.0, 0.3, 0.3, 0.8], [0.1, 0.2, 0.4, 0.7]), ("fr", [0.1, 1.0], [0.0, 1.0])], "key string, xs array<double>, ys array<double>")
    return calibration.apply_curves(samples(spark, sf_dir), curves).select("tick", "key", *_r("value"))


@_query(
    _ACC
    + """, h AS (SELECT key, accuracy AS a, accuracy * 0.1 + (1 - accuracy) * 0.9 AS low, accuracy * 0.9 + (1 - accuracy) * 0.1 AS high, sqrt(accuracy * (1 - accuracy)) * 0.8 AS sigma FROM measured),
k AS (SELECT *, high - low AS gap, power(0.65 * (high - low) / (3 * sigma), 2) AS k, 2 * a * (1 - a) * 0.8 AS d0, (a * a + (1 - a) * (1 - a)) * 0.8 AS d1 FROM h),
z AS (SELECT *, round(low + 0.65 * gap, 4) AS fire, round(low + 0.35 * gap, 4) AS release,
  round(CASE WHEN sigma <= 1e-9 THEN 0.001 WHEN 2 * k / (1 + k) >= 1 THEN 0.001 ELSE -1 / (2 * ln(1 - 2 * k / (1 + k))) END, 3) AS tau,
  round(CASE WHEN d1 - d0 < 0.25 THEN 1 ELSE d0 + 0.75 * (d1 - d0) END, 4) AS unreliable_at FROM k)
SELECT key, fire, release, tau, unreliable_at, CASE WHEN gap < 0.08 THEN 'gap too small' WHEN release >= fire THEN 'no hysteresis' WHEN tau <= 0 THEN 'no smoothing' ELSE 'ok' END AS status FROM z"""
)
def derive_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs from the accuracies measured on the labels."""
    measured = calibration.boundary_accuracy(pairs(spark, sf_dir))
    empty = F.lit(None)
    rows = measured.select(
        F.col("key").alias("id"),
        F.lit("noul").alias("kind"),
        F.lit("bank").alias("tier"),
        F.lit("high").alias("polarity"),
        "accuracy",
        F.lit(0.65).alias("fire_at"),
        empty.cast("double").alias("p_hit"),
        empty.cast("double").alias("p_miss"),
        empty.cast("array<struct<option:string,label:string>>").alias("criteria"),
        empty.cast("array<string>").alias("watch"),
        F.lit(0.0).alias("dwell_s"),
        F.lit(25.0).alias("refractory_s"),
        empty.cast("double").alias("min_slope"),
        F.lit(False).alias("silent"),
    )
    return ch.derive_specs(rows).select("key", "fire", "release", "tau", "unreliable_at", "status")


# ---- conversations as transcripts

_U = """
WITH u AS (
  SELECT conv_id AS session_id, turn AS seq, 4.0::DOUBLE * turn AS t, CASE role WHEN 'assistant' THEN 'ME' WHEN 'user' THEN 'THEM' ELSE 'SILENCE' END AS speaker, text FROM conversations
), k AS (
  SELECT session_id, unnest(range(CAST(floor((max(t) + 6) * 0.25) AS BIGINT))) AS tick FROM u GROUP BY session_id
), g AS (SELECT session_id, tick, tick / 0.25::DOUBLE AS t FROM k)"""


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    speaker = F.when(F.col("role") == "assistant", "ME").when(F.col("role") == "user", "THEM").otherwise("SILENCE")
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), (4.0 * F.col("turn")).alias("t"), speaker.alias("speaker"), "text")


@_query(_U + "SELECT session_id, tick, t FROM g")
def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.tick_grid(utterances(spark, sf_dir), 0.25)


_W = (
    _U
    + """, x AS (
  SELECT g.session_id, g.tick, u.t AS said, u.seq, speaker || ': ' || text AS line, sum(length(speaker || ': ' || text) + 1) OVER (PARTITION BY g.session_id, g.tick ORDER BY u.t DESC, u.seq DESC ROWS UNBOUNDED PRECEDING) AS used
  FROM g JOIN u ON u.session_id = g.session_id AND g.t - u.t BETWEEN 0 AND 10
), y AS (SELECT session_id, tick, string_agg(line, chr(10) ORDER BY said, seq) AS lines, count(*) AS n FROM x WHERE used <= 600 GROUP BY session_id, tick)"""
)


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.rolling_context(ticks(spark, sf_dir), utterances(spark, sf_dir), 10.0, 600)


@_query(_W + "SELECT g.session_id, g.tick, coalesce(n, 0) AS n, coalesce(lines, '') AS lines FROM g LEFT JOIN y ON g.session_id = y.session_id AND g.tick = y.tick")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir).select("session_id", "tick", F.size("lines").cast("long").alias("n"), F.array_join("lines", "\n").alias("lines"))


@_query(
    _W
    + """, c AS (SELECT session_id, tick, coalesce(string_agg('"' || replace(replace(line, chr(10), '\\n'), '"', '\\"') || '"', ',' ORDER BY said, seq), '') AS parts FROM x WHERE used <= 600 GROUP BY session_id, tick)
SELECT g.session_id, g.tick, CASE WHEN parts IS NULL THEN '{"agenda":"talk"}' ELSE '{"recent_conversation":[' || parts || '],"agenda":"talk"}' END AS payload FROM g LEFT JOIN c ON g.session_id = c.session_id AND g.tick = c.tick"""
)
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.payloads(_contexts(spark, sf_dir), agenda=F.lit("talk"), brief=F.lit("")).select("session_id", "tick", "payload")


@_query(
    _U
    + """SELECT g.session_id, g.tick, coalesce(g.t - max(u.t), 0) AS silence_for, arg_max(u.speaker, u.seq) AS last_speaker
FROM g LEFT JOIN u ON u.session_id = g.session_id AND u.t <= g.t GROUP BY g.session_id, g.tick, g.t"""
)
def silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.silence(ticks(spark, sf_dir), utterances(spark, sf_dir), 8.0).select("session_id", "tick", "silence_for", "last_speaker")


@_query(
    _U
    + """, q AS (SELECT g.session_id, g.tick, g.t, arg_max(trim(u.text), u.seq) AS text, max(u.t) AS said FROM g LEFT JOIN u ON u.session_id = g.session_id AND u.t <= g.t AND contains(u.text, ',') GROUP BY ALL)
SELECT session_id, tick, CASE WHEN text IS NULL OR t - said > 10 THEN '' WHEN length(text) > 90 THEN left(text, 87) || '...' ELSE text END AS last_question FROM q"""
)
def last_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.last_question(ticks(spark, sf_dir), utterances(spark, sf_dir), ",", 10.0, bucket_s=8.0).select("session_id", "tick", "last_question")


@_query(
    """WITH p AS (SELECT conv_id, turn, trim(CASE role WHEN 'assistant' THEN ' me : ' WHEN 'user' THEN '' ELSE 'Bob: ' END || regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM conversations),
h AS (SELECT *, instr(line, ':') AS pos, upper(trim(split_part(line, ':', 1))) AS head FROM p WHERE length(line) > 0)
SELECT conv_id, turn, CASE WHEN pos > 0 AND pos < length(line) AND head IN ('ME', 'THEM', 'SILENCE') THEN head ELSE 'THEM' END AS speaker,
  CASE WHEN pos > 0 AND pos < length(line) AND head IN ('ME', 'THEM', 'SILENCE') THEN trim(substr(line, pos + 1)) ELSE line END AS text FROM h"""
)
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("role") == "assistant", " me : ").when(F.col("role") == "user", "").otherwise("Bob: ")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(tag, F.regexp_replace("text", r"\s+", " ")).alias("value"))
    return transcripts.parse_speaker_lines(rows).select("conv_id", "turn", "speaker", "text")
