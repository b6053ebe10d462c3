"""Registered queries of sources, recorded rows, frames, channel tables and calibration, each with the DuckDB SQL of the same result.

``conversations`` give scripts, turn events and contexts, ``events`` call logs and samples, ``part`` a table of channels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import channels as ch
from ..functions.scratch import scratch_folder
from ..operators import answers, calibration, context, evaluate, gate, meter, rules, sampling, traces
from ..sources import scoring, transcripts
from . import queries as base
from .queries import _ACC, _BIN, _COOL, _J, _L, _S, _SPECS, _TRACE, _U, _WIDE, _cards, _r, _table, calls, judgments, outputs, pairs, samples, specs, ticks, utterances

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str):
    """Registers a function as a query of its name."""

    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


# ---- sources


@_query(
    """SELECT conv_id AS session_id, CASE turn % 4 WHEN 0 THEN turn * 1.5 ELSE 0 END::DOUBLE AS t, CASE turn % 4 WHEN 0 THEN upper(role) ELSE 'THEM' END AS speaker, text,
  CASE turn % 4 WHEN 0 THEN 'true' END AS said, CASE turn % 4 WHEN 0 THEN '1.5' END AS level FROM conversations WHERE turn % 4 < 2"""
)
def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other pair of turns is a comment or blank; of the others one has all fields and one only its text."""
    truth = F.struct(F.lit(True).alias("yes"), F.lit(1.5).alias("level"))
    whole = F.to_json(F.struct((F.col("turn") * 1.5).alias("t"), F.upper("role").alias("speaker"), "text", truth.alias("truth")))
    k = F.col("turn") % 4
    value = F.when(k == 0, whole).when(k == 1, F.to_json(F.struct("text"))).when(k == 2, F.concat(F.lit("  // "), whole)).otherwise("   ")
    rows = transcripts.parse_scripts(_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), value.alias("value")))
    return rows.select("session_id", "t", "speaker", "text", F.try_element_at("truth", F.lit("yes")).alias("said"), F.try_element_at("truth", F.lit("level")).alias("level"))


_EVENTS = "CASE turn % 5 WHEN 1 THEN 'EndOfTurn' WHEN 2 THEN 'EagerEndOfTurn' WHEN 3 THEN 'TurnResumed' END"


@_query(f"SELECT conv_id, turn, trim(text) AS text FROM conversations WHERE role <> 'system' AND turn % 7 <> 4 AND length(trim(text)) > 0 AND coalesce({_EVENTS} IN ('EndOfTurn', 'EagerEndOfTurn'), true)")
def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events: system turns are of another type, every seventh line is broken off."""
    k = F.col("turn") % 5
    event = F.when(k == 1, "EndOfTurn").when(k == 2, "EagerEndOfTurn").when(k == 3, "TurnResumed")
    kind = F.when(F.col("role") == "system", "Connected").otherwise("TurnInfo")
    value = F.to_json(F.struct(kind.alias("type"), event.alias("event"), F.concat(F.lit(" "), "text").alias("transcript")))
    value = F.when(F.col("turn") % 7 == 4, F.substring(value, 1, 20)).otherwise(value)
    return transcripts.parse_turn_events(_table(spark, sf_dir, "conversations").select("conv_id", "turn", value.alias("value")), eager=True)


@_query("SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'ME' ELSE 'THEM' END AS speaker, length(text) AS size FROM conversations WHERE role <> 'system'")
def merged_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("size"))
    streams = {s: turns.filter(F.col("role") == r).drop("role") for s, r in (("ME", "assistant"), ("THEM", "user"))}
    return transcripts.merged_streams(streams)


@_query(
    """SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS tick, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 2 ELSE 1 END AS answers,
  CASE WHEN event_type <> 'error' THEN round(1 - exp(-value / 50), 6) END AS eventful, CASE event_type WHEN 'view' THEN 0.25 END::DOUBLE AS price, CASE event_type WHEN 'error' THEN 'down' END AS error,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS input_tokens FROM events"""
)
def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of calls as JSON lines: failed calls have no answers; views answer a choice beside the yes-or-no question."""
    kind, yes = F.col("event_type"), F.struct(F.round(1 - F.exp(-F.col("value") / 50), 6).alias("noul"))
    pick = F.struct(F.lit("price").alias("choice"), F.struct(F.lit(0.25).alias("price")).alias("probabilities"))
    said = F.when(kind == "view", F.struct(yes.alias("eventful"), pick.alias("objection"))).when(kind != "error", F.struct(yes.alias("eventful"), F.lit(None).cast(pick_type()).alias("objection")))
    line = F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("session_id"),
            F.col("event_id").alias("tick"),
            said.alias("answers"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("input_tokens"),
            F.when(kind == "error", "down").alias("error"),
        )
    )
    rows = transcripts.parse_calls(_table(spark, sf_dir, "events").select(line.alias("value")))
    price = F.try_element_at(F.try_element_at("answers", F.lit("objection"))["probabilities"], F.lit("price"))
    return rows.select("session_id", "tick", F.size("answers").alias("answers"), F.try_element_at("answers", F.lit("eventful"))["noul"].alias("eventful"), price.alias("price"), "error", "input_tokens")


def pick_type() -> str:
    return "struct<choice:string,probabilities:struct<price:double>>"


@_query(_L + "SELECT count(*) AS rows, count(*) - count(truth) AS unlabelled FROM l")
def labelled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.labelled_rows(samples(spark, sf_dir))[1]


@_query(
    _L
    + """, b AS (SELECT session_id, key, tick, truth, CASE WHEN tick % 4 = 0 THEN tick % 8 = 0 WHEN tick % 4 = 1 THEN true END AS last FROM l)
SELECT session_id, key, tick, coalesce(last, truth) AS truth FROM b"""
)
def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several labels of a row: the latest counts; without times, true goes before false."""
    rows = samples(spark, sf_dir)
    key = ["session_id", "key", "tick"]
    first = rows.filter("tick % 4 = 0").select(*key, (F.col("tick") % 8 != 0).alias("truth"), F.lit(1).alias("at"))
    timed = first.unionByName(first.select(*key, (~F.col("truth")).alias("truth"), F.lit(2).alias("at")))
    plain = rows.filter("tick % 4 = 1").select(*key, F.explode(F.array(F.lit(False), F.lit(True), F.lit(None))).alias("truth"))
    return transcripts.merge_labels(transcripts.merge_labels(rows, timed), plain).select(*key, "truth")


@_query(_L + ", n AS (SELECT key, count(*) AS n FROM l WHERE truth IS NOT NULL GROUP BY key) SELECT key, n, CAST(n AS DOUBLE) / 1000 AS accuracy, round(n / 7.0, 4) AS x FROM n")
def calibration_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibration that is written and read again."""
    n = F.col("n")
    curves = pairs(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n")).select("key", "n", F.array(F.lit(0.0), F.round(n / 7, 4)).alias("xs"), F.array(F.lit(0.0), F.lit(1.0)).alias("ys"), (n / 1000).alias("accuracy"))
    folder = scratch_folder(spark)
    transcripts.write_calibration(curves, folder)
    return transcripts.read_calibration(spark, folder).select("key", "n", "accuracy", F.col("xs")[1].alias("x"))


# ---- channels of the user's own

_KIND = "CASE p_partkey % 3 WHEN 0 THEN 'noul' WHEN 1 THEN 'choice' ELSE 'score' END"
_PARTS = f"""
WITH c AS (
  SELECT 'p' || p_partkey AS id, {_KIND} AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'gate' ELSE 'bank' END AS tier, p_name AS instructions, CASE WHEN p_partkey % 4 > 0 THEN p_type ELSE '' END AS alt,
    CASE p_partkey % 3 WHEN 0 THEN 0 ELSE 2 + p_size % 4 END AS n, p_brand AS label, 0.5 + (p_retailprice % 100) / 200 AS accuracy, CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'low' END AS polarity, p_partkey % 5 = 0 AS silent
  FROM part
)"""


def part_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as channels: of all kinds, choices and scores with two to five options o1, o2 and so on."""
    k, size = F.col("p_partkey"), F.col("p_size")
    options = F.transform(F.sequence(F.lit(1), 2 + size % 4), lambda i: F.struct(F.concat(F.lit("o"), i.cast("string")).alias("option"), F.concat(F.col("p_brand"), F.lit(" "), i.cast("string")).alias("label")))
    return _table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"),
        F.when(k % 3 == 0, "noul").when(k % 3 == 1, "choice").otherwise("score").alias("kind"),
        F.when(k % 2 == 0, "gate").otherwise("bank").alias("tier"),
        F.col("p_name").alias("instructions"),
        F.when(k % 4 > 0, F.col("p_type")).otherwise("").alias("alt"),
        F.when(k % 3 > 0, options).otherwise(F.array().cast("array<struct<option:string,label:string>>")).alias("criteria"),
        F.when(k % 3 == 1, F.array(F.lit("o1"), F.lit("o2"))).otherwise(F.array().cast("array<string>")).alias("watch"),
        (0.5 + F.col("p_retailprice") % 100 / 200).alias("accuracy"),
        F.when(size % 2 == 0, "high").otherwise("low").alias("polarity"),
        F.lit(1.5).alias("dwell_s"),
        F.lit(25.0).alias("refractory_s"),
        F.lit(None).cast("double").alias("min_slope"),
        F.lit(0.65).alias("fire_at"),
        F.lit(None).cast("double").alias("p_hit"),
        F.lit(None).cast("double").alias("p_miss"),
        (k % 5 == 0).alias("silent"),
    )


@_query(
    _PARTS
    + """SELECT id AS question_id, id AS channel, kind, tier, instructions, CASE WHEN kind <> 'noul' THEN n END AS options FROM c
UNION ALL SELECT id || '~alt', id, kind, tier, alt, CASE WHEN kind <> 'noul' THEN n END FROM c WHERE alt <> ''"""
)
def question_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers.questions(part_channels(spark, sf_dir))
    return rows.select("question_id", "channel", "kind", "tier", "instructions", F.when(F.col("criteria").isNotNull(), F.size("criteria")).alias("options"))


@_query(
    _PARTS
    + """SELECT id AS key, instructions AS question FROM c WHERE kind <> 'choice'
UNION ALL SELECT id || ':o' || i, instructions || ' — is it ''o' || i || ''' (' || label || ' ' || i || ')?' FROM c, range(1, 3) r(i) WHERE kind = 'choice'
UNION ALL SELECT id || ':other', instructions || ' — is it ''other'' (other)?' FROM c WHERE kind = 'choice'"""
)
def plain_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain wording of every trace's question, and of an option that no channel has."""
    table = part_channels(spark, sf_dir)
    option = F.explode(F.when(F.col("kind") == "choice", F.array(F.lit("o1"), F.lit("o2"), F.lit("other"))).otherwise(F.array(F.lit(None).cast("string"))))
    keys = table.select("id", option.alias("option")).select(F.concat_ws(":", "id", "option").alias("key"))
    return answers.plain_question(keys, table).select("key", "question")


@_query(
    _PARTS
    + """, m AS (SELECT *, CASE kind WHEN 'choice' THEN 0.74 WHEN 'score' THEN 0.82 ELSE 0.9 END AS hit, CASE kind WHEN 'choice' THEN 0.26 / (n - 1) WHEN 'score' THEN 0.18 ELSE 0.1 END AS miss,
  CASE tier WHEN 'gate' THEN 5.0 ELSE 2.0 END AS rate FROM c),
h AS (SELECT *, accuracy * miss + (1 - accuracy) * hit AS low, accuracy * hit + (1 - accuracy) * miss AS high, sqrt(accuracy * (1 - accuracy)) * (hit - miss) AS sigma FROM m),
k AS (SELECT *, power(0.65 * (high - low) / (3 * sigma), 2) AS k, 2 * accuracy * (1 - accuracy) * (hit - miss) AS d0, (accuracy * accuracy + (1 - accuracy) * (1 - accuracy)) * (hit - miss) AS d1 FROM h),
z AS (SELECT *, CASE WHEN polarity = 'high' THEN low + 0.65 * (high - low) ELSE 1 - (low + 0.65 * (high - low)) END AS fire, CASE WHEN polarity = 'high' THEN low + 0.35 * (high - low) ELSE 1 - (low + 0.35 * (high - low)) END AS release,
  CASE WHEN sigma <= 1e-9 OR 2 * k / (1 + k) >= 1 THEN 0.001 ELSE -1 / (rate * ln(1 - 2 * k / (1 + k))) END AS tau, CASE WHEN d1 - d0 < 0.25 THEN 1 ELSE d0 + 0.75 * (d1 - d0) END AS ill FROM k),
o AS (SELECT z.*, option FROM z, (VALUES ('o1'), ('o2'), (NULL)) v(option) WHERE (kind = 'choice') = (option IS NOT NULL))
SELECT concat_ws(':', id, option) AS key, silent, floor(round(fire, 4) * 1000 + 0.05) AS fire, floor(round(release, 4) * 1000 + 0.05) AS release, CASE polarity WHEN 'high' THEN 1.0 ELSE -1.0 END::DOUBLE AS polarity, floor(round(ill, 4) * 1000 + 0.05) AS unreliable_at,
  CASE WHEN high - low >= 0.08 THEN floor(round(tau, 3) * 100 + 0.05) END AS tau, high - low < 0.08 AS too_small FROM o"""
)
def channel_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs of channels of all kinds, tiers and polarities; numbers are cut to whole thousandths (tau: hundredths), as halves round either way."""
    rows = ch.derive_specs(part_channels(spark, sf_dir))
    small = F.col("status") == "gap too small"
    cut = lambda c, k: F.floor(F.col(c) * k + 0.05).cast("double")
    return rows.select("key", "silent", cut("fire", 1000).alias("fire"), cut("release", 1000).alias("release"), "polarity", cut("unreliable_at", 1000).alias("unreliable_at"), F.when(~small, cut("tau", 100)).alias("tau"), small.alias("too_small"))


@_query(_TRACE + "SELECT session_id, key, tick FROM r WHERE fired AND key NOT IN ('view', 'error')")
def loud_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fired edges without those of channels that are silent."""
    table = spark.createDataFrame([("click", False), ("view", True), ("error", True)], "id string, silent boolean")
    return traces.fired_edges(outputs(spark, sf_dir), table).select("session_id", "key", "tick")


@_query(
    _WIDE
    + """SELECT session_id, tick, CASE WHEN greatest(coalesce(click, 0), coalesce(view, 0), coalesce(error, 0)) <= 0.42 THEN 'them' WHEN coalesce(click, 0) >= greatest(coalesce(view, 0), coalesce(error, 0)) THEN 'me'
  WHEN coalesce(view, 0) >= coalesce(error, 0) THEN 'silence' ELSE 'overlap' END AS floor FROM w"""
)
def floor_holder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who holds the floor, by three traces that stand for its options."""
    named = {"click": "floor:me", "view": "floor:silence", "error": "floor:overlap"}
    rows = outputs(spark, sf_dir).select("session_id", "tick", "t", F.coalesce(F.create_map(*(F.lit(x) for kv in named.items() for x in kv))[F.col("key")], "key").alias("key"), "fired", "ema")
    return rules.floor_holder(rules.wide_state(rows, list(named.values()))).select("session_id", "tick", "floor")


# ---- the default deck over a state that the events give

_DECK_KEYS = ["eventful", "floor:me", "floor:silence", "floor:overlap", "question_answered", "confusion", "objection:price", "objection:timing", "objection:authority", "objection:trust", "commitment", "commitment_bound", "claim_checkable", "interest", "repetition", "off_agenda", "decision_ready"]
_D = (
    f"""WITH RECURSIVE {_J}, d AS (SELECT session_id, tick, t, CAST(floor(raw * 1000000) AS BIGINT) AS m FROM j),
q AS (SELECT session_id, tick, t, m, """
    + ", ".join(f"last_value(CASE WHEN m % 17 = {i} THEN (m % 997) / 997.0 END IGNORE NULLS) OVER o AS e{i}, last_value(CASE WHEN m % 17 = {i} THEN (m % 991) / 991.0 - 0.5 END IGNORE NULLS) OVER o AS s{i}, coalesce(m % 17 = {i} AND m % 3 = 0, false) AS f{i}" for i in range(17))
    + """, last_value(CASE WHEN m % 17 = 1 THEN (m % 983) / 983.0 END IGNORE NULLS) OVER o AS g1, last_value(CASE WHEN m % 17 = 1 THEN m % 2 = 0 END IGNORE NULLS) OVER o AS w1
  FROM d WINDOW o AS (PARTITION BY session_id ORDER BY t, tick ROWS UNBOUNDED PRECEDING)),
h AS (SELECT session_id, tick, t, unnest(list_filter([
  CASE WHEN f5 AND coalesce(e13, 0.5) < 0.5 THEN 'losing_them' END, CASE WHEN f5 AND coalesce(e13, 0.5) >= 0.5 THEN 'confusion_only' END, CASE WHEN f4 THEN 'hanging_question' END,
  CASE WHEN f10 AND coalesce(e11, 1) < 0.45 THEN 'vague_commitment' END, CASE WHEN f10 AND coalesce(e11, 0) >= 0.45 THEN 'clean_commitment' END,
  CASE WHEN f6 THEN 'objection_price' END, CASE WHEN f7 THEN 'objection_timing' END, CASE WHEN f8 THEN 'objection_authority' END, CASE WHEN f9 THEN 'objection_trust' END,
  CASE WHEN g1 > 0.6 AND e1 > 0.6 AND w1 THEN 'monologue' END, CASE WHEN e2 > 0.6 AND coalesce(e4, 1) < 0.5 THEN 'awkward_silence' END, CASE WHEN f3 THEN 'talking_over' END,
  CASE WHEN f14 THEN 'repeating' END, CASE WHEN f15 THEN 'drifted' END, CASE WHEN f12 THEN 'check_that' END, CASE WHEN f16 AND coalesce(s13, 0) <= 0 THEN 'wrap_up' END], lambda x: x IS NOT NULL)) AS rule FROM q),
p(rule, gap, severity) AS (VALUES ('losing_them', 40, 'alert'), ('confusion_only', 45, 'nudge'), ('hanging_question', 50, 'alert'), ('vague_commitment', 25, 'alert'), ('clean_commitment', 15, 'info'),
  ('objection_price', 45, 'alert'), ('objection_timing', 45, 'nudge'), ('objection_authority', 45, 'nudge'), ('objection_trust', 45, 'alert'), ('monologue', 60, 'nudge'), ('awkward_silence', 30, 'alert'),
  ('talking_over', 20, 'nudge'), ('repeating', 90, 'nudge'), ('drifted', 120, 'nudge'), ('check_that', 25, 'info'), ('wrap_up', 150, 'alert')),
a AS (SELECT h.*, gap, severity, row_number() OVER (PARTITION BY session_id, h.rule ORDER BY t, tick) AS i FROM h JOIN p ON h.rule = p.rule),
c AS (
  SELECT session_id, rule, i, t, tick, severity, true AS keep, t AS last FROM a WHERE i = 1
  UNION ALL
  SELECT a.session_id, a.rule, a.i, a.t, a.tick, a.severity, a.t - c.last >= a.gap, CASE WHEN a.t - c.last >= a.gap THEN a.t ELSE c.last END
  FROM c JOIN a ON a.session_id = c.session_id AND a.rule = c.rule AND a.i = c.i + 1
)
"""
)


@_query(_D + "SELECT session_id, rule, tick, severity FROM c WHERE keep")
def default_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen default rules with their cooldowns. Each event is a sample of one of the seventeen traces, its measures digits of its value."""
    m = F.floor(F.col("raw") * 1_000_000).cast("long")
    rows = judgments(spark, sf_dir).select("session_id", "tick", "t", m.alias("m"))
    key = F.element_at(F.array(*map(F.lit, _DECK_KEYS)), (F.col("m") % 17 + 1).cast("int"))
    state = rows.select(
        "session_id",
        "tick",
        "t",
        key.alias("key"),
        (F.col("m") % 3 == 0).alias("fired"),
        (F.col("m") % 997 / 997).alias("ema"),
        (F.col("m") % 991 / 991 - 0.5).alias("slope"),
        (F.col("m") % 983 / 983).alias("integral30"),
        (F.col("m") % 2 == 0).alias("warm"),
    )
    state = state.withColumn("fire", F.lit(None).cast("double"))
    hits = rules.candidates(rules.wide_state(state, _DECK_KEYS, bucket_s=48.0, deck=rules.DEFAULT_RULES))
    return rules.cards(rules.cooled_down(hits)).select("session_id", "rule", "tick", "severity")


# ---- edges with a least slope

_SLOPE_SPECS = [(*s[:7], 0.0005 * s[3], 200.0, *s[7:]) for s in _SPECS]
_SLOPED = (
    f"""WITH RECURSIVE {_J}, {_S},
o AS (SELECT j.*, s.* EXCLUDE (key), row_number() OVER w AS rn, min(t) OVER (PARTITION BY session_id, j.key) AS t0 FROM j JOIN s ON j.key = s.key WINDOW w AS (PARTITION BY session_id, j.key ORDER BY t, tick)),
e AS (
  SELECT session_id, key, rn, raw AS ema FROM o WHERE rn = 1
  UNION ALL
  SELECT o.session_id, o.key, o.rn, e.ema + (1 - exp(-(o.t - p.t) / o.tau)) * (o.raw - e.ema) FROM e JOIN o ON o.session_id = e.session_id AND o.key = e.key AND o.rn = e.rn + 1 JOIN o p ON p.session_id = e.session_id AND p.key = e.key AND p.rn = e.rn
),
b AS (SELECT o.*, e.ema, polarity * CASE WHEN count(*) OVER w >= 3 AND regr_sxx(e.ema, t) OVER w > 1e-12 THEN regr_slope(e.ema, t) OVER w ELSE 0 END AS slope
  FROM o JOIN e ON o.session_id = e.session_id AND o.key = e.key AND o.rn = e.rn WINDOW w AS (PARTITION BY o.session_id, o.key ORDER BY t RANGE BETWEEN 200 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, polarity * ema >= polarity * fire AS inside, max(CASE WHEN polarity * ema >= polarity * fire THEN 0 ELSE rn END) OVER (PARTITION BY session_id, key ORDER BY rn) AS last_out FROM b),
u AS (SELECT *, inside AND t - min(t) OVER (PARTITION BY session_id, key, last_out, inside) >= dwell AND t - t0 >= warmup AND slope >= 0.0005 * polarity AS may, polarity * ema <= polarity * release AS off FROM g),
r AS (
  SELECT session_id, key, tick, rn, t, may AS fired, may AND NOT off AS latched, CASE WHEN may THEN t END AS last_fire FROM u WHERE rn = 1
  UNION ALL
  SELECT session_id, key, tick, rn, t, edge, (was OR edge) AND NOT off, CASE WHEN edge THEN t ELSE last_fire END FROM (
    SELECT u.*, r.latched AS was, r.last_fire, u.may AND NOT r.latched AND (r.last_fire IS NULL OR u.t - r.last_fire >= u.refractory) AS edge FROM r JOIN u ON u.session_id = r.session_id AND u.key = r.key AND u.rn = r.rn + 1))
"""
)


@_query(_SLOPED + "SELECT session_id, key, tick FROM r WHERE fired")
def sloped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that also need a least slope of the smoothed value; no second wording."""
    named = "key string, fire double, release double, polarity double, tau double, dwell double, refractory double, min_slope double, slope_window double, warmup double, unreliable_at double"
    rows = judgments(spark, sf_dir).withColumns({"value": F.col("raw"), "alt": F.lit(None).cast("double")})
    return traces.run_traces(traces.with_specs(rows, spark.createDataFrame(_SLOPE_SPECS, named))).filter("fired").select("session_id", "key", "tick")


# ---- contexts, recorded rows, frames

_LINES = (
    _U
    + """, x AS (SELECT g.session_id, g.tick, g.t, u.t AS said, u.seq, speaker || ': ' || text AS line, row_number() OVER (PARTITION BY g.session_id, g.tick ORDER BY u.t DESC, u.seq DESC) AS n
  FROM g JOIN u ON u.session_id = g.session_id AND g.t - u.t BETWEEN 0 AND 20),
y AS (SELECT session_id, tick, string_agg(line, chr(10) ORDER BY said, seq) AS lines FROM x WHERE n <= 2 GROUP BY session_id, tick)"""
)


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.rolling_context(ticks(spark, sf_dir), utterances(spark, sf_dir), 20.0, 10_000_000)


@_query(_LINES + "SELECT g.session_id, g.tick, coalesce(lines, '') AS lines FROM g LEFT JOIN y ON g.session_id = y.session_id AND g.tick = y.tick")
def last_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir).select("session_id", "tick", F.array_join(context.last_lines(F.col("lines"), 2), "\n").alias("lines"))


def _tick_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two traces of each conversation: digits of its ticks' numbers."""
    rows = ticks(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    m = (F.col("session_id") * 7919 + F.col("tick") * 104729 + F.col("k") * 31) % 1009
    return rows.select("session_id", "tick", "t", F.when(F.col("k") == 0, "ask").otherwise("pick:a").alias("key"), (m / 1009).alias("raw"), (1 - m / 1009).alias("alt"), (m / 2018).alias("ema"))


@_query(
    _LINES
    + """, v AS (SELECT g.*, k, ((session_id * 7919 + tick * 104729 + k * 31) % 1009) AS m FROM g, range(0, 2) z(k)),
b AS (SELECT *, row_number() OVER (PARTITION BY session_id, k, least(CAST(floor(m / 1009 * 10) AS INT), 9) ORDER BY t, tick) AS n FROM v)
SELECT b.session_id, CASE k WHEN 0 THEN 'ask' ELSE 'pick:a' END AS key, round(m / 1009, 4) AS raw, CAST(NULL AS BOOLEAN) AS truth, round(b.t, 2) AS t, b.tick, round(m / 2018, 4) AS ema, round(1 - m / 1009, 4) AS alt,
  CASE k WHEN 0 THEN 'Did they agree?' ELSE 'What do they want? — is it ''a'' (an answer)?' END AS instructions, coalesce(lines, '') AS context
FROM b LEFT JOIN y ON b.session_id = y.session_id AND b.tick = y.tick WHERE n <= 1"""
)
def recorded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled rows with question, rounded measures and the last two lines, as they are written for labelling."""
    kept = sampling.quota_sample(_tick_samples(spark, sf_dir), 1)
    table = spark.createDataFrame([("ask", "Did they agree?", []), ("pick", "What do they want?", [("a", "an answer")])], "id string, instructions string, criteria array<struct<option:string,label:string>>")
    rows = sampling.recorded_rows(kept, _contexts(spark, sf_dir), table)
    return rows.withColumn("context", F.array_join("context", "\n"))


@_query(
    _LINES
    + """, q AS (SELECT 'p' || p_partkey AS id, p_name AS name FROM part WHERE p_partkey < 1)
SELECT g.session_id, g.tick, CASE WHEN n IS NULL THEN 0 ELSE n END AS lines, 2 AS questions, 'noul' AS kind, (SELECT name FROM q) AS instructions
FROM g LEFT JOIN (SELECT session_id, tick, count(*) AS n FROM x GROUP BY session_id, tick) k ON g.session_id = k.session_id AND g.tick = k.tick"""
)
def payload_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload with its questions, read again from its JSON: p0 with the first wording, p1 of a choice with two."""
    table = part_channels(spark, sf_dir).filter("id IN ('p0', 'p3')").withColumn("alt", F.lit(""))
    rows = context.payloads(_contexts(spark, sf_dir), questions=answers.questions(table))
    body = F.from_json("payload", "state struct<recent_conversation:array<string>>, questions map<string, struct<type:string,instructions:string>>")
    first = body["questions"]["p0"]
    return rows.select("session_id", "tick", F.coalesce(F.size(body["state"]["recent_conversation"]), F.lit(0)).cast("long").alias("lines"), F.size(body["questions"]).alias("questions"), first["type"].alias("kind"), first["instructions"].alias("instructions"))


@_query(
    _COOL.replace(
        "k AS (SELECT c.session_id",
        """e AS (SELECT session_id, tick, t, CASE WHEN key = 'error' THEN raw END AS eventful, row_number() OVER (PARTITION BY session_id ORDER BY t, tick) AS rn FROM j), g AS (
  SELECT session_id, tick, t, rn, true AS open, t AS last FROM e WHERE rn = 1
  UNION ALL
  SELECT session_id, tick, t, rn, open, CASE WHEN open THEN t ELSE last END FROM (
    SELECT e.session_id, e.tick, e.t, e.rn, g.last, coalesce(e.t < 24 OR e.t - g.last > 72 OR e.eventful >= 0.62, false) AS open FROM g JOIN e ON e.session_id = g.session_id AND e.rn = g.rn + 1)
), k AS (SELECT c.session_id""",
    )
    + """, fr AS (SELECT r.session_id, r.tick, r.t, """
    + ", ".join(
        f"last_value(CASE WHEN r.key = '{k}' THEN struct_pack(raw := round(j.raw, 4), ema := round(r.ema, 4), dis := round(r.dis, 4), n := r.fire_count, latched := r.latched, warm := r.warm, ill := coalesce(r.dis > s.unreliable_at, false)) END IGNORE NULLS) OVER o AS {k}" for k in ("click", "error")
    )
    + """ FROM r JOIN j ON r.session_id = j.session_id AND r.tick = j.tick JOIN s ON r.key = s.key WINDOW o AS (PARTITION BY r.session_id ORDER BY r.t, r.tick ROWS UNBOUNDED PRECEDING)),
spoken AS (SELECT user_id AS session_id, event_id AS tick, sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 72000000000 PRECEDING AND CURRENT ROW) AS tokens FROM events),
h2 AS (SELECT session_id, tick, string_agg(rule, ',' ORDER BY rule) AS cards FROM k GROUP BY session_id, tick)
SELECT fr.session_id, fr.tick, open, coalesce(cards, '') AS cards, """
    + ", ".join(f"{k}.raw AS {k}_raw, {k}.ema AS {k}_ema, {k}.dis AS {k}_dis, {k}.n AS {k}_fires, {k}.latched AS {k}_latched, {k}.warm AS {k}_warm, {k}.ill AS {k}_ill" for k in ("click", "error"))
    + """, CAST(tokens AS BIGINT) AS tokens FROM fr JOIN g ON fr.session_id = g.session_id AND fr.tick = g.tick LEFT JOIN h2 ON fr.session_id = h2.session_id AND fr.tick = h2.tick JOIN spoken n ON n.session_id = fr.session_id AND n.tick = fr.tick"""
)
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each tick: the latest of two traces, the gate, the cards and the tokens of the last 20 hours."""
    j = judgments(spark, sf_dir)
    opened = gate.gate_decisions(j.select("session_id", "tick", "t", F.when(F.col("key") == "error", F.col("raw")).alias("eventful")), 24.0, 72.0, 0.62)
    w = traces.trailing(20 * 3600.0, ("session_id",))
    tokens = calls(spark, sf_dir).withColumn("t", F.col("t") * 3600).select("session_id", "tick", F.sum("input_tokens").over(w).alias("tokens"))
    out = outputs(spark, sf_dir).withColumn("raw", F.col("value"))
    rows = rules.frames(out, base._KEYS, opened, _cards(spark, sf_dir), meter=tokens)
    shown = {"raw": "raw", "ema": "ema", "disagreement": "dis", "fire_count": "fires", "latched": "latched", "warm": "warm", "unreliable": "ill"}
    one = [F.try_element_at("traces", F.lit(k))[m].alias(f"{k}_{n}") for k in ("click", "error") for m, n in shown.items()]
    return rows.select("session_id", "tick", "open", F.array_join("cards", ",").alias("cards"), *one, F.col("meter")["tokens"].alias("tokens"))


@_query(
    f"""WITH {_J}, c AS (SELECT session_id, t, tick, CASE WHEN raw > 0.6 THEN 'a' WHEN raw > 0.3 THEN 'b' ELSE 'true' END AS value FROM j WHERE key = 'signup'),
v AS (SELECT j.session_id, j.tick, (SELECT value FROM c WHERE c.session_id = j.session_id AND c.t <= j.t ORDER BY c.t DESC, c.tick DESC LIMIT 1) AS value FROM j WHERE key = 'click')
SELECT session_id, tick, 'pick:' || o AS key, value = o AS truth FROM v, (VALUES ('a'), ('b')) z(o) WHERE value IS NOT NULL UNION ALL SELECT session_id, tick, 'ask', true FROM v WHERE value = 'true'"""
)
def choice_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth of choices and of a yes-or-no question from one log of changes; values that are no truth of a trace give no row."""
    j = judgments(spark, sf_dir)
    value = F.when(F.col("raw") > 0.6, "a").when(F.col("raw") > 0.3, "b").otherwise("true")
    changes = j.filter("key = 'signup'").select("session_id", "t", F.lit("x").alias("channel"), value.alias("value"))
    at = context.truth_at(j.filter("key = 'click'").select("session_id", "tick", "t"), changes)
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(kind).alias("kind"), F.lit(o).cast("string").alias("option")) for k, kind, o in (("ask", "noul", None), ("pick:a", "choice", "a"), ("pick:b", "choice", "b"), ("rate", "score", None)))))
    rows = at.withColumn("c", kinds).select("session_id", "tick", "c.key", context.trace_truth(F.col("c.kind"), F.col("c.option"), F.col("truth")).alias("truth"))
    return rows.filter("truth IS NOT NULL")


@_query(_U + ", n AS (SELECT g.session_id, g.tick, count(u.seq) AS n FROM g LEFT JOIN u ON u.session_id = g.session_id AND g.t - u.t BETWEEN 0 AND 20 GROUP BY ALL) SELECT session_id, tick, n / 10.0::DOUBLE AS noul FROM n")
def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's model over the windows, by batches: here a tenth of the lines."""

    def model(batch):
        return batch.assign(noul=batch["n"] / 10.0)[["session_id", "tick", "noul"]]

    windows = _contexts(spark, sf_dir).select("session_id", "tick", F.size("lines").alias("n"))
    return transcripts.score_windows(windows, model, "session_id long, tick long, noul double")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a user's model on the contexts' payloads: a tenth of the lines, but nothing about windows of three."""

    def load():
        def model(payloads):
            for p in payloads:
                n = len(p.get("recent_conversation", ()))
                if n == 3:
                    raise RuntimeError("three")
                yield {"answers": {"ask": n / 10, "pick": {"choice": "a", "probabilities": {"a": n / 20}}}, "input_tokens": n, "model": "lines"}

        return model

    return scoring.score_calls(context.payloads(_contexts(spark, sf_dir)), load)


_SCORED = _U + ", n AS (SELECT g.session_id, g.tick, count(u.seq) AS n FROM g LEFT JOIN u ON u.session_id = g.session_id AND g.t - u.t BETWEEN 0 AND 20 GROUP BY ALL) "


@_query(_SCORED + "SELECT CAST(session_id AS VARCHAR) AS session_id, tick, key, coalesce(round(n / d, 6), 0)::DOUBLE AS raw FROM n, (VALUES ('ask', 10.0), ('pick:a', 20.0), ('pick:b', NULL)) z(key, d) WHERE n <> 3")
def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments of a user's model's answers; failed calls give none."""
    table = spark.createDataFrame([("ask", "noul", [], [], ""), ("pick", "choice", [("a", "A"), ("b", "B")], ["a", "b"], "")], "id string, kind string, criteria array<struct<option:string,label:string>>, watch array<string>, alt string")
    return answers.parse_answers(_scored(spark, sf_dir), table).select("session_id", "tick", "key", *_r("raw"))


@_query(_SCORED + "SELECT CAST(session_id AS VARCHAR) AS session_id, count(*) AS calls, CAST(sum(CASE WHEN n <> 3 THEN n ELSE 0 END) AS BIGINT) AS tokens, count(*) FILTER (n = 3) AS errors FROM n GROUP BY session_id")
def scored_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meter's totals of a user's model's calls, failed ones among them."""
    return meter.totals(_scored(spark, sf_dir)).select("session_id", "calls", "tokens", "errors")


# ---- meter, accuracy, detectors


@_query(
    base._C
    + """SELECT session_id, tick, round(x * 3600 / 1e6 * 0.042, 6) AS dollars_per_hour, round(x / 250000 * 100, 6) AS tok_limit_pct, round(y / 1200 * 100, 6) AS req_limit_pct FROM (
  SELECT session_id, tick, sum(input_tokens) OVER w / greatest(t - min(t) OVER w, 0.001) AS x, count(*) OVER w / greatest(t - min(t) OVER w, 0.001) * 60 AS y
  FROM (SELECT *, CAST(round(t * 1000000) AS BIGINT) AS us FROM c) WINDOW w AS (PARTITION BY session_id ORDER BY us RANGE BETWEEN 20000000 PRECEDING AND CURRENT ROW))"""
)
def meter_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meter.rolling_rates(calls(spark, sf_dir)).select("session_id", "tick", *_r("dollars_per_hour", "tok_limit_pct", "req_limit_pct"))


@_query(_L + ", b(key, bound) AS (VALUES ('en', 0.5), ('fr', (0.74 + 0.26 / 3) / 2)) SELECT l.key, count(*) AS n, round(avg(CAST((raw >= coalesce(bound, 0.5)) = truth AS INT)), 4) AS accuracy FROM l LEFT JOIN b ON l.key = b.key WHERE truth IS NOT NULL GROUP BY l.key")
def bounded_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by the channels' own bounds: the language fr stands for a choice of four."""
    options = [(o, o) for o in "abcd"]
    table = spark.createDataFrame([("en", "noul", [], []), ("fr", "choice", options, [])], "id string, kind string, criteria array<struct<option:string,label:string>>, watch array<string>")
    table = table.withColumns({"p_hit": F.lit(None).cast("double"), "p_miss": F.lit(None).cast("double")})
    return calibration.boundary_accuracy(pairs(spark, sf_dir), calibration.decision_bounds(table))


@_query(
    _TRACE
    + """, x AS (SELECT 'latched' AS detector, session_id, key, max(CAST(fired AS INT)) AS hit FROM r GROUP BY 2, 3 UNION ALL SELECT 'naive', session_id, key, max(CAST(raw >= 0.95 AS INT)) FROM j GROUP BY 2, 3),
e AS (SELECT session_id, key, avg(raw) > 0.6 AS truth FROM j GROUP BY session_id, key)
SELECT detector, round(avg(hit) FILTER (truth), 6) AS recall, round(avg(hit) FILTER (NOT truth), 6) AS false_positive_rate, count(*) AS episodes FROM x JOIN e ON x.session_id = e.session_id AND x.key = e.key GROUP BY detector"""
)
def compared_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived bands against a naive line on the same data."""
    j = judgments(spark, sf_dir)
    episodes = j.groupBy("session_id", "key").agg((F.avg("raw") > 0.6).alias("truth"))
    columns = ["session_id", "key", "fired", "detector"]
    both = outputs(spark, sf_dir).withColumn("detector", F.lit("latched")).select(columns)
    both = both.unionByName(j.withColumns({"detector": F.lit("naive"), "fired": F.col("raw") >= 0.95}).select(columns))
    rows = evaluate.detector_quality(both, episodes)
    return rows.select("detector", *_r("recall", "false_positive_rate"), "episodes")


# ---- curves


def _curve_sql(rows: str, most: int) -> str:
    """SQL of ``v(key, i, n, x, y)``, the curve's points in order, fitted on rows (key, x, n, y), each block end where the averages on its left never exceed those on its right."""
    return f"""p AS ({rows}),
o AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(y) OVER w AS cy FROM p WINDOW w AS (PARTITION BY key ORDER BY x)),
m AS (SELECT a.key, a.i AS j, b.i AS k, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS mean FROM o a JOIN o b ON a.key = b.key AND a.i <= b.i),
z AS (SELECT o.*, (SELECT max(mean) FROM m WHERE m.key = o.key AND m.k = o.i) AS before, (SELECT min(mean) FROM m WHERE m.key = o.key AND m.j = o.i + 1) AS after FROM o),
t AS (SELECT key, x, cn - coalesce(lag(cn) OVER w, 0) AS n, cy - coalesce(lag(cy) OVER w, 0) AS y FROM z WHERE after IS NULL OR before <= after + 1e-12 WINDOW w AS (PARTITION BY key ORDER BY x)),
q AS (SELECT key, x, y / n AS y, row_number() OVER (PARTITION BY key ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY key) AS blocks FROM t),
thin AS (SELECT * FROM q WHERE blocks <= {most} OR i IN (SELECT CAST(round_even(g * (blocks - 1) / {most - 1}.0, 0) AS BIGINT) FROM range(0, {most}) r(g))),
ends AS (SELECT key, x, y FROM thin UNION ALL SELECT key, 0, min(y) FROM thin GROUP BY key HAVING min(x) > 0 UNION ALL SELECT key, 1, max(y) FROM thin GROUP BY key HAVING max(x) < 1),
v AS (SELECT key, x, y, row_number() OVER (PARTITION BY key ORDER BY x, y) AS i FROM ends)"""


@_query(_L + ", " + _curve_sql("SELECT key, round(raw, 4) AS x, count(*) AS n, sum(CAST(truth AS INT)) AS y FROM l WHERE truth IS NOT NULL GROUP BY 1, 2", 6) + " SELECT key, CAST(i AS INT) AS i, round(x, 4) AS x, round(y, 6) AS y FROM v")
def thinned_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of at most six points before their ends are level to 0 and 1."""
    curves = calibration.fit_curves(pairs(spark, sf_dir), least=1, most_points=6)
    return curves.select("key", F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "p")).select("key", (F.col("i") + 1).alias("i"), F.round("p.xs", 4).alias("x"), F.round("p.ys", 6).alias("y"))


_HALF = "md5(CAST(tick AS VARCHAR) || '|0') < '8'"


@_query(
    _ACC
    + ", "
    + _curve_sql(f"SELECT key, round(raw, 4) AS x, count(*) AS n, sum(CAST(truth AS INT)) AS y FROM l WHERE truth IS NOT NULL AND {_HALF} GROUP BY 1, 2", 24)
    + f""", w AS (SELECT key, [x FOR x IN list(struct_pack(x := x, y := y) ORDER BY i)] AS c FROM v GROUP BY key),
u AS (SELECT l.key, round(raw, 4) AS raw, CAST(truth AS INT) AS y, c, len(list_filter(c, lambda p: p.x < round(raw, 4))) AS n FROM l JOIN w ON l.key = w.key WHERE truth IS NOT NULL AND NOT {_HALF}),
a AS (SELECT key, raw, y, CASE WHEN n = 0 THEN c[1].y WHEN n >= len(c) THEN c[len(c)].y ELSE c[n].y + (c[n + 1].y - c[n].y) * (raw - c[n].x) / (c[n + 1].x - c[n].x) END AS value FROM u),
e AS (SELECT key, sum(n * abs(p - y)) / sum(n) AS ece FROM (SELECT key, {_BIN} AS bin, count(*) AS n, avg(raw) AS p, avg(y) AS y FROM a GROUP BY 1, 2) GROUP BY key),
f AS (SELECT key, sum(n * abs(p - y)) / sum(n) AS ece FROM (SELECT key, {_BIN.replace("raw", "value")} AS bin, count(*) AS n, avg(value) AS p, avg(y) AS y FROM a GROUP BY 1, 2) GROUP BY key)
SELECT m.key, m.n, CASE WHEN m.n >= 80 THEN m.accuracy END AS accuracy, CASE WHEN m.n >= 80 THEN round(e.ece, 6) END AS ece_before, CASE WHEN m.n >= 80 THEN round(f.ece, 6) END AS ece_after,
  CASE WHEN m.n < 80 THEN 'too few' WHEN f.ece < e.ece THEN 'keep' ELSE 'drop' END AS verdict FROM measured m LEFT JOIN e ON m.key = e.key LEFT JOIN f ON m.key = f.key"""
)
def holdout_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves fitted on half of the labelled documents and judged on the others."""
    rows = calibration.holdout_fit(samples(spark, sf_dir).filter("truth IS NOT NULL"), ["tick"], least=1)
    return rows.select("key", "n", "accuracy", *_r("ece_before", "ece_after"), "verdict")
