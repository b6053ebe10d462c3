"""Evaluation of sessions: reports, first fires, hits in causal windows, detector quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_report(ticks: DataFrame, calls: DataFrame, cards: DataFrame) -> DataFrame:
    """By session: ticks, calls, cards, the share of ticks that spoke and cards a minute."""
    a = ticks.groupBy("session_id").agg(F.count("*").alias("ticks"), F.max("t").alias("last_t"))
    b = calls.groupBy("session_id").agg(F.count("*").alias("calls"))
    c = cards.groupBy("session_id").agg(F.count("*").alias("cards"))
    rows = a.join(b, "session_id", "left").join(c, "session_id", "left").fillna(0, ["calls", "cards"])
    return rows.select("session_id", "ticks", "calls", "cards", (F.col("cards") / F.col("ticks")).alias("speak_rate"), (F.col("cards") / F.greatest("last_t", F.lit(1.0)) * 60).alias("cards_per_min"))


def fires_by_key(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("session_id", "key").agg(F.count_if("fired").alias("fires"))


def first_fires(cards: DataFrame) -> DataFrame:
    """By session and rule: when it first fired, and how often."""
    return cards.groupBy("session_id", "rule").agg(F.min("t").alias("first_t"), F.count("*").alias("fires"))


def causal_hits(cards: DataFrame, windows: DataFrame, early_s: float = 1.0) -> DataFrame:
    """By session and rule with a causal window (rule, lo, hi): the first fire in it, and fires before its cause."""
    rows = cards.join(windows, "rule")
    inside = F.col("t").between(F.col("lo"), F.col("hi"))
    return rows.groupBy("session_id", "rule").agg(F.min(F.when(inside, F.col("t"))).alias("hit_t"), F.count_if(F.col("t") < F.col("lo") - early_s).alias("early"))


def hit_summary(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """By rule over all sessions (session_id, repeated or not): sessions with a hit, the spread of hit times, the mean of fires before the cause."""
    by_rule = hits.groupBy("rule").agg(F.count("hit_t").alias("hits"), F.stddev_samp("hit_t").alias("hit_sd"), F.sum("early").alias("early"))
    rows = by_rule.crossJoin(sessions.agg(F.count_distinct("session_id").alias("sessions")))
    return rows.select("rule", "hits", "hit_sd", (F.col("early") / F.col("sessions")).alias("early_mean"))


def detector_quality(outputs: DataFrame, episodes: DataFrame) -> DataFrame:
    """Recall and false-positive rate by detector: the share of true and of false episodes (session_id, key, truth) with a fire.

    ``outputs`` may have a column ``detector`` to compare several on the same data.
    """
    rows = outputs if "detector" in outputs.columns else outputs.withColumn("detector", F.lit("all"))
    hit = rows.groupBy("detector", "session_id", "key").agg(F.max(F.col("fired").cast("int")).alias("hit"))
    rows = hit.join(episodes, ["session_id", "key"])
    return rows.groupBy("detector").agg(F.avg(F.when(F.col("truth"), F.col("hit"))).alias("recall"), F.avg(F.when(~F.col("truth"), F.col("hit"))).alias("false_positive_rate"), F.count("*").alias("episodes"))
