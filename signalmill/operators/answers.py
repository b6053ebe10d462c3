"""Operators on model answers: the question table, parsing into judgments, plain wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALT = "~alt"


def questions(channels: DataFrame) -> DataFrame:
    """One row for each question: both wordings of each channel, options only for choices and scores."""
    criteria = F.when(F.col("kind").isin("choice", "score"), F.col("criteria"))
    first = F.struct(F.col("id").alias("question_id"), F.col("instructions").alias("instructions"))
    second = F.when(F.length("alt") > 0, F.struct(F.concat("id", F.lit(ALT)).alias("question_id"), F.col("alt").alias("instructions")))
    rows = channels.select("id", "kind", "tier", criteria.alias("criteria"), F.explode(F.array_compact(F.array(first, second))).alias("q"))
    return rows.select("q.question_id", F.col("id").alias("channel"), "kind", "tier", "q.instructions", "criteria")


def answer_value(kind: Column, levels: Column, answer: Column, option: Column) -> Column:
    """An answer as one number from 0 to 1: yes by its probability, an option by its share, a score by its place on the scale."""
    scaled = F.coalesce(answer["score"], F.lit(0.0)) / F.greatest(levels - 1, F.lit(1))
    share = F.coalesce(F.try_element_at(answer["probabilities"], option), F.lit(0.0))
    return F.when(kind == "noul", F.coalesce(answer["noul"], F.lit(0.0))).when(kind == "choice", share).otherwise(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))


def parse_answers(calls: DataFrame, channels: DataFrame) -> DataFrame:
    """Rows (session_id, tick, t, answers) to judgments (session_id, tick, t, key, raw, alt).

    No row without the first wording's answer; alt is null without the second's. Choices give a row for each watched option.
    """
    options = F.when(F.col("kind") == "choice", F.col("watch")).otherwise(F.array(F.lit(None).cast("string")))
    small = channels.select(F.col("id"), F.col("kind"), F.size(F.coalesce("criteria", F.array())).alias("levels"), F.explode(options).alias("option"), (F.length("alt") > 0).alias("twice"))
    asked = calls.select("session_id", "tick", "t", F.explode("answers").alias("id", "first"), "answers").filter(~F.col("id").endswith(ALT))
    rows = asked.join(small, "id").filter(F.col("first").isNotNull())
    second = F.when(F.coalesce("twice", F.lit(False)), F.try_element_at("answers", F.concat("id", F.lit(ALT))))
    rows = rows.withColumn("second", second)
    value = lambda a: answer_value(F.col("kind"), F.col("levels"), F.col(a), F.col("option"))
    alt = F.when(F.col("second").isNotNull(), value("second"))
    return rows.select("session_id", "tick", "t", F.concat_ws(":", "id", "option").alias("key"), value("first").alias("raw"), alt.alias("alt"))


def merged_answers(gate: DataFrame, bank: DataFrame) -> DataFrame:
    """The answers of a tick's two calls in one map; the bank's win where both have one."""
    both = gate.select("session_id", "tick", "t", F.col("answers").alias("a")).join(bank.select("session_id", "tick", F.col("answers").alias("b")), ["session_id", "tick"], "left")
    kept = F.map_filter("a", lambda k, _: ~F.coalesce(F.map_contains_key("b", k), F.lit(False)))
    return both.select("session_id", "tick", "t", F.when(F.col("b").isNull(), F.col("a")).otherwise(F.map_concat(kept, "b")).alias("answers"))


def plain_question(traces: DataFrame, channels: DataFrame) -> DataFrame:
    """Adds ``question`` to rows with a trace key: the wording, and for a choice which option is meant."""
    small = channels.select(F.col("id").alias("_id"), "instructions", F.map_from_arrays("criteria.option", "criteria.label").alias("_labels"))
    option = F.when(F.contains("key", F.lit(":")), F.substring_index("key", ":", -1))
    rows = traces.join(small, F.substring_index("key", ":", 1) == F.col("_id"), "left").withColumn("_option", option)
    label = F.coalesce(F.try_element_at("_labels", F.col("_option")), F.col("_option"))
    long = F.format_string("%s — is it '%s' (%s)?", "instructions", "_option", label)
    return rows.withColumn("question", F.when(F.col("_option").isNull(), F.col("instructions")).otherwise(long)).drop("_id", "instructions", "_labels", "_option")
