"""Preference formatting: one prompt and two masked completions for a chosen and a rejected conversation.

The longest run of first turns that both conversations share (same role, same text) is rendered once, as the prompt; what
follows in each is a completion. Masks are the spans of a completion that are trained on: the text and end mark of its
assistant turns. Everything is built in functions; conversations are put together by one shuffle on their id.

Cases: a null role is rendered as ``unknown``, a null text as empty, but null and empty differ when turns are compared; equal conversations
have all turns in the prompt and empty completions, as has a pair of empty ones; turns with the same number are ordered by
role and text, repeated rows are repeated turns; conversations of any length are read whole; an empty table gives an empty
result; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks around a turn.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TURN = "array<struct<role:string,text:string>>"


def conversations_as_arrays(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row for each conversation: its id and ``turns``, in order."""
    one = F.struct(F.col(turn_column).alias("turn"), F.col(role_column).cast("string").alias("role"), F.col(text_column).cast("string").alias("text"))
    ordered = F.sort_array(F.collect_list(one))
    rows = turns.groupBy(F.col(id_column).alias("conv_id")).agg(ordered.alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def last_reply_pairs(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation: up to its last assistant turn as it is, and with that turn's text replaced by the
    assistant's text before (by nothing, where it is the first). Without assistant turns both sides are the whole."""
    replies = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"), t["text"].alias("text"))), lambda t: t["role"] == "assistant")
    rows = conversations.withColumn("replies", replies).withColumn("n", F.size("replies"))
    last = F.when(F.col("n") > 0, F.element_at("replies", -1)["i"] + 1).otherwise(F.size("turns"))
    before = F.when(F.col("n") > 1, F.try_element_at("replies", F.lit(-2))["text"]).otherwise("")
    rows = rows.withColumns({"last": last, "before": before}).withColumn("chosen", F.slice("turns", F.lit(1), F.col("last")))
    swapped = F.transform("chosen", lambda t, i: F.struct(t["role"].alias("role"), F.when((F.col("n") > 0) & (i == F.col("last") - 1), F.col("before")).otherwise(t["text"]).alias("text")))
    return rows.select(F.col("conv_id").alias("pair_id"), "chosen", swapped.alias("rejected"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("unknown")), F.lit(CLOSE), F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask(turns: Column) -> Column:
    """The trained spans of rendered turns, as ``start:end`` joined by commas."""

    def add(state: Column, turn: Column) -> Column:
        size = F.length(rendered(turn))
        head = F.length(F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("unknown")), F.lit(CLOSE)))
        span = F.concat((state["at"] + head).cast("string"), F.lit(":"), (state["at"] + size).cast("string"))
        spans = F.when(turn["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + size).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, add, lambda s: s["spans"]), ",")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Pairs (pair_id, chosen, rejected: arrays of role and text) as prompt, completions and masks."""
    pairs = pairs.select("pair_id", *(F.coalesce(F.col(c), F.array()).cast(TURN).alias(c) for c in ("chosen", "rejected")))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, F.lit(False)).cast("int")
    shared = F.when(first == 0, shorter).otherwise(F.least(first - 1, shorter))
    rows = pairs.withColumn("n_prompt_turns", shared)
    rest = lambda side: F.slice(side, F.col("n_prompt_turns") + 1, F.greatest(F.size(side) - F.col("n_prompt_turns"), F.lit(0)))
    rows = rows.withColumns({"prompt_turns": F.slice("chosen", F.lit(1), F.col("n_prompt_turns")), "chosen": rest("chosen"), "rejected": rest("rejected")})
    return rows.select(
        "pair_id",
        "n_prompt_turns",
        _joined(F.col("prompt_turns")).alias("prompt"),
        _joined(F.col("chosen")).alias("chosen"),
        _joined(F.col("rejected")).alias("rejected"),
        mask(F.col("chosen")).alias("chosen_mask"),
        mask(F.col("rejected")).alias("rejected_mask"),
    )


#: DuckDB SQL for op8: each conversation's pair, turn by turn.
ORACLE = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations
), l AS (
  SELECT conv_id, max(i) AS n, max(CASE WHEN role = 'assistant' THEN i END) AS last FROM t GROUP BY conv_id
), p AS (
  SELECT t.conv_id, max(t.i) AS prev FROM t JOIN l ON t.conv_id = l.conv_id AND t.i < l.last WHERE t.role = 'assistant' GROUP BY t.conv_id
), b AS (
  SELECT l.conv_id, coalesce(l.last, l.n) AS upto, l.last, CASE WHEN p.prev IS NULL THEN '' ELSE q.text END AS before
  FROM l LEFT JOIN p ON l.conv_id = p.conv_id LEFT JOIN t q ON q.conv_id = p.conv_id AND q.i = p.prev
), s AS (
  SELECT t.conv_id, t.i, t.role, t.text AS c, CASE WHEN t.i = b.last THEN b.before ELSE t.text END AS r
  FROM t JOIN b ON t.conv_id = b.conv_id AND t.i <= b.upto
), cut AS (
  SELECT conv_id, coalesce(min(CASE WHEN c IS DISTINCT FROM r THEN i END), max(i) + 1) AS cut FROM s GROUP BY conv_id
), f AS (
  SELECT s.conv_id, i, cut, role,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS head,
    coalesce(c, '') || '<|end|>' || chr(10) AS ct, coalesce(r, '') || '<|end|>' || chr(10) AS rt
  FROM s JOIN cut ON s.conv_id = cut.conv_id
), o AS (
  SELECT *,
    coalesce(sum(CASE WHEN i >= cut THEN length(head) + length(ct) END) OVER w, 0) AS ca,
    coalesce(sum(CASE WHEN i >= cut THEN length(head) + length(rt) END) OVER w, 0) AS ra
  FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id, CAST(any_value(cut) - 1 AS INT) AS n_prompt_turns,
  coalesce(string_agg(CASE WHEN i < cut THEN head || ct END, '' ORDER BY i), '') AS prompt,
  coalesce(string_agg(CASE WHEN i >= cut THEN head || ct END, '' ORDER BY i), '') AS chosen,
  coalesce(string_agg(CASE WHEN i >= cut THEN head || rt END, '' ORDER BY i), '') AS rejected,
  coalesce(string_agg(CASE WHEN i >= cut AND role = 'assistant' THEN (ca + length(head)) || ':' || (ca + length(head) + length(ct)) END, ',' ORDER BY i), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN i >= cut AND role = 'assistant' THEN (ra + length(head)) || ':' || (ra + length(head) + length(rt)) END, ',' ORDER BY i), '') AS rejected_mask
FROM o GROUP BY conv_id
"""
