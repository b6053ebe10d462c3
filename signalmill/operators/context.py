"""Operators on transcripts: tick grids, rolling context, silence, the last question, model payloads.

Utterances are rows (session_id, seq, t, speaker, text); ticks are rows (session_id, tick, t).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import unused
from .asof import BUCKET_S, last_known


def tick_grid(utterances: DataFrame, rate_hz: float = 5.0, tail_s: float = 6.0) -> DataFrame:
    """Ticks step / rate of each session, to ``tail_s`` after its last utterance."""
    ends = utterances.groupBy("session_id").agg(F.max("t").alias("last"))
    steps = ((F.col("last") + tail_s) * rate_hz).cast("long")
    ticks = ends.filter(steps > 0).select("session_id", F.explode(F.sequence(F.lit(0), steps - 1)).alias("tick"))
    return ticks.withColumn("t", F.col("tick") / rate_hz)


def on_grid(t: Column, rate_hz: float = 5.0) -> Column:
    """The time of the first tick at or after t."""
    return F.ceil(t * rate_hz) / rate_hz


def transcript_line(speaker: Column, text: Column) -> Column:
    return F.concat(F.coalesce(speaker, F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")))


def in_window(ticks: DataFrame, utterances: DataFrame, window_s: float) -> DataFrame:
    """Ticks with each utterance that is at most ``window_s`` old: a range join by buckets of that length.

    Each utterance stands in two buckets at most, so a session's rows spread over the buckets of its time; text is left out.
    """
    slot = lambda t: F.floor(t / window_s).cast("long")
    lines = utterances.select("session_id", "seq", F.col("t").alias("said"), F.length(transcript_line(F.col("speaker"), F.col("text"))).alias("chars"))
    lines = lines.withColumn("slot", F.explode(F.array(slot(F.col("said")), slot(F.col("said")) + 1)))
    asked = ticks.withColumn("slot", slot(F.col("t")))
    age = F.col("t") - F.col("said")
    return asked.join(lines, ["session_id", "slot"]).filter((age >= 0) & (age <= window_s)).drop("slot")


def rolling_context(ticks: DataFrame, utterances: DataFrame, window_s: float = 45.0, max_chars: int = 3000, most: int = 400) -> DataFrame:
    """For each tick its lines, oldest first: those of the window, from the newest back while they and one more character each fit.

    A newest line that does not fit leaves no lines. Only the ``most`` newest utterances are kept. Ticks and lines are shuffled once, by session and
    a slot of time, a line into its slot and the next; no pairs of them are made. In a slot the lines' lengths are added up, and each tick finds its
    first and last line by binary search. Ticks without a session or a time have no lines.
    """
    slot_s = max(window_s, 600.0)
    slot, said, seq, line, chars, kind = (unused(ticks, c) for c in ("slot", "said", "seq", "line", "chars", "kind"))
    at = lambda t: F.floor(F.col(t) / slot_s)
    text = transcript_line(F.col("speaker"), F.col("text"))
    lines = utterances.filter("session_id IS NOT NULL AND t IS NOT NULL").select("session_id", F.col("t").cast("double").alias(said), F.col("seq").alias(seq), text.alias(line), F.lit(0).alias(kind))
    lines = lines.withColumn(slot, F.explode(F.array(at(said), at(said) + 1))).withColumn(chars, F.length(line).cast("long"))
    asked = ticks.withColumns({slot: at("t"), said: F.col("t").cast("double"), kind: F.lit(1)})
    order = ["session_id", slot, kind, said, seq]
    rows = asked.unionByName(lines, allowMissingColumns=True).repartition("session_id", slot).sortWithinPartitions(*order).select(*ticks.columns, slot, kind, said, chars, line)
    schema = T.StructType([*ticks.schema.fields, T.StructField("lines", T.ArrayType(T.StringType()))])
    names, here = schema.names, ticks.columns.index("session_id")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times, sizes, texts = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            *own, slots, kinds, when, lengths, content = batch.columns
            keys = list(zip(batch.column(here).to_pylist(), slots.to_pylist(), strict=True))
            starts = [*(i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]), len(keys)]
            is_tick, found = kinds.to_numpy() == 1, []
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if keys[i] != now:
                    now, times, sizes, texts = keys[i], [], [], []
                cut = i + int((~is_tick[i:j]).sum())
                times += when.slice(i, cut - i).to_pylist()
                sizes += lengths.slice(i, cut - i).to_pylist()
                texts += content.slice(i, cut - i).to_pylist()
                if cut == j:
                    continue
                t, known = when.slice(cut, j - cut).to_numpy(zero_copy_only=False).astype(float), np.array(times, float)
                low, high = windows_of(t, known, np.array(sizes, np.int64), window_s, max_chars, most)
                found += [texts[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            if found:
                columns = [c.filter(pa.array(is_tick)) for c in own]
                # a line is in many windows, so few of them are written out at a time
                for a in range(0, len(found), 256):
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, 256) for c in columns), pa.array(found[a : a + 256], pa.list_(pa.string()))], names=names)

    return rows.mapInArrow(gather, schema)


def windows_of(t: np.ndarray, said: np.ndarray, chars: np.ndarray, window_s: float, max_chars: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each time the first and the end of its lines, among lines in order of the times they were said and with these lengths."""
    high = np.where(np.isnan(t), 0, np.searchsorted(said, t, "right"))
    low = np.searchsorted(said, t - window_s)
    n = len(said)
    # the edge is where t - said says so
    while (back := (low > 0) & (t - said[np.maximum(low - 1, 0)] <= window_s) if n else np.zeros(len(t), bool)).any():
        low = low - back
    while (on := (low < high) & (t - said[np.minimum(low, n - 1)] > window_s) if n else np.zeros(len(t), bool)).any():
        low = low + on
    upto = np.concatenate(([0], np.cumsum(chars + 1)))
    fits = np.searchsorted(upto, upto[high] - max_chars)
    low = np.maximum.reduce([low, fits, high - most])
    return np.minimum(low, high), high


def last_lines(lines: Column, n: int) -> Column:
    """The last n lines of an ordered array."""
    return F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n))


def payloads(contexts: DataFrame, agenda: Column | None = None, brief: Column | None = None, questions: DataFrame | None = None) -> DataFrame:
    """Adds ``payload``, JSON of the recent conversation and, where given, agenda and brief; empty fields are left out.

    With ``questions`` (rows of ``answers.questions``) that is the payload's ``state``, beside the map of all questions: one short row."""
    fields = [F.when(F.size("lines") > 0, F.col("lines")).alias("recent_conversation")]
    for value, name in ((agenda, "agenda"), (brief, "brief")):
        if value is not None:
            fields.append(F.when(F.length(value) > 0, value).alias(name))
    if questions is None:
        return contexts.withColumn("payload", F.to_json(F.struct(*fields)))
    body = F.struct(F.col("kind").alias("type"), "instructions", F.col("criteria.option").alias("criteria"))
    asked = questions.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("question_id", body)))).alias("questions"))
    state = F.struct(*fields).alias("state")
    return contexts.crossJoin(asked).withColumn("payload", F.to_json(F.struct(state, "questions"))).drop("questions")


#: Ticks and utterances in one order of time, utterances first.
_ORDER = ("t", "kind", "seq", "tick")


def _merged(ticks: DataFrame, utterances: DataFrame, said: dict[str, Column], bucket_s: float) -> DataFrame:
    """Ticks, each with these values of the last utterance up to it that has them."""
    a = utterances.select("session_id", F.lit(None).cast("long").alias("tick"), F.col("t").cast("double").alias("t"), F.lit(0).alias("kind"), F.col("seq").cast("long").alias("seq"), *(c.alias(n) for n, c in said.items()))
    b = ticks.select("session_id", F.col("tick").cast("long").alias("tick"), F.col("t").cast("double").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"))
    return last_known(a.unionByName(b, allowMissingColumns=True), list(said), _ORDER, bucket_s=bucket_s).filter("kind = 1")


def silence(ticks: DataFrame, utterances: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """For each tick the seconds since the last utterance (0 with none) and the last speaker."""
    rows = _merged(ticks, utterances, {"last": F.struct(F.col("t").cast("double").alias("said"), "speaker")}, bucket_s)
    quiet = F.coalesce(F.col("t") - F.col("last.said"), F.lit(0.0))
    return rows.select("session_id", "tick", "t", quiet.alias("silence_for"), F.col("last.speaker").alias("last_speaker"))


def last_question(ticks: DataFrame, utterances: DataFrame, mark: str = "?", window_s: float = 45.0, most_chars: int = 90, bucket_s: float = BUCKET_S) -> DataFrame:
    """For each tick the newest utterance of the window that holds the mark, trimmed; a long one is cut and ends in ``...``."""
    asked = F.when(F.contains("text", F.lit(mark)), F.struct(F.col("t").cast("double").alias("at"), F.trim("text").alias("text")))
    rows = _merged(ticks, utterances, {"q": asked}, bucket_s)
    text = F.when(F.col("t") - F.col("q.at") <= window_s, F.col("q.text"))
    short = F.when(F.length(text) > most_chars, F.concat(F.substring(text, 1, most_chars - 3), F.lit("..."))).otherwise(text)
    return rows.select("session_id", "tick", "t", F.coalesce(short, F.lit("")).alias("last_question"))


def truth_at(ticks: DataFrame, changes: DataFrame, bucket_s: float = BUCKET_S) -> DataFrame:
    """For each tick and channel the truth in force: the last change (session_id, t, channel, value) at or before it."""
    channels = changes.select("session_id", "channel").distinct()
    asked = ticks.join(channels, "session_id").select("session_id", "channel", "tick", F.col("t").cast("double").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("truth"))
    known = changes.select("session_id", "channel", F.lit(None).cast("long").alias("tick"), F.col("t").cast("double").alias("t"), F.lit(0).alias("kind"), F.col("value").cast("string").alias("truth"))
    rows = last_known(known.unionByName(asked), ["truth"], ("t", "kind", "tick", "truth"), ("session_id", "channel"), bucket_s)
    return rows.filter("kind = 1 AND truth IS NOT NULL").select("session_id", "channel", "tick", "t", "truth")


def trace_truth(kind: Column, option: Column, truth: Column) -> Column:
    """Truth of one trace as a boolean: yes/no as it is, a choice by its option; null for scores and other values."""
    plain = F.when(F.lower(truth).isin("true", "false"), F.lower(truth) == "true")
    return F.when(kind == "noul", plain).when(kind == "choice", truth == option)
