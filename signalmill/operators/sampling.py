"""Stratified samples for labelling: quotas, coverage, the queue of what to label, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import checkpointed, unused


def bin_of(raw: Column, bins: int = 10) -> Column:
    """The bin of a value from 0 to 1; 1 falls in the last."""
    return F.least((raw * bins).cast("int"), F.lit(bins - 1))


def quota_sample(judgments: DataFrame, per_bin: int = 25, bins: int = 10, pooled: bool = False) -> DataFrame:
    """The first ``per_bin`` rows of each session, key and bin in order of time (pooled: over all sessions).

    A rank under a filter on it: Spark keeps that many rows of a stratum in each task before the shuffle.
    """
    keys = ["key", "bin"] if pooled else ["session_id", "key", "bin"]
    order = Window.partitionBy(*keys).orderBy("t", "tick", *(["session_id"] if pooled else []))
    rows = judgments.withColumn("bin", bin_of(F.col("raw"), bins)).withColumn("_n", F.row_number().over(order))
    return rows.filter(F.col("_n") <= per_bin).drop("_n")


def sample_rows(kept: DataFrame) -> DataFrame:
    """Sampled rows as they are written for labelling: rounded, with an empty truth."""
    rounded = {c: F.round(c, 4) for c in ("raw", "ema", "alt") if c in kept.columns}
    return kept.withColumns({**rounded, "t": F.round("t", 2), "truth": F.lit(None).cast("boolean")}).drop("bin")


def recorded_rows(kept: DataFrame, contexts: DataFrame, channels: DataFrame, turns: int = 2) -> DataFrame:
    """Sampled rows (session_id, key, raw, t, tick, ema, alt) as labellers need them: with the question in plain words and the last lines
    before them. ``contexts`` are rows (session_id, tick, lines); texts join the few sampled rows only."""
    from .answers import plain_question
    from .context import last_lines

    rows = plain_question(sample_rows(kept), channels).withColumnRenamed("question", "instructions")
    lines = contexts.select("session_id", "tick", last_lines(F.col("lines"), turns).alias("context"))
    rows = rows.join(lines, ["session_id", "tick"], "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
    return rows.select("session_id", "key", "raw", "truth", "t", "tick", "ema", "alt", "instructions", "context")


def coverage(kept: DataFrame) -> DataFrame:
    """Rows kept and different bins filled, by key."""
    return kept.groupBy("key").agg(F.count("*").alias("kept"), F.count_distinct("bin").alias("bins"))


def recording_summary(judgments: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: rows kept and seen, the share kept and the count of keys."""
    seen = judgments.agg(F.count("*").alias("seen"))
    got = kept.agg(F.count("*").alias("kept"), F.count_distinct("key").alias("channels"))
    return got.crossJoin(F.broadcast(seen)).select("kept", "seen", F.when(F.col("seen") > 0, F.col("kept") / F.col("seen") * 100).otherwise(0.0).alias("kept_pct"), "channels")


def thinnest(covered: DataFrame, n: int = 3) -> DataFrame:
    """The keys with the fewest rows to a bin."""
    rows = covered.withColumn("rows_per_bin", F.col("kept") / F.greatest(F.col("bins"), F.lit(1)))
    return rows.orderBy("rows_per_bin", "key").limit(n)


def label_queue(samples: DataFrame, like: str | None = None) -> DataFrame:
    """What is unlabelled, by key and raw, with the place in its key's queue and how many remain there.

    A key may hold most rows, so rows are dealt by ranges of the whole order, each task counts its own, and places follow from the counts:
    a row for each key in each task, which is at most tasks + keys rows.
    """
    rows = samples.filter("truth IS NULL")
    if like:
        rows = rows.filter(F.contains("key", F.lit(like)))
    order = ["key", "raw", "session_id", "tick"]
    part, turn = unused(samples, "part"), unused(samples, "turn")
    number = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # computed once: the cuts are drawn from a sample
    dealt = checkpointed(dealt.withColumns({part: F.shiftright(number, 33), turn: number.bitwiseAND((1 << 33) - 1)}))
    held = dealt.groupBy(F.col("key").alias("_key"), F.col(part).alias("_part")).agg(F.count("*").alias("_n"), F.min(turn).alias("_first"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_key", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_key")).alias("remaining"))
    joined = dealt.join(held, dealt["key"].eqNullSafe(held["_key"]) & (dealt[part] == held["_part"]))
    place = F.col(turn) - F.col("_first") + F.col("_before") + 1
    return joined.select(*(dealt[c] for c in samples.columns), place.alias("place"), "remaining")


def label_progress(samples: DataFrame, enough: int = 80) -> DataFrame:
    """Labelled, unlabelled and all rows by key, and whether the key is ready to be fitted."""
    done = F.count_if(F.col("truth").isNotNull())
    rows = samples.groupBy("key").agg(done.alias("labelled"), (F.count("*") - done).alias("unlabelled"), F.count("*").alias("total"))
    return rows.withColumn("ready", F.col("labelled") >= enough)
