"""Readers of transcripts and logs, and writers of samples and calibrations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import swapped_in, unused

SPEAKERS = ("ME", "THEM", "SILENCE")
_SCRIPT = "t DOUBLE, speaker STRING, text STRING, truth STRING"
ANSWERS = "MAP<STRING, STRUCT<noul: DOUBLE, choice: STRING, probabilities: MAP<STRING, DOUBLE>, score: DOUBLE, confidence: DOUBLE>>"
CALLS = f"session_id STRING, tick LONG, t DOUBLE, stage STRING, answers {ANSWERS}, input_tokens LONG, output_tokens LONG, latency_ms DOUBLE, model STRING, error STRING"


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript JSON lines of many files, one session each; blank lines and those that begin with // are skipped."""
    return parse_scripts(spark.read.text(path).withColumn("session_id", F.input_file_name()))


def parse_scripts(lines: DataFrame) -> DataFrame:
    """Rows (session_id, value) to (session_id, t, speaker, text, truth): missing t is 0, speaker THEM, text empty;
    truth is a map of channels to values as text."""
    body = F.ltrim(F.col("value"))
    rows = lines.filter((F.length(F.trim("value")) > 0) & ~body.startswith("//"))
    parsed = F.from_json("value", _SCRIPT)
    rows = rows.select("session_id", parsed.alias("r"), F.from_json(F.get_json_object("value", "$.truth"), "MAP<STRING, STRING>").alias("truth"))
    return rows.select("session_id", F.coalesce("r.t", F.lit(0.0)).alias("t"), F.coalesce("r.speaker", F.lit("THEM")).alias("speaker"), F.coalesce("r.text", F.lit("")).alias("text"), "truth")


def truth_changes(script: DataFrame) -> DataFrame:
    """The truth maps as rows (session_id, t, channel, value)."""
    return script.select("session_id", "t", F.explode("truth").alias("channel", "value"))


def parse_speaker_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``SPEAKER: text`` lines to speaker and text; blank lines go, lines without a known speaker and a text are THEM's.

    Other columns stay.
    """
    line = F.trim(F.col(column))
    at = F.instr(line, ":")
    head, rest = F.upper(F.trim(F.substring_index(line, ":", 1))), F.expr(f"substring(trim({column}), instr(trim({column}), ':') + 1)")
    tagged = (at > 0) & (F.length(rest) > 0) & head.isin(*SPEAKERS)
    rows = lines.filter(F.length(line) > 0)
    return rows.withColumns({"speaker": F.when(tagged, head).otherwise("THEM"), "text": F.when(tagged, F.trim(rest)).otherwise(line)})


def parse_turn_events(lines: DataFrame, eager: bool = False, column: str = "value") -> DataFrame:
    """Turn events as JSON to utterances: finished turns with a text; eager ones too, if asked for. Malformed JSON goes."""
    r = F.from_json(column, "type STRING, event STRING, transcript STRING")
    ends = ["EndOfTurn", *(["EagerEndOfTurn"] if eager else [])]
    rows = lines.withColumn("_r", r).filter((F.col("_r.type") == "TurnInfo") & (F.length(F.trim("_r.transcript")) > 0))
    rows = rows.filter(F.col("_r.event").isNull() | F.col("_r.event").isin(ends))
    return rows.withColumn("text", F.trim("_r.transcript")).drop("_r", column)


def merged_streams(streams: dict[str, DataFrame]) -> DataFrame:
    """One utterance table of several speakers' tables. Streams that must fail apart are run as one query each into one table."""
    out = None
    for speaker, frame in streams.items():
        one = frame.withColumn("speaker", F.lit(speaker))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """A log of model calls as JSON lines; answers of failed calls are empty."""
    return _answered(spark.read.schema(CALLS).json(path))


def parse_calls(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same of lines that are at hand, from a stream for example; malformed JSON goes."""
    rows = lines.select(F.from_json(column, CALLS).alias("r")).filter("r.session_id IS NOT NULL")
    return _answered(rows.select("r.*"))


def _answered(calls: DataFrame) -> DataFrame:
    return calls.withColumn("answers", F.coalesce("answers", F.create_map().cast(ANSWERS)))


def labelled_rows(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The labelled rows (key, raw, truth), and the counts of rows and of unlabelled ones."""
    counts = samples.agg(F.count("*").alias("rows"), F.count_if(F.col("truth").isNull()).alias("unlabelled"))
    return samples.filter("truth IS NOT NULL").select("key", "raw", "truth"), counts


def write_samples(samples: DataFrame, path: str) -> None:
    """Appends sample rows as JSON lines."""
    samples.write.mode("append").json(path)


def merge_labels(samples: DataFrame, labels: DataFrame, keys=("session_id", "key", "tick")) -> DataFrame:
    """Samples with new labels set; other rows and columns are untouched. Of several labels of a row the one with the greatest ``at`` counts,
    or where there is no such column, true before false. Null labels set nothing."""
    last = F.max_by("truth", F.struct("at", "truth")) if "at" in labels.columns else F.max("truth")
    truth = unused(samples, "new_truth")
    new = labels.filter("truth IS NOT NULL").groupBy(*keys).agg(last.alias(truth))
    return samples.join(new, list(keys), "left").withColumn("truth", F.coalesce(truth, "truth")).select(samples.columns)


def save_samples(samples: DataFrame, path: str) -> None:
    """Writes rows to a new folder beside the path and swaps it in when it is whole, so that a failed job leaves the old rows."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    samples.write.json(fresh)
    swapped_in(samples.sparkSession, fresh, path)


def write_calibration(curves: DataFrame, path: str) -> None:
    """Curves (key, xs, ys, accuracy, ...) as JSON lines."""
    curves.write.mode("overwrite").json(path)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key STRING, xs ARRAY<DOUBLE>, ys ARRAY<DOUBLE>, accuracy DOUBLE, n LONG, ece_before DOUBLE, ece_after DOUBLE, verdict STRING").json(path)


def score_windows(payloads: DataFrame, scorer, schema) -> DataFrame:
    """The user's own model over payload rows, a batch of pandas rows at a time."""

    def run(batches):
        for batch in batches:
            yield scorer(batch)

    return payloads.mapInPandas(run, schema)

