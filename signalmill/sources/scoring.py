"""A user's own model over payload rows, as a log of calls.

``score_calls`` gives the same rows that ``transcripts.read_calls`` reads from a log, so what follows (answers, traces, meter) doesn't know the
difference. A model is given as a function that loads it; each Python worker loads it once. It takes a list of payloads, as Python objects, and
returns or yields one verdict for each, a mapping:

- ``answers``: question to answer; an answer is a mapping of ``noul``, ``choice``, ``probabilities``, ``score``, ``confidence``, or a number, which is
  ``noul``; other fields are ignored, null answers left out;
- ``input_tokens``, ``output_tokens`` (0 where missing), ``model`` ("unknown"), ``error`` (none).

Where a model fails on a batch, the batch is asked again row by row, so that a failure is the row's that causes it: such rows have empty answers, no tokens
and the failure as their ``error``. A model that can't be loaded fails the job.

Cases: a null payload or one that is no JSON is a failed row, without a call; rows of any other column null are scored; verdicts that are too
few, too many or not of this form are failures; an empty table loads nothing; other columns are ignored. A lost executor's rows are asked again: write
the result to a table before it is used twice.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transcripts import CALLS

Scorer = Callable[[list[Any]], Iterable[Mapping]]

_ANSWER = pa.struct([("noul", pa.float64()), ("choice", pa.string()), ("probabilities", pa.map_(pa.string(), pa.float64())), ("score", pa.float64()), ("confidence", pa.float64())])
_VERDICT = [("answers", pa.map_(pa.string(), _ANSWER)), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("latency_ms", pa.float64()), ("model", pa.string()), ("error", pa.string())]
#: The model of this worker, by the job's mark.
_LOADED: dict[str, Scorer] = {}


def _number(x: Any) -> float | None:
    return None if x is None else float(x)


def _text(x: Any) -> str | None:
    return None if x is None else str(x)


def answer_row(answer: Any) -> dict:
    """An answer with all its fields."""
    if not isinstance(answer, Mapping):
        answer = {"noul": answer}
    shares = answer.get("probabilities")
    return {
        "noul": _number(answer.get("noul")),
        "choice": _text(answer.get("choice")),
        "probabilities": None if shares is None else [(str(k), _number(v)) for k, v in shares.items()],
        "score": _number(answer.get("score")),
        "confidence": _number(answer.get("confidence")),
    }


def verdict_row(verdict: Mapping, latency_ms: float) -> tuple:
    """A verdict as a row; one with an error has no answers."""
    error = verdict.get("error")
    said = {} if error else verdict.get("answers") or {}
    answers = [(str(k), answer_row(a)) for k, a in said.items() if a is not None]
    tokens = (int(verdict.get(k) or 0) for k in ("input_tokens", "output_tokens"))
    return answers, *tokens, latency_ms, str(verdict.get("model") or "unknown"), _text(error) or None


def failed_row(failure: Any, latency_ms: float) -> tuple:
    said = f"{type(failure).__name__}: {failure}" if isinstance(failure, Exception) else str(failure)
    return [], 0, 0, latency_ms, "unknown", said


def scored(scorer: Scorer, payloads: list[Any]) -> list[tuple]:
    """A row for each payload, with the time that its call took."""
    start = time.perf_counter()
    try:
        verdicts = list(scorer(payloads))
        if len(verdicts) != len(payloads):
            raise ValueError(f"{len(verdicts)} verdicts for {len(payloads)} payloads")
        passed = (time.perf_counter() - start) * 1000
        return [verdict_row(v, passed) for v in verdicts]
    except Exception as failure:  # a model's own failures are rows of the log
        if len(payloads) == 1:
            return [failed_row(failure, (time.perf_counter() - start) * 1000)]
    return [scored(scorer, [p])[0] for p in payloads]


def score_texts(scorer: Scorer, texts: list[str | None], batch_rows: int) -> list[tuple]:
    """Rows for payloads as JSON, asked so many at a time."""
    out: list = [None] * len(texts)
    asked: list[tuple[int, Any]] = []
    for i, text in enumerate(texts):
        try:
            asked.append((i, json.loads(text if text is not None else "")))
        except ValueError:
            out[i] = failed_row("no payload" if text is None else "the payload is no JSON", 0.0)
    for at in range(0, len(asked), batch_rows):
        places, payloads = zip(*asked[at : at + batch_rows], strict=True)
        for i, row in zip(places, scored(scorer, list(payloads)), strict=True):
            out[i] = row
    return out


def score_batch(scorer: Scorer, batch: pa.RecordBatch, batch_rows: int) -> Iterator[pa.RecordBatch]:
    """The calls of a batch, so many rows at a time: of the others no payload is in memory as Python objects."""
    for at in range(0, batch.num_rows, batch_rows):
        part = batch.slice(at, batch_rows)
        said = zip(*score_texts(scorer, part.column(4).to_pylist(), batch_rows), strict=True)
        arrays = [pa.array(list(column), kind) for column, (_, kind) in zip(said, _VERDICT, strict=True)]
        yield pa.RecordBatch.from_arrays([*part.columns[:4], *arrays], names=["session_id", "tick", "t", "stage", *(n for n, _ in _VERDICT)])


def score_calls(payloads: DataFrame, load: Callable[[], Scorer], stage: str = "bank", batch_rows: int = 64) -> DataFrame:
    """Rows (session_id, tick, t, payload) to a log of calls of this stage; session ids become text."""
    rows = payloads.select(F.col("session_id").cast("string"), F.col("tick").cast("long"), F.col("t").cast("double"), F.lit(stage).alias("stage"), F.col("payload").cast("string"))
    mark = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if mark not in _LOADED:
                _LOADED.clear()
                _LOADED[mark] = load()
            yield from score_batch(_LOADED[mark], batch, batch_rows)

    return rows.mapInArrow(run, CALLS)
