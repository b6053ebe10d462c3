"""The trace recurrence for traces of any length over all tasks: a segmented scan over chunks.

All rows stand in one order (session, key, time), cut into as many ranges as there are tasks, so that the rows of one long trace fill many.
A range that lies within one trace passes a state on; it is summed up without knowing the state (``functions.segments``), the summaries
of a trace are folded in order, and the state that comes into each range goes out to it. That happens three times, as bands need smoothed values and
latches need bands; then one more pass gives the outputs. Where no range lies within one trace, the first fold has all that is needed.

What meets in a task: the summaries of a trace's ranges. What the driver holds: one state for each range (a few hundred bytes).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import segments
from ..functions import trace as core
from ..functions.scratch import checkpointed
from .traces import TRACE, advance, output_schema, runs_of, typed_rows

#: What each fold finds of the states that come in.
STAGES = {"smoothing": ("ema", "disagreement", "last_t", "first_t"), "band": ("band_since", "recent"), "latch": ("latched", "last_fire", "fire_count")}
_TAU, _REFRACTORY, _WINDOW = (core.SPEC.index(c) for c in ("tau", "refractory", "slope_window"))


class _Whole:
    """The summary of a range that lies within one trace, as its rows come."""

    def __init__(self, stage: str, entry: dict):
        self.stage, self.state, self.spec, self.rows = stage, segments.state_of(entry), None, []
        self.smooth, self.all = None, True

    def add(self, t, value, alt, spec) -> None:
        self.spec = spec
        if self.stage == "smoothing":
            piece = segments.smoothing(t, value, alt, spec[_TAU])
            self.smooth = piece if self.smooth is None else self.smooth.then(piece, spec[_TAU])
            return
        out, may_fire, released = core.measured(np.array([0, len(t)]), t, value, alt, spec[None], [self.state])
        if self.stage == "band":
            self.all &= bool(segments.inside_of(spec, out["ema"]).all())
        else:
            self.rows.append((t, may_fire, released, out["unreliable"]))

    def body(self) -> dict:
        if self.stage == "smoothing":
            found = asdict(self.smooth)
        elif self.stage == "band":
            found = {"since": self.state.band_since, "all": self.all, "recent": self.state.recent.tolist()}
        else:
            found = asdict(segments.latch(*(np.concatenate(c) for c in zip(*self.rows, strict=True)), self.spec[_REFRACTORY]))
        return {"spec": self.spec.tolist(), "found": found}


def _summaries(base: DataFrame, stage: str, entries: dict[int, dict]) -> DataFrame:
    """Of each range: that a trace ends in it (kind first), and of its last trace the state at its end if it began there (fresh), or else the
    range's summary (whole)."""
    schema = T.StructType([*base.schema.fields[:2], T.StructField("part", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("body", T.StringType())])
    kinds = base.limit(0).toArrow().schema
    types, names = [kinds.field(0).type, kinds.field(1).type, pa.int32(), pa.string(), pa.string()], schema.names

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = now = state = None
        whole = _Whole(stage, entries.get(part, {}))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, starts, numbers = runs_of(batch)
            first = keys[0] if first is None else first
            if keys[-1] != first:
                whole = None
            if now != keys[-1] or state is None:
                state = core.TraceState()
            now, at = keys[-1], starts[-1]
            t, value, alt = (c[at:] for c in numbers[:3])
            spec = np.array([c[at] for c in numbers[3:]])
            if whole is not None:
                whole.add(t, value, alt, spec)
            else:
                core.run(np.array([0, len(t)]), t, value, alt, spec[None], [state])
        out = []
        if now is not None and whole is None:
            out = [(*first, part, "first", ""), (*now, part, "fresh", json.dumps(segments.values_of(state)))]
        elif now is not None:
            out = [(*now, part, "whole", json.dumps(whole.body()))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return base.mapInArrow(sum_up, schema)


def _incoming(summaries: DataFrame, stage: str) -> dict[int, dict]:
    """The values of this stage that come into each range, by folding the summaries of each trace in order."""
    numbers = {"smoothing": _TAU, "band": _WINDOW, "latch": _REFRACTORY}[stage]
    kind = {"smoothing": segments.Smoothing, "band": segments.Band, "latch": segments.Latch}[stage]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values = None, None
        for batch in batches:
            out = []
            for session, key, part, what, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (session, key) != now:
                    now, values = (session, key), None
                if what != "fresh" and values is not None:
                    out.append((part, json.dumps({c: values[c] for c in STAGES[stage]})))
                if what == "fresh":
                    values = json.loads(body)
                elif what == "whole":
                    said = json.loads(body)
                    known = segments.state_of({c: values[c] for c in STAGES[stage]} if values else {})
                    values = kind(**said["found"]).after(known, said["spec"][numbers])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=pa.schema([("part", pa.int64()), ("entry", pa.string())]))

    rows = summaries.repartition(*TRACE).sortWithinPartitions(*TRACE, "part").mapInArrow(fold, "part long, entry string")
    return {r.part: json.loads(r.entry) for r in rows.collect()}


def run_long_traces(judgments: DataFrame, ranges: int | None = None) -> DataFrame:
    """What ``run_traces`` gives, by so many ranges of all rows (the session's shuffle partitions, if no number is given)."""
    rows = typed_rows(judgments)
    schema = output_schema(rows)
    count = ranges or int(judgments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # kept in this form, as each pass must meet the same ranges
    base = checkpointed(rows.repartitionByRange(count, *TRACE, "t", "tick").sortWithinPartitions(*TRACE, "t", "tick"))
    entries: dict[int, dict] = {}
    for stage in STAGES:
        for part, values in _incoming(_summaries(base, stage, entries), stage).items():
            entries.setdefault(part, {}).update(values)
        if stage == "smoothing" and not entries:
            break
    names = schema.names

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = entries.get(TaskContext.get().partitionId())
        yield from advance(batches, names, segments.state_of(entry) if entry else None)

    return base.mapInArrow(fill, schema)
