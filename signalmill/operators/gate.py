"""The gate: which ticks are worth the full set of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.folds import gate_reasons, over_keys, run_starts


def gate_decisions(ticks: DataFrame, start_s: float = 3.0, stale_s: float = 8.0, level: float = 0.62) -> DataFrame:
    """Rows (session_id, tick, t, eventful) with ``open`` and ``reason``. Rows stream in order; of a session one time is carried."""
    rows = ticks.select("session_id", "tick", "t", "eventful").repartition("session_id").sortWithinPartitions("session_id", "t", "tick")
    schema = T.StructType([*rows.schema.fields, T.StructField("open", T.BooleanType()), T.StructField("reason", T.StringType())])
    names = schema.names

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, np.nan
        for batch in batches:
            if not batch.num_rows:
                continue
            sessions = batch.column(0).to_pylist()
            starts = run_starts(sessions)
            t, eventful = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
            reasons = over_keys(starts, lambda rows, since, t=t, e=eventful: gate_reasons(t[rows], e[rows], since, start_s, stale_s, level), last if sessions[0] == now else np.nan)
            opened = np.flatnonzero(reasons[starts[-2] :] != None)  # noqa: E711
            if len(opened):
                last = t[starts[-2] + opened[-1]]
            elif sessions[-1] != now:
                last = np.nan
            now = sessions[-1]
            why = pa.array(reasons, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, why.is_valid(), why], names=names)

    return rows.mapInArrow(decide, schema)


def on_open_ticks(bank: DataFrame, decisions: DataFrame) -> DataFrame:
    """Bank rows of the ticks at which the gate is open."""
    return bank.join(decisions.filter("open").select("session_id", "tick"), ["session_id", "tick"], "left_semi")
