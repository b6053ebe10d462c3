"""Operators on traces: the recurrence with its edges, and the window measures that need no recurrence.

Judgments are rows (session_id, key, t, tick, value, alt), t in seconds; rows of one trace are ordered by t, then tick.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import trace as core
from ..functions.scratch import unused

TRACE = ("session_id", "key")
_TYPES = {"warm": T.BooleanType(), "unreliable": T.BooleanType(), "fired": T.BooleanType(), "latched": T.BooleanType(), "fire_count": T.LongType()}


def with_specs(judgments: DataFrame, specs: DataFrame) -> DataFrame:
    """Judgments with the spec of their trace; keys without a spec are dropped. Spark broadcasts the specs if they are small."""
    return judgments.join(specs, "key")


def typed_rows(judgments: DataFrame) -> DataFrame:
    """The columns that the recurrence needs, with their types, of rows that have a time and a value."""
    numbers = [F.col(c).cast("double").alias(c) for c in ("value", "alt", *core.SPEC)]
    rows = judgments.select(*TRACE, F.col("t").cast("double").alias("t"), F.col("tick").cast("long").alias("tick"), *numbers)
    return rows.filter("t IS NOT NULL AND value IS NOT NULL")


def output_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields[:6], *(T.StructField(c, _TYPES.get(c, T.DoubleType())) for c in core.OUT)])


def runs_of(batch: pa.RecordBatch) -> tuple[list[tuple], list[int], list[np.ndarray]]:
    """The keys of typed rows, where each trace begins, and the numbers t, value, alt and the spec's."""
    keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
    return keys, starts, [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:3] + batch.columns[4:]]


def advance(batches: Iterator[pa.RecordBatch], names: list[str], state: core.TraceState | None = None) -> Iterator[pa.RecordBatch]:
    """The outputs of typed rows in order. The first trace goes on from a state, if one is given."""
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, starts, numbers = runs_of(batch)
        states = [core.TraceState() for _ in starts]
        if state is not None and now in (None, keys[0]):
            states[0] = state
        found = core.run(np.array([*starts, len(keys)]), *numbers[:3], np.stack([c[starts] for c in numbers[3:]], 1), states)
        now, state = keys[-1], states[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], *(pa.array(found[c], from_pandas=True) for c in core.OUT)], names=names)


def run_traces(judgments: DataFrame) -> DataFrame:
    """The recurrence over judgments that carry their spec columns: adds ema, disagreement, slope (only with a
    min_slope), in_band_for, warm, unreliable, fired, latched and fire_count.

    One shuffle, on the trace. Rows stream through each task in order and the state of a trace is carried from batch to batch, so a trace
    that never ends needs no more memory than a short one. Traces that are too long for one task: ``long_traces.run_long_traces``.
    """
    rows = typed_rows(judgments).repartition(*TRACE).sortWithinPartitions(*TRACE, "t", "tick")
    schema = output_schema(rows)
    names = schema.names
    return rows.mapInArrow(lambda batches: advance(batches, names), schema)


def default_specs(frame: DataFrame) -> DataFrame:
    """Fills warmup (2 tau), slope_window (2 s), dwell (0) and unreliable_at (0.3) where they are missing or null."""
    defaults = {"dwell": F.lit(0.0), "slope_window": F.lit(2.0), "warmup": 2 * F.col("tau"), "unreliable_at": F.lit(0.3), "min_slope": F.lit(None).cast("double")}
    return frame.withColumns({name: F.coalesce(F.col(name), value) if name in frame.columns else value for name, value in defaults.items()})


def micros(t: Column) -> Column:
    """Seconds as whole microseconds, for range frames with exact edges."""
    return F.round(t * 1_000_000).cast("long")


def trailing(seconds: float, keys=TRACE):
    """The rows of a trace from so many seconds before the current one, both ends included."""
    return Window.partitionBy(*keys).orderBy(micros(F.col("t"))).rangeBetween(-round(seconds * 1_000_000), 0)


def ema_slope(samples: DataFrame, seconds: float = 2.0, name: str = "slope") -> DataFrame:
    """Least-squares slope of ema over the trailing window; 0 for under three samples or no spread in time."""
    w = trailing(seconds)
    enough = (F.count("ema").over(w) >= 3) & (F.regr_sxx("ema", "t").over(w) > 1e-12)
    return samples.withColumn(name, F.when(enough, F.regr_slope("ema", "t").over(w)).otherwise(0.0))


def signed(slope: Column, polarity: Column) -> Column:
    """The slope in the direction that fires."""
    return slope * F.when(polarity < 0, -1).otherwise(1)


def ema_integral(samples: DataFrame, seconds: float = 30.0, name: str = "integral") -> DataFrame:
    """Time average of ema over the trailing window by trapezoids that lie in it whole; 0 for under two samples."""
    order = Window.partitionBy(*TRACE).orderBy(micros(F.col("t")), "tick")
    dt = F.greatest(F.col("t") - F.lag("t").over(order), F.lit(0.0))
    step, term = unused(samples, "dt"), unused(samples, "term")
    rows = samples.withColumns({step: F.coalesce(dt, F.lit(0.0)), term: F.coalesce(dt * (F.col("ema") + F.lag("ema").over(order)) / 2, F.lit(0.0))})
    w = trailing(seconds)
    area = F.sum(term).over(w) - F.first(term).over(w)
    span = F.sum(step).over(w) - F.first(step).over(w)
    return rows.withColumn(name, F.when(span > 1e-9, area / span).otherwise(0.0)).drop(step, term)


def in_band(ema: Column, fire: Column, polarity: Column) -> Column:
    return F.when(polarity < 0, ema <= fire).otherwise(ema >= fire)


def in_band_for(samples: DataFrame, inside: Column, name: str = "in_band_for") -> DataFrame:
    """Seconds since the trace came into its band; 0 outside."""
    order = Window.partitionBy(*TRACE).orderBy("t", "tick")
    within, run = unused(samples, "within"), unused(samples, "run")
    rows = samples.withColumn(within, F.coalesce(inside, F.lit(False)))
    rows = rows.withColumn(run, F.sum(F.when(F.col(within), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.min(F.when(F.col(within), F.col("t"))).over(Window.partitionBy(*TRACE, run))
    return rows.withColumn(name, F.when(F.col(within), F.col("t") - since).otherwise(0.0)).drop(within, run)


def warm(samples: DataFrame, warmup: Column, name: str = "warm") -> DataFrame:
    """Whether the trace is old enough to fire."""
    return samples.withColumn(name, F.col("t") - F.min("t").over(Window.partitionBy(*TRACE)) >= warmup)


def unreliable(disagreement: Column, at: Column) -> Column:
    return F.coalesce(disagreement > at, F.lit(False))


def latest_samples(samples: DataFrame, most: int = 900) -> DataFrame:
    """The last ``most`` samples of each trace."""
    order = Window.partitionBy(*TRACE).orderBy(F.desc("t"), F.desc("tick"))
    nth = unused(samples, "nth")
    return samples.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) <= most).drop(nth)


def fired_edges(outputs: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """The fired edges of channels that are not silent."""
    edges = outputs.filter("fired")
    if channels is None:
        return edges
    silent = channels.filter("silent").select(F.col("id").alias("_silent"))
    return edges.join(silent, F.substring_index("key", ":", 1) == F.col("_silent"), "left_anti")


def trace_status(unreliable: Column, warm: Column, latched: Column) -> Column:
    """The first of ill-posed, warming, latched and armed that holds."""
    return F.when(unreliable, "ill-posed").when(~warm, "warming").when(latched, "latched").otherwise("armed")


def session_export(outputs: DataFrame, specs: DataFrame, points: int = 600) -> DataFrame:
    """One row for each trace: its spec, the count of fires and its last points [t, value, ema]."""
    order = Window.partitionBy(*TRACE).orderBy(F.desc("t"), F.desc("tick"))
    rows = outputs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= points)
    point = F.struct("t", "tick", F.struct(F.round("t", 2).alias("t"), F.round("value", 4).alias("raw"), F.round("ema", 4).alias("ema")).alias("p"))
    series = rows.groupBy(*TRACE).agg(F.max("fire_count").alias("fire_count"), F.sort_array(F.collect_list(point)).alias("s"))
    return series.withColumn("series", F.col("s.p")).drop("s").join(specs, "key")
