"""Metering of model calls: tokens, cost, latency, and what two stages save.

Calls are rows (session_id, tick, t, stage, input_tokens, latency_ms, error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import unused
from .traces import micros

# Price of a million input tokens, limits of tokens a second and requests a minute.
PRICE = 0.042
TOKENS_PER_SECOND = 250_000
REQUESTS_PER_MINUTE = 1200


def totals(calls: DataFrame) -> DataFrame:
    """Calls, tokens, errors and cost of each session by stage, with the gate's open rate and what it saves."""
    gate, bank = F.col("stage") == "gate", F.col("stage") == "bank"
    tokens = F.col("input_tokens")
    rows = calls.groupBy("session_id").agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"),
        F.count_if(F.length("error") > 0).alias("errors"),
        F.count_if(gate).alias("gate_calls"),
        F.count_if(bank).alias("bank_calls"),
        F.coalesce(F.sum(F.when(gate, tokens)), F.lit(0)).alias("gate_tokens"),
        F.coalesce(F.sum(F.when(bank, tokens)), F.lit(0)).alias("bank_tokens"),
    )
    single = F.col("bank_tokens") / F.col("bank_calls") * F.col("gate_calls")
    both = (F.col("gate_calls") > 0) & (F.col("bank_calls") > 0)
    saving = (single - F.col("gate_tokens") - F.col("bank_tokens")) / single
    return rows.withColumns(
        {
            "spent": F.col("tokens") / 1e6 * PRICE,
            "gate_open_rate": F.when(F.col("gate_calls") > 0, F.col("bank_calls") / F.col("gate_calls")).otherwise(0.0),
            "gate_saving": F.when(both & (F.when(both, single) > 0), F.when(both & (F.when(both, single) > 0), saving)).otherwise(0.0),
        }
    )


def latency_percentiles(calls: DataFrame, percents=(50, 95), latest: int = 200) -> DataFrame:
    """Exact percentiles of the last ``latest`` latencies of each session: the sorted value at int(p / 100 n)."""
    order = Window.partitionBy("session_id").orderBy(F.desc("t"), F.desc("tick"))
    nth = unused(calls, "nth")
    rows = calls.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) <= latest)
    rows = rows.groupBy("session_id").agg(F.sort_array(F.collect_list("latency_ms")).alias("x"))
    at = lambda p: F.least((F.size("x") * (p / 100)).cast("int"), F.size("x") - 1)
    return rows.select("session_id", *(F.element_at("x", at(p) + 1).alias(f"p{p}_ms") for p in percents))


def rates(rows: DataFrame, tokens: Column, calls: Column, oldest: Column) -> DataFrame:
    """The rates of a window up to t with these tokens and calls, the oldest of which is that old: tokens a second, requests a minute, cost an hour,
    shares of the limits."""
    span = F.greatest(F.col("t") - oldest, F.lit(1e-3))
    rows = rows.withColumns({"tokens_per_sec": tokens / span, "requests_per_min": calls / span * 60})
    return rows.withColumns(
        {
            "dollars_per_hour": F.col("tokens_per_sec") * 3600 / 1e6 * PRICE,
            "tok_limit_pct": F.col("tokens_per_sec") / TOKENS_PER_SECOND * 100,
            "req_limit_pct": F.col("requests_per_min") / REQUESTS_PER_MINUTE * 100,
        }
    )


def rolling_rates(calls: DataFrame, window_s: float = 20.0) -> DataFrame:
    """For each call the rates over the trailing window, both ends included."""
    w = Window.partitionBy("session_id").orderBy(micros(F.col("t"))).rangeBetween(-round(window_s * 1_000_000), 0)
    return rates(calls, F.sum("input_tokens").over(w), F.count("*").over(w), F.min("t").over(w))


def budget_grid(calls: DataFrame, rates=(1.0, 2.0, 5.0, 10.0), open_rates=(0.2, 0.4, 0.8)) -> DataFrame:
    """What sessions would cost over a grid of tick rates and gate open rates, from their average tokens by stage.

    The grid is a short list and is exploded beside each session; ``break_even`` is the open rate at which two stages cost what one does.
    """
    per = calls.groupBy("session_id").agg(F.avg(F.when(F.col("stage") == "gate", F.col("input_tokens"))).alias("gate"), F.avg(F.when(F.col("stage") == "bank", F.col("input_tokens"))).alias("bank"))
    cells = F.explode(F.array(*(F.struct(F.lit(r).alias("rate_hz"), F.lit(o).alias("open_rate")) for r in rates for o in open_rates)))
    rows = per.filter("gate IS NOT NULL AND bank > 0").withColumn("c", cells).select("session_id", "gate", "bank", "c.*")
    tps = F.col("rate_hz") * (F.col("gate") + F.col("open_rate") * F.col("bank"))
    single = F.col("rate_hz") * F.col("bank")
    hour = tps * 3600 / 1e6 * PRICE
    return rows.select(
        "session_id",
        "rate_hz",
        "open_rate",
        tps.alias("tokens_per_sec"),
        hour.alias("dollars_per_hour"),
        (hour * 8).alias("dollars_per_day"),
        (F.col("rate_hz") * (1 + F.col("open_rate"))).alias("requests_per_sec"),
        ((single - tps) / single).alias("saving"),
        ((F.col("bank") - F.col("gate")) / F.col("bank")).alias("break_even"),
    )
