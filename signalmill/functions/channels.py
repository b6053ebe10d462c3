"""The default channels, and specifications derived from their accuracy.

A channel asks one question of each tick: yes or no (noul), one of several options (choice), or a place on a scale (score). Wordings are
short; users bring their own as rows of the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "id STRING, kind STRING, tier STRING, instructions STRING, alt STRING, criteria ARRAY<STRUCT<option: STRING, label: STRING>>, watch ARRAY<STRING>, "
    "accuracy DOUBLE, polarity STRING, dwell_s DOUBLE, refractory_s DOUBLE, min_slope DOUBLE, fire_at DOUBLE, p_hit DOUBLE, p_miss DOUBLE, silent BOOLEAN"
)
# Id, kind, tier, question, other wording, options, watched options, accuracy, polarity, dwell, refractory, least slope, silent.
_BANK = (
    ("eventful", "noul", "gate", "Did anything notable just happen?", "Is this moment worth a closer look?", (), (), 0.80, "high", 0.0, 25.0, None, True),
    ("floor", "choice", "gate", "Who holds the floor?", "Who is talking now?", ("me", "them", "silence", "overlap"), ("me", "silence", "overlap"), 0.86, "high", 0.0, 25.0, None, True),
    ("question_answered", "noul", "gate", "Has the latest question got its answer?", "Is nothing that was asked still open?", (), (), 0.80, "low", 6.0, 45.0, None, False),
    ("confusion", "score", "bank", "How lost are they?", "How hard is it for them to follow?", ("none", "some", "much"), (), 0.76, "high", 0.0, 30.0, 0.04, False),
    ("objection", "choice", "bank", "What do they resist?", "What holds them back?", ("price", "timing", "authority", "trust", "none"), ("price", "timing", "authority", "trust"), 0.78, "high", 1.5, 25.0, None, False),
    ("commitment", "noul", "bank", "Did someone promise to do something?", "Is there a new undertaking?", (), (), 0.80, "high", 0.5, 15.0, None, False),
    ("commitment_bound", "noul", "bank", "Does the promise name who and when?", "Are owner and date both clear?", (), (), 0.76, "low", 2.0, 25.0, None, False),
    ("claim_checkable", "noul", "bank", "Was a fact stated that could be looked up?", "Is there a figure to verify?", (), (), 0.78, "high", 1.0, 20.0, None, False),
    ("interest", "score", "bank", "How keen are they?", "How much do they want this?", ("low", "medium", "high"), (), 0.74, "high", 0.0, 25.0, None, True),
    ("repetition", "noul", "bank", "Was this point made before?", "Is this said again?", (), (), 0.74, "high", 2.0, 60.0, None, False),
    ("off_agenda", "noul", "bank", "Is the talk on its topic?", "Does this belong to the agenda?", (), (), 0.76, "low", 12.0, 90.0, None, False),
    ("decision_ready", "noul", "bank", "Could they decide now?", "Is all there that a decision needs?", (), (), 0.72, "high", 8.0, 120.0, None, False),
)


def default_channels(spark: SparkSession) -> DataFrame:
    """The default channels as a table."""
    rows = [(i, kind, tier, q, alt, [(o, o) for o in options], list(watch), acc, pol, dwell, refr, slope, 0.65, None, None, silent) for i, kind, tier, q, alt, options, watch, acc, pol, dwell, refr, slope, silent in _BANK]
    return spark.createDataFrame(rows, SCHEMA)


def mass(kind: Column, options: Column, p_hit: Column, p_miss: Column) -> tuple[Column, Column]:
    """Where a channel's probability lands when it is right and when it is wrong; given values go first."""
    n = F.greatest(options, F.lit(2))
    given = p_hit.isNotNull() & p_miss.isNotNull()
    hit = F.when(kind == "choice", 0.74).when(kind == "score", 0.82).otherwise(0.90)
    miss = F.when(kind == "choice", F.lit(0.26) / (n - 1)).when(kind == "score", 0.18).otherwise(0.10)
    return F.when(given, p_hit).otherwise(hit), F.when(given, p_miss).otherwise(miss)


def attractors(accuracy: Column, hit: Column, miss: Column) -> tuple[Column, Column]:
    """Where a smoothed trace settles while its condition is false, and while it is true."""
    return accuracy * miss + (1 - accuracy) * hit, accuracy * hit + (1 - accuracy) * miss


def sample_sigma(accuracy: Column, hit: Column, miss: Column) -> Column:
    return F.sqrt(accuracy * (1 - accuracy)) * (hit - miss)


def ema_sigma(alpha: Column, accuracy: Column, hit: Column, miss: Column) -> Column:
    """The noise that smoothing by alpha leaves."""
    return sample_sigma(accuracy, hit, miss) * F.sqrt(alpha / (2 - alpha))


def required_tau(accuracy: Column, rate: Column, hit: Column, miss: Column, fire_at: Column, sigmas: float = 3.0) -> Column:
    """The least time constant that keeps the fire line so many sigmas from the false attractor."""
    low, high = attractors(accuracy, hit, miss)
    sigma = sample_sigma(accuracy, hit, miss)
    k = F.pow(F.try_divide(fire_at * (high - low), sigmas * sigma), 2)
    alpha = 2 * k / (1 + k)
    return F.when(sigma <= 1e-9, 1e-3).when(alpha >= 1, 1e-3).otherwise(F.try_divide(F.lit(-1.0), rate * F.log(1 - alpha)))


def disagreement_bounds(accuracy: Column, hit: Column, miss: Column) -> tuple[Column, Column]:
    """Expected disagreement of two wordings from noise alone, and of two that mean different things."""
    return 2 * accuracy * (1 - accuracy) * (hit - miss), (accuracy * accuracy + (1 - accuracy) * (1 - accuracy)) * (hit - miss)


def disagreement_threshold(accuracy: Column, hit: Column, miss: Column, at: float = 0.75, least_power: float = 0.25) -> Column:
    """Where a trace counts as ill-posed; 1 (never) where the bounds are too close to tell."""
    low, high = disagreement_bounds(accuracy, hit, miss)
    return F.when(high - low < least_power, 1.0).otherwise(low + at * (high - low))


def derive_specs(channels: DataFrame, rate_hz: float = 5.0, gate_open: float = 0.40, strict: bool = False) -> DataFrame:
    """One row for each trace: its key and the columns of a spec, from the channel's accuracy.

    Channels outside what can be thresholded get a ``status`` other than ``ok`` (strict: raise an error instead).
    """
    hit, miss = mass(F.col("kind"), F.size(F.coalesce("criteria", F.array())), F.col("p_hit"), F.col("p_miss"))
    rows = channels.select("*", F.explode(F.array(F.struct(hit.alias("_hit"), miss.alias("_miss")))).alias("_mass")).select("*", "_mass.*").drop("_mass")
    a, hit, miss, fire_at = F.col("accuracy"), F.col("_hit"), F.col("_miss"), F.coalesce("fire_at", F.lit(0.65))
    low, high = attractors(a, hit, miss)
    rate = F.when(F.col("tier") == "gate", rate_hz).otherwise(max(rate_hz * gate_open, 0.5))
    high_side = F.col("polarity") != "low"
    line = lambda share: F.round(F.when(high_side, low + share * (high - low)).otherwise(1 - (low + share * (high - low))), 4)
    found = {
        "fire": line(fire_at),
        "release": line(F.lit(0.35)),
        "tau": F.round(required_tau(a, rate, hit, miss, fire_at), 3),
        "unreliable_at": F.round(disagreement_threshold(a, hit, miss), 4),
        "gap": high - low,
    }
    # each is computed once: the optimizer would otherwise write these long expressions out wherever they are named below
    rows = rows.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in found.items())))).alias("found")).select("*", "found.*").drop("found")
    ordered = F.when(high_side, F.col("release") < F.col("fire")).otherwise(F.col("release") > F.col("fire"))
    status = (
        F.when(~a.between(0, 1) | a.isNull(), "accuracy out of range")
        .when(F.col("gap") < 0.08, "gap too small")
        .when(~F.col("fire").between(0, 1) | ~F.col("release").between(0, 1), "not a probability")
        .when(~ordered, "no hysteresis")
        .when(F.col("tau") <= 0, "no smoothing")
        .otherwise("ok")
    )
    if strict:
        status = F.when(status == "ok", status).otherwise(F.raise_error(F.concat(F.lit("channel "), F.col("id"), F.lit(": "), status)))
    option = F.explode_outer(F.when(F.col("kind") == "choice", F.col("watch")))
    rows = rows.withColumn("status", status).withColumn("option", option)
    rows = rows.filter((F.col("kind") != "choice") | F.col("option").isNotNull())
    return rows.select(
        F.concat_ws(":", "id", "option").alias("key"),
        F.col("id").alias("channel"),
        "option",
        "kind",
        "silent",
        "fire",
        "release",
        F.when(high_side, 1.0).otherwise(-1.0).alias("polarity"),
        "tau",
        F.col("dwell_s").alias("dwell"),
        F.col("refractory_s").alias("refractory"),
        "min_slope",
        F.lit(2.0).alias("slope_window"),
        (2 * F.col("tau")).alias("warmup"),
        "unreliable_at",
        "status",
    )
