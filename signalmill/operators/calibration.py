"""Calibration of probabilities: error, accuracy, isotonic curves with a holdout, and their application.

Pairs are rows (key, raw, truth).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import isotonic
from .sampling import bin_of


def calibration_error(pairs: DataFrame, bins: int = 10, value: str = "raw", keys=("key",)) -> DataFrame:
    """Expected calibration error by key: the bins' gaps between mean value and share of truth, weighted by rows."""
    y = F.col("truth").cast("double")
    by_bin = pairs.groupBy(*keys, bin_of(F.col(value), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("p"), F.avg(y).alias("y"))
    return by_bin.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def boundary_accuracy(pairs: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """The share of rows whose raw falls on the side of its truth, by key, to 4 places; bounds (key, bound), else 0.5."""
    rows = pairs.withColumn("bound", F.lit(0.5)) if bounds is None else pairs.join(bounds, "key", "left")
    hit = ((F.col("raw") >= F.coalesce("bound", F.lit(0.5))) == F.col("truth")).cast("double")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.round(F.avg(hit), 4).alias("accuracy"))


def decision_bounds(channels: DataFrame) -> DataFrame:
    """(key, bound): the middle between where right and wrong answers land."""
    from ..functions.channels import mass

    hit, miss = mass(F.col("kind"), F.size(F.coalesce("criteria", F.array())), F.col("p_hit"), F.col("p_miss"))
    option = F.explode_outer(F.when(F.col("kind") == "choice", F.col("watch")))
    return channels.select("id", ((hit + miss) / 2).alias("bound"), option.alias("option")).select(F.concat_ws(":", "id", "option").alias("key"), "bound")


def fit_curves(pairs: DataFrame, least: int | None = None, most_points: int = 24, digits: int = 4) -> DataFrame:
    """(key, n, xs, ys): an isotonic curve for each key.

    Rows are first added up by key and raw to ``digits`` places, so a key has at most 10^digits + 1 rows when it meets its fit.
    """
    points = pairs.groupBy("key", F.round("raw", digits).alias("raw")).agg(F.count("*").alias("n"), F.sum(F.col("truth").cast("long")).alias("yes"))

    def curve(table: pa.Table) -> pa.Table:
        table = table.sort_by("raw")
        raw, n, yes = (table[c].to_numpy() for c in ("raw", "n", "yes"))
        xs, ys = isotonic.fit(raw, n, yes, least, most_points)
        return pa.table({"key": table["key"][:1], "n": pa.array([int(n.sum())]), "xs": pa.array([xs]), "ys": pa.array([ys])})

    return points.groupBy("key").applyInArrow(curve, "key string, n long, xs array<double>, ys array<double>")


def calibrated(raw: Column, xs: Column, ys: Column) -> Column:
    """The curve at raw, straight between points and level beyond its ends; null is 0, without a curve raw stays."""
    below = F.size(F.filter(xs, lambda x: x < raw))
    x0, y0 = F.try_element_at(xs, below), F.try_element_at(ys, below)
    x1, y1 = F.try_element_at(xs, below + 1), F.try_element_at(ys, below + 1)
    between = F.when(x1 == x0, y1).otherwise(y0 + (y1 - y0) * (raw - x0) / (x1 - x0))
    inside = F.when(below >= F.size(xs), F.element_at(ys, -1)).otherwise(F.when(below > 0, between))
    inside = F.when(below == 0, F.element_at(ys, 1)).otherwise(inside)
    return F.when(raw.isNull(), 0.0).when(xs.isNull() | (F.size(xs) == 0), raw).otherwise(inside)


def apply_curves(judgments: DataFrame, curves: DataFrame) -> DataFrame:
    """Judgments with ``value`` and ``alt`` calibrated by their key's curve; a null alt stays null."""
    rows = judgments.join(curves.select("key", "xs", "ys"), "key", "left")
    rows = rows.withColumn("value", calibrated(F.col("raw"), F.col("xs"), F.col("ys")))
    if "alt" in judgments.columns:
        rows = rows.withColumn("alt", F.when(F.col("alt").isNotNull(), calibrated(F.col("alt"), F.col("xs"), F.col("ys"))))
    return rows.drop("xs", "ys")


def for_training(id_columns: list[str], seed: int = 0) -> Column:
    """A random half of the rows: those whose id, as text with the seed, has an md5 that begins with 0 to 7."""
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in id_columns), F.lit(str(seed)))) < "8"


def holdout_fit(pairs: DataFrame, id_columns: list[str], enough: int = 80, seed: int = 0, bounds: DataFrame | None = None, least: int | None = None, most_points: int = 24, digits: int = 4) -> DataFrame:
    """By key: a curve fitted on a random half and kept if it lowers the error on the other half.

    Columns: key, xs, ys (null unless kept), accuracy, n, ece_before, ece_after, verdict (keep, drop or too few). Raws count to ``digits`` places,
    as they are recorded: rows are added up by key and raw in one shuffle, so a key meets its fit as 10^digits + 1 rows at most.
    """
    train, yes = for_training(id_columns, seed), F.col("truth").cast("long")
    sums = {"n_train": F.count_if(train), "y_train": F.sum(F.when(train, yes).otherwise(0)), "n_test": F.count_if(~train), "y_test": F.sum(F.when(~train, yes).otherwise(0))}
    points = pairs.groupBy("key", F.round("raw", digits).alias("raw")).agg(*(c.alias(n) for n, c in sums.items()))
    points = points.withColumn("bound", F.lit(0.5)) if bounds is None else points.join(bounds, "key", "left").na.fill(0.5, ["bound"])

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by("raw")
        raw, n_train, y_train, n_test, y_test, bound = (table[c].to_numpy() for c in ("raw", "n_train", "y_train", "n_test", "y_test", "bound"))
        n, hits = n_train + n_test, np.where(raw >= bound, y_train + y_test, n_train + n_test - y_train - y_test)
        accuracy = xs = ys = before = after = None
        verdict, total = "too few", int(n.sum())
        if total >= enough:
            seen, tried = n_train > 0, n_test > 0
            xs, ys = isotonic.fit(raw[seen], n_train[seen], y_train[seen], least, most_points)
            before = binned_error(raw[tried], n_test[tried], y_test[tried])
            after = binned_error(np.interp(raw[tried], xs, ys), n_test[tried], y_test[tried])
            accuracy, verdict = round(float(hits.sum() / total), 4), "keep" if after < before else "drop"
            xs, ys = (xs, ys) if verdict == "keep" else (None, None)
        row = {"key": table["key"][:1], "xs": [xs], "ys": [ys], "accuracy": [accuracy], "n": [total], "ece_before": [before], "ece_after": [after], "verdict": [verdict]}
        kinds = {"xs": pa.list_(pa.float64()), "ys": pa.list_(pa.float64()), "accuracy": pa.float64(), "ece_before": pa.float64(), "ece_after": pa.float64()}
        return pa.table({c: pa.array(v, kinds[c]) if c in kinds else v for c, v in row.items()})

    return points.groupBy("key").applyInArrow(judge, "key string, xs array<double>, ys array<double>, accuracy double, n long, ece_before double, ece_after double, verdict string")


def binned_error(p: np.ndarray, n: np.ndarray, yes: np.ndarray, bins: int = 10) -> float:
    """The expected calibration error of points that stand for n rows each; 0 for none."""
    if not len(p):
        return 0.0
    of = np.minimum((p * bins).astype(int), bins - 1)
    rows, said, was = (np.bincount(of, x, bins) for x in (n, n * p, yes))
    return float(np.abs(said - was).sum() / rows.sum())


def with_accuracies(channels: DataFrame, fitted: DataFrame) -> DataFrame:
    """Channels with measured accuracies (the least of a choice's traces) in place of the assumed ones."""
    measured = fitted.filter("accuracy IS NOT NULL").groupBy(F.substring_index("key", ":", 1).alias("_id")).agg(F.min("accuracy").alias("_a"))
    rows = channels.join(measured, channels["id"] == F.col("_id"), "left")
    return rows.withColumn("accuracy", F.coalesce("_a", "accuracy")).drop("_id", "_a")


def accuracy_report(fitted: DataFrame) -> DataFrame:
    """Keys by rising accuracy."""
    return fitted.filter("accuracy IS NOT NULL").select("key", "n", "accuracy").orderBy("accuracy", "key")
