"""URL filter by the ratio of two character language models.

One smoothed variable-order Markov model is fitted on accepted URLs, one on rejected URLs; a URL's value is the difference of
its log-likelihoods divided by its length, and a calibrated threshold decides. The models have every context of up to ``order``
symbols of all training URLs.

Training labels come from rules: URLs that an allow rule fits are accepted, those that a block rule fits rejected. A fifth of
them, by a hash of the URL, is held out to set the threshold: the one with the greatest balanced accuracy there.

Probabilities are Witten-Bell mixtures: P(c | h) = (n(h c) + t(h) P(c | shorter h)) / (n(h) + t(h)), t(h) being the number of
different symbols after h, down to 1 / 257 for each byte or the end; a context that was never seen leaves P as it is.

The models never come to one place. URLs are taken in blocks of bounded size; a block asks for the counts of its different pairs of
context and symbol, which Spark sums over all blocks, and gets them back. Contexts are known by 64-bit hashes. Only the counts of
values in 40,001 steps come to the driver, for the threshold.

Cases: null URLs and URLs without ``://`` have empty host and path, match no rule and are judged by the model as
they are (null: empty); where one side has no training URL, all URLs without a rule are allowed;
repeated rows count and are judged as often as they occur; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import Scratch, buffers, checkpointed, mix

# Fixed values: (verdict, host, path prefix) of the given rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
END = 256
#: Bytes of URLs in a block.
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class UrlModelOptions:
    order: int = 5
    held_out: int = 5


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash or the end; A-Z lower-cased."""
    raw = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The name and verdict of the longest rule that fits: by its host, then its path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """What the models see: the whole URL, with A-Z in lower case up to its path."""
    head = F.when(F.instr(url, "://") > 0, F.instr(url, "://") + 2 + F.length(host_of(url))).otherwise(0)
    lower = F.translate(F.substring(url, F.lit(1), head), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.concat(lower, F.substring(url, head + 1, F.length(url))), F.lit(""))


class Places:
    """Every place of the URLs of a block: a byte or the end. ``contexts[n]`` and ``keys[n]``: hashes of the n symbols before it and of these with its own."""

    def __init__(self, urls: pa.Array, order: int):
        data, offsets = buffers(urls)
        symbol = np.insert(data.astype(np.uint64), offsets[1:], END) + np.uint64(1)
        self.starts = offsets[:-1] + np.arange(len(offsets) - 1)
        self.lengths = np.diff(offsets) + 1
        self.place = np.arange(len(symbol)) - np.repeat(self.starts, self.lengths)
        self.contexts, self.keys = [np.zeros(len(symbol), np.uint64)], [mix(symbol)]
        for n in range(1, order + 1):
            before = np.concatenate((np.zeros(1, np.uint64), self.keys[-1][:-1]))[: len(symbol)]
            self.contexts.append(before)
            self.keys.append(mix(before * np.uint64(0xD6E8FEB86659FD93) + symbol * np.uint64(0xA0761D6478BD642F) + np.uint64(n)))

    def has(self, n: int) -> np.ndarray:
        """Places with so many symbols before them."""
        return np.flatnonzero(self.place >= n)


def _blocks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with the number of their block; the last column is what the models see."""
    schema, size = T.StructType([*rows.schema.fields, T.StructField("block", T.LongType())]), BLOCK_BYTES

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = held + np.cumsum(np.diff(buffers(batch.column(batch.num_columns - 1))[1]))
            held = int(ends[-1]) if len(ends) else held
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + ends // size, pa.int64())], names=schema.names)

    return scratch.keep(rows.mapInArrow(number, schema))


def context_counts(blocks: DataFrame, order: int) -> DataFrame:
    """(block, h, k, a, b): each block's contexts h with their next symbols, as k, and how often accepted and rejected URLs for training have them."""

    def count(table: pa.Table) -> pa.Table:
        places = Places(table["seen"], order)
        role = np.repeat(table["role"].to_numpy(), places.lengths)
        found = []
        for n in range(order + 1):
            at = places.has(n)
            k, one, of = np.unique(places.keys[n][at], return_index=True, return_inverse=True)
            sums = [np.bincount(of, role[at] == r, len(k)).astype(np.int64) for r in (1, 2)]
            found.append((places.contexts[n][at][one].astype(np.int64), k.astype(np.int64), *sums))
        h, k, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"block": np.full(len(k), table["block"][0].as_py()), "h": h, "k": k, "a": a, "b": b})

    return blocks.select("block", "seen", "role").groupBy("block").applyInArrow(count, "block long, h long, k long, a long, b long")


def log_ratios(blocks: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """The blocks' rows with ``log_ratio``: log P by the model of accepted URLs less that by the other one, for each symbol.

    Blocks ask for their different (context, symbol) pairs; counts are summed by pair and context and come back to the block."""
    asked = scratch.keep(context_counts(blocks, order))
    pairs = asked.groupBy("h", "k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = {f"{s}{c}": (F.sum(c) if s == "n" else F.count_if(F.col(c) > 0)) for c in "ab" for s in "nt"}
    known = pairs.join(pairs.groupBy("h").agg(*(v.alias(n) for n, v in sums.items())), "h")
    answers = asked.select("block", "h", "k").join(known, ["h", "k"]).select("block", "k", "a", "b", *sums)
    schema = T.StructType([*blocks.schema.fields, T.StructField("log_ratio", T.DoubleType())])
    counted = ["a", "b", *sums]

    def value(table: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("k")
        key, columns = known["k"].to_numpy(), {c: known[c].to_numpy() for c in counted}
        places = Places(table["seen"], order)
        p = {c: np.full(len(places.place), 1 / 257) for c in "ab"}
        for n in range(order + 1):
            at = places.has(n)
            row = np.searchsorted(key, places.keys[n][at].astype(np.int64))
            for c in "ab":
                seen, kinds = columns[f"n{c}"][row], columns[f"t{c}"][row]
                old = p[c][at]
                p[c][at] = np.where(seen > 0, (columns[c][row] + kinds * old) / np.maximum(seen + kinds, 1), old)
        ratio = np.add.reduceat(np.log(p["a"]) - np.log(p["b"]), places.starts) / places.lengths
        return table.append_column("log_ratio", pa.array(ratio, pa.float64()))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(value, schema)


def judge_urls(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES, options: UrlModelOptions | None = None) -> DataFrame:
    """One row for each page: id, host, path, the rule that fits, the verdict, and the model's value."""
    options, scratch = options or UrlModelOptions(), Scratch(pages.sparkSession)
    url = F.col(url_column).cast("string")
    rows = pages.select(F.col(id_column).alias("id"), url.alias("url"))
    rows = rows.withColumns({"host": F.coalesce(host_of(F.col("url")), F.lit("")), "path": F.coalesce(path_of(F.col("url")), F.lit(""))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    # 1 and 2: to learn from, accepted and rejected; 3: to set the threshold
    aside = F.pmod(F.xxhash64("url"), F.lit(options.held_out)) == 0
    role = F.when(F.col("said").isNull(), 0).when(aside, 3).when(F.col("said") == "allow", 1).otherwise(2)
    blocks = _blocks(rows.select("id", "host", "path", "rule", "said", role.alias("role"), symbols(F.col("url")).alias("seen")), scratch)
    valued = checkpointed(log_ratios(blocks, options.order, scratch).drop("block", "seen"))
    scratch.drop()
    roles = {r[0] for r in valued.select("role").distinct().collect()}
    if not {1, 2} <= roles:
        valued, cut = valued.withColumn("log_ratio", F.lit(0.0)), 0.0
    else:
        cut = _calibrated(valued.filter("role = 3"))
    own = F.when(F.col("log_ratio") >= cut, "allow").otherwise("block")
    return valued.select(F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "log_ratio")


def _calibrated(tried: DataFrame) -> float:
    """The threshold on held-out rows, from counts in a fixed number of steps of the value."""
    steps = F.round(F.col("log_ratio") * 1000).cast("int")
    rows = tried.select("said", F.least(F.greatest(steps, F.lit(-20_000)), F.lit(20_000)).alias("step")).groupBy("step", "said").count().collect()
    values = np.array([r[0] / 1000 for r in rows])
    return best_threshold(values, np.array([r[1] == "allow" for r in rows]), np.array([r[2] for r in rows], float))


def best_threshold(values: np.ndarray, accepted: np.ndarray, weights: np.ndarray) -> float:
    """The threshold with the greatest balanced accuracy; 0 without both labels. Each value stands for some rows."""
    if not len(values) or not accepted.any() or accepted.all():
        return 0.0
    order = np.argsort(values, kind="stable")
    v, a, w = values[order], accepted[order], weights[order]
    kept = 1 - np.concatenate(([0], np.cumsum(w * a))) / (w * a).sum()
    caught = np.concatenate(([0], np.cumsum(w * ~a))) / (w * ~a).sum()
    cuts = np.concatenate(([v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]))
    score = np.where(np.concatenate(([True], v[1:] > v[:-1], [True])), kept + caught, -1)
    best = np.flatnonzero(score == score.max())
    return float(cuts[best[np.argmin(np.abs(cuts[best]))]])
