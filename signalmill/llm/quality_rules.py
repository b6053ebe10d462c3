"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

A text that compresses far better than prose of its length repeats itself, one that hardly compresses is noise. Both limits
depend on the length, since a short text has less context to compress against. The chunk rule finds
long texts of which a large part is out of band though the whole looks average.

Limits are fitted on all documents that are labelled good (``fit_bands``): their
ratios, and those of all their chunks, are counted to 1/8192 of an octave by half octaves of length, apart for texts of ASCII and others; in each the limits leave
``kept_share`` of them in the band, with a margin. Between the lengths so found limits are interpolated; below the shortest both stay as they are,
beyond the longest the upper one goes on rising as it did and the lower one stays. A kind of text without enough labels has no
limits, as those of another script would reject most of it, and is judged by the base rule alone; without any labels both kinds have the fixed ones below.

Cases: labels that are null, repeated or of no document don't count or count as often as they occur; a null text counts as empty; texts of no bytes have ratio 0.0 and no chunks and are judged by
the base rule alone (so rejected); repeated rows are judged one by one; an empty table gives an empty
result; other columns are ignored by ``quality_features`` and passed through by ``keep_good``. Texts of any length are
read whole, in chunks for the ratios.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import SPACE, buffers, row_chunks, shingle_hashes, word_hashes

# Fixed values where no labels are given: logarithms of bytes to base 2, least and greatest ratios for zstandard level 3.
DEFAULT = ((8.0, 9.0, 10.0, 11.0, 12.0, 13.0, 14.0), (1.0, 1.1, 1.15, 1.2, 1.25, 1.3, 1.3), (2.2, 2.4, 2.6, 2.8, 3.0, 3.2, 3.5))
#: No limits: for a kind of text of which no good ones are known.
OPEN = ((0.0,), (0.0,), (math.inf,))
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules. bands: of texts in ASCII and of others. bad_chunks: the greatest share of chunks that may be out of
    band. other_share: of a text's bytes that are not ASCII, from which it is no text in ASCII.
    kept_share, margin: what the limits leave in the band. least_good: ratios of a half octave from which its limits are drawn."""

    bands: tuple = (DEFAULT, DEFAULT)
    level: int = 3
    chunk_bytes: int = 4096
    bad_chunks: float = 0.5
    min_words: int = 50
    max_repeat_share: float = 0.5
    window: int = 3
    other_share: float = 0.01
    kept_share: float = 0.998
    margin: float = 0.015
    least_good: int = 30


FIELDS = [
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()),
    ("ratio", T.DoubleType()),
    ("n_chunks", T.LongType()),
    ("n_bad_chunks", T.LongType()),
]


def in_band(n_bytes: int, ratio: float, band: tuple) -> bool:
    """Whether a ratio is between the limits for that many bytes."""
    at, lows, highs = band
    x = math.log2(n_bytes)
    rise = max(0.0, highs[-1] - highs[-2]) / (at[-1] - at[-2]) if len(at) > 1 else 0.0
    high = highs[-1] + rise * (x - at[-1]) if x > at[-1] else float(np.interp(x, at, highs))
    return float(np.interp(x, at, lows)) <= ratio <= high


def band_of(steps: list) -> tuple | None:
    """The limits from rows (at, low, high), one for each half octave, in order of length; None of no rows."""
    # a longer text never has a lower upper limit
    return (tuple(r["at"] for r in steps), tuple(r["low"] for r in steps), tuple(np.maximum.accumulate([r["high"] for r in steps]).tolist())) if steps else None


def repeated_words(words: np.ndarray, window: int) -> int:
    """Words that stand in a window of so many words which occurs twice or more."""
    if len(words) <= window:
        return 0
    _, inverse, counts = np.unique(shingle_hashes(words, window), return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[i : len(words) - window + 1 + i] |= again
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def ratios_of(raw: bytes, pack, chunk_bytes: int) -> list[tuple[int, float]]:
    """(bytes, ratio) of a text and of each of its chunks."""
    parts = [raw, *(raw[c : c + chunk_bytes] for c in range(0, len(raw), chunk_bytes))]
    return [(len(p), len(p) / len(pack(p))) for p in parts] if raw else []


def is_other(raw: bytes, rules: QualityRules) -> bool:
    """Whether a text counts as one that is not in ASCII."""
    return int((np.frombuffer(raw, np.uint8) >= 0x80).sum()) > rules.other_share * len(raw)


def judge_column(column: pa.Array, rules: QualityRules) -> dict[str, list]:
    """The features and verdicts of a column of texts."""
    pack = zstandard.ZstdCompressor(level=rules.level).compress
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out: dict[str, list] = {name: [] for name, _ in FIELDS}
    data, offsets = buffers(column)
    for i, j in row_chunks(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        words, rows = word_hashes(part, at, lower=False)
        solid = np.concatenate(([0], np.cumsum((part & 0xC0 != 0x80) & ~SPACE[part])))
        signs = np.concatenate(([0], np.cumsum(symbol[part])))
        for k in range(j - i):
            raw = part[at[k] : at[k + 1]].tobytes()
            n = int(rows[k + 1] - rows[k])
            again = repeated_words(words[rows[k] : rows[k + 1]], rules.window)
            failed = n < rules.min_words or again > rules.max_repeat_share * n
            band = rules.bands[is_other(raw, rules)]
            whole, *chunks = ratios_of(raw, pack, rules.chunk_bytes) or [(0, 0.0)]
            bad = sum(not in_band(*c, band) for c in chunks)
            good = not failed and in_band(*whole, band) and bad <= rules.bad_chunks * len(chunks)
            out["n_words"].append(n)
            out["word_chars"].append(int(solid[at[k + 1]] - solid[at[k]]))
            out["n_symbols"].append(int(signs[at[k + 1]] - signs[at[k]]))
            out["n_dup_lines"].append(repeated_lines(raw))
            out["n_repeat_words"].append(again)
            out["base_failed"].append(failed)
            out["kept"].append(good)
            out["ratio"].append(whole[1])
            out["n_chunks"].append(len(chunks))
            out["n_bad_chunks"].append(bad)
    return out


def fit_bands(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", good: str = "quality = 1", rules: QualityRules | None = None) -> QualityRules:
    """The rules with limits fitted on the documents that the condition on their labels calls good."""
    rules = rules or QualityRules()
    chosen = labels.filter(good).select(F.col(id_column).alias("id")).filter("id IS NOT NULL").distinct()
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=rules.level).compress
        for batch in batches:
            points = []
            for i, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                if raw:
                    parts, other = ratios_of(raw, pack, rules.chunk_bytes), is_other(raw, rules)
                    # whole chunks only: what a text ends with is no text of its length
                    kept = Counter(p for k, p in enumerate(parts) if k == 0 or (p[0] == rules.chunk_bytes and len(parts) > 2))
                    points += [(i, other, size, ratio, n) for (size, ratio), n in kept.items()]
            at, other, sizes, ratios, n = zip(*points, strict=True) if points else ((),) * 5
            x = np.log2(np.array(sizes, float))
            near = np.exp2(np.rint(np.log2(np.array(ratios, float)) * 8192) / 8192)
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(other, pa.bool_()), pa.array(np.floor(2 * x).astype(np.int64)), pa.array(np.rint(x * 2**20).astype(np.int64)), pa.array(near), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "other", "step", "size", "ratio", "n"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, t()) for c, t in (("other", T.BooleanType), ("step", T.LongType), ("size", T.LongType), ("ratio", T.DoubleType), ("n", T.LongType)))])
    # measured before the join, so that no text is shuffled
    points = rows.mapInArrow(measure, schema).join(chosen, "id", "left_semi")
    counts = points.groupBy("other", "step", "ratio").agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("size"))
    ends = ", ".join(f"CAST({(1 + side * rules.kept_share) / 2!r} AS DOUBLE)" for side in (-1, 1))
    steps = counts.groupBy("other", "step").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.expr(f"percentile(ratio, array({ends}), n)").alias("p"))
    at = (F.col("size") / F.col("n") / 2.0**20).alias("at")
    found = steps.filter(F.col("n") >= rules.least_good).select("other", "step", at, (F.col("p")[0] * (1 - rules.margin)).alias("low"), (F.col("p")[1] * (1 + rules.margin)).alias("high")).orderBy("step").collect()
    fitted = [band_of([r for r in found if r["other"] == o]) for o in (False, True)]
    return replace(rules, bands=tuple(band or OPEN for band in fitted) if any(fitted) else rules.bands)


def quality_features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: QualityRules | None = None) -> DataFrame:
    """One row for each document: its id, the base counts, the compression figures and the verdict."""
    rules = rules or QualityRules()
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    schema = T.StructType([T.StructField(id_column, rows.schema["id"].dataType), *(T.StructField(n, t) for n, t in FIELDS)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge_column(batch.column(1), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[n], _arrow(t)) for n, t in FIELDS)], names=[id_column, *found])

    return rows.mapInArrow(judge, schema)


def keep_good(docs: DataFrame, text_column: str = "text", rules: QualityRules | None = None) -> DataFrame:
    """The rows of documents that pass, with all their columns."""
    rules = rules or QualityRules()
    place = docs.columns.index(text_column)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = judge_column(batch.column(place).cast(pa.string()), rules)["kept"]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[kind.simpleString()]
