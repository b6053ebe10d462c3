"""Helpers shared by the text operators: words and their 64-bit hashes, straight from Arrow buffers.

A word is a run of bytes other than space and tab to carriage return; only A-Z are lower-cased.
Hashes are 64 bits of a polynomial over random byte values, then mixed, so that two different words
of a table share one with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[SPACE] = 0
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SALTS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.full(64, _P, np.uint64))

#: Bytes of text that are hashed at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _P, np.uint64))
    return _POWERS


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows of about ``limit`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some rows, and where each row's words begin (with the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    start[heads] = solid[heads]
    starts = np.flatnonzero(start)
    rows = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), rows
    place = np.arange(n, dtype=np.int64)
    place -= np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [n]))))
    longest = int(np.max(place)) + 1
    sums = (_BYTE_LOWER if lower else _BYTE)[data]
    sums *= _powers(longest)[place]
    return mix(np.add.reduceat(sums, starts)), rows


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one text; of the whole sequence, if it has fewer than k words."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix(np.add.reduce(words * _SALTS[:n]) + np.uint64(n))[None]
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total += words[i : n - k + 1 + i] * _SALTS[i]
    return mix(total + np.uint64(k))


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared checkpoint folder that the cluster names."""
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    return frame.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; only where that is unset (tests), one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not where:
            import tempfile

            where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(where)
    return context._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Intermediate tables of one job in the shared checkpoint folder; ``drop`` removes them all."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, frame: DataFrame) -> DataFrame:
        """The frame, computed once and read from its table."""
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        with once(self.spark):
            frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self) -> None:
        remove_folder(self.spark, self.folder)


def unused(frame: DataFrame, name: str) -> str:
    """A column name like this one that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Limits Arrow batches to 8 MB for this session: texts are long, and a task holds a batch on both sides several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


@contextmanager
def once(spark: SparkSession):
    """Steps that write a table: their shuffle files go when each is written, not when the driver's garbage is collected. Settings come back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ours, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(frame: DataFrame) -> int:
    """How many partitions this session shuffles into."""
    return max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str):
    """The column as a string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
