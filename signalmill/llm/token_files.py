"""Token ids of documents in Parquet files: a list column of ids in dictionary or delta encoding, small row groups and page indexes.

A folder of token files has one row for each document, in ascending order of doc_id over the files as they are numbered:

- doc_id, null first; rows that share an id stand together,
- file, the number of the file, and first, how many ids stand before the document in its file,
- n_tokens, and ids, the document's ids with the end id after them,
- meta, a struct of the columns that were to be kept beside (if any).

Readers ask for what they need: the counts without the ids (other columns aren't read), a range of doc_id (row groups and pages are left
out by their statistics), or a range of token positions over all files. Positions are sums over files, so no order is computed again.

Defined results: a null or empty text has the end id alone; repeated rows and ids stay, each a row; an empty table gives no file with rows and
reads as an empty frame; metadata may have any names. Long texts are encoded in pieces, whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._pieces import byte_level
from ._text import Scratch, buffers, checkpointed, partitions, row_chunks, text_or_empty, unused

#: Files whose totals are added up in one task.
FILES_A_BLOCK = 1024
#: Bytes of text that are encoded at once; a longer text is taken alone.
CHUNK_BYTES = 4 << 20


@dataclass(frozen=True)
class TokenFormat:
    """How ids lie in a file. encoding: "dictionary" (ids as bit-packed places in a dictionary; plain or delta once it outgrows its page) or
    "delta" (bit-packed differences). A page has its own statistics in the page index, so fewer rows a page let a reader skip more."""

    encoding: str = "dictionary"
    row_group_bytes: int = 32 << 20
    page_rows: int = 512
    page_bytes: int = 1 << 20
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        if self.encoding not in ("dictionary", "delta"):
            raise ValueError(f"encoding must be dictionary or delta, not {self.encoding}")
        return {
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "true",
            "parquet.enable.dictionary#ids.list.element": str(self.encoding == "dictionary").lower(),
            # positions and ids of documents rise, so their differences are small
            "parquet.enable.dictionary#doc_id": "false",
            "parquet.enable.dictionary#first": "false",
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "compression": self.compression,
        }


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, files: int | None = None, layout: TokenFormat | None = None, metadata: tuple[str, ...] = ()) -> None:
    """Encodes whole texts by a byte-level file of the tokenizers library, without special tokens around them, and writes them.

    One shuffle, by ranges of doc_id, moves the texts; each task encodes its rows in order as they stream and writes one file. Rows of one id
    are dealt over files too, by a hash of their place, so that an id with very many rows fills no file alone.
    """
    layout = layout or TokenFormat()
    kept = docs.select("doc_id", text_or_empty("text").alias("text"), *([F.struct(*metadata).alias("meta")] if metadata else []))
    deal = unused(kept, "deal")
    rows = kept.withColumn(deal, F.xxhash64(F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(files or partitions(docs), F.asc_nulls_first("doc_id"), deal).sortWithinPartitions(F.asc_nulls_first("doc_id"), deal).drop(deal)
    number = T.LongType()
    schema = T.StructType([kept.schema["doc_id"], T.StructField("file", number), T.StructField("first", number), T.StructField("n_tokens", number), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *kept.schema.fields[2:]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, first = byte_level(tokenizer, True), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in row_chunks(offsets, CHUNK_BYTES):
                ids, ends = encoder.rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, ends[1:], end_id).astype(np.int32)
                ends = ends + np.arange(len(ends))
                n = j - i
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                columns = [batch.column(0).slice(i, n), pa.array(np.full(n, file)), pa.array(first + ends[:-1]), pa.array(np.diff(ends)), lists, *(c.slice(i, n) for c in batch.columns[2:])]
                first += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows.mapInArrow(encode, schema).write.options(**layout.options()).parquet(folder)


def file_starts(files: DataFrame) -> DataFrame:
    """Rows (file, base): the ids in all files before. Reads counts only; totals of files are summed in blocks of files, then the blocks."""
    totals = files.groupBy("file").agg(F.max(F.col("first") + F.col("n_tokens")).alias("total")).withColumn("block", F.expr(f"file div {FILES_A_BLOCK}"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("total").alias("sum")).select("block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("blocks"))
    within = Window.partitionBy("block").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    own = totals.select("file", "block", F.coalesce(F.sum("total").over(within), F.lit(0)).alias("own"))
    return own.join(blocks, "block").select("file", (F.col("own") + F.col("blocks")).alias("base"))


def _at(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of token files with start, the ids of all documents before, in place of their file and place in it."""
    placed = rows.join(file_starts(files), "file").withColumn("start", F.col("base") + F.col("first"))
    return placed.select("doc_id", "start", *(c for c in rows.columns if c not in ("doc_id", "file", "first")))


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and any meta of all documents; ids aren't read."""
    files = spark.read.parquet(folder)
    return _at(files.drop("ids"), files)


def read_documents(spark: SparkSession, folder: str, low=None, high=None) -> DataFrame:
    """doc_id, start, n_tokens, ids and any meta of the documents with low <= doc_id <= high; other row groups and pages are left out."""
    files = spark.read.parquet(folder)
    rows = files
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    return _at(rows, files)


def read_positions(spark: SparkSession, folder: str, begin: int, end: int) -> DataFrame:
    """The ids at positions begin to end - 1 of all files, as rows doc_id, start (of the piece), ids. Only files that reach into the range are
    asked for ids: their numbers, known from the counts, go into the filter of the scan as a range of places of each file."""
    files = spark.read.parquet(folder)
    there = file_starts(files).join(files.groupBy("file").agg(F.max(F.col("first") + F.col("n_tokens")).alias("total")), "file").filter((F.col("base") < end) & (F.col("base") + F.col("total") > begin))
    edges = there.agg(F.min("file").alias("low"), F.max("file").alias("high")).first()
    rows = files.filter(F.lit(False)) if edges.low is None else files.filter(F.col("file").between(edges.low, edges.high))
    rows = _at(rows, files).filter((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > begin))
    skip = F.greatest(F.lit(begin) - F.col("start"), F.lit(0))
    most = F.least(F.lit(end) - F.col("start"), F.col("n_tokens")) - skip
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), most.cast("int")).alias("ids"))


def id_checksums(rows: DataFrame) -> DataFrame:
    """The rows with ids_crc32, the crc32 of the ids as little-endian unsigned 32-bit integers, in place of the ids."""
    others = [f for f in rows.schema.fields if f.name != "ids"]
    kept, schema = [f.name for f in others], T.StructType([*others, T.StructField("ids_crc32", T.LongType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            ids, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            found = pa.array([zlib.crc32(ids[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], names=schema.names)

    return rows.mapInArrow(sums, schema)


def token_digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the documents' token files, reads them back and returns doc_id, start, n_tokens and ids_crc32; the files go then."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    folder = f"{scratch.folder}/tokens"
    write_tokens(docs, folder, tokenizer, end_id)
    files = spark.read.parquet(folder)
    found = checkpointed(_at(id_checksums(files), files))
    scratch.drop()
    return found
