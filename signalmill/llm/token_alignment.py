"""Alignment of two tokenizers' ids over the same texts, and how often their ids meet over the whole corpus.

A text with a space before it is encoded by both (byte-level BPE as A, a piece model that adds the space itself as B). Tokens cover ranges of its bytes;
where tokens of both end, the text is cut into groups; a token of A and one of B whose ranges overlap make a link. Both tokenizers end
tokens where pieces end, so a piece is encoded, grouped and linked once, and a text's results are those of its pieces.

Counts of linked id pairs are dense matrices, striped by B's id:

1. blocks of documents add up their own pairs and send each stripe one record, with their pieces' links kept beside;
2. a stripe's task adds the records of all blocks into its matrix (``np.add.at``), takes row maxima, and sends each block the
   counts of its pairs, each with whether it is its B id's highest. A stripe's records pass twice, so none is held;
3. the answers meet their block, with which they are partitioned alike, and are summed over links, pieces and documents there.

A pair is in a block's record once, however frequent, so frequent ids make no task's work greater. A matrix takes
``stripe_ids`` x A's ids x 8 bytes, a block some ten times its text.

Defined results: texts that are null, empty, or other than their joined tokens' bytes in either (U+2581 in a text, for example) have no tokens;
rows that share a doc_id, or whole rows that repeat, are documents each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._pieces import PieceEncoder, byte_level, distinct_pieces, piece_model, piece_starts, ranges
from ._text import Scratch, buffers, checkpointed, partitions, row_chunks, text_or_empty
from .katz import distinct, packed, unpacked

#: B ids of a stripe, unless another number is asked for.
STRIPE_IDS = 64
#: Bytes of text of a block; a longer text is a block alone.
BLOCK_BYTES = 8 << 20
#: Pieces whose alignment a worker remembers: some 300 bytes each.
REMEMBERED = 250_000


class Aligner:
    """Alignments of distinct pieces. Piece n has ``a_ids[a_at[n] : a_at[n + 1]]``, likewise B's ids, the groups' counts of tokens (``sizes``: of A
    and B), the links (``link_a``, ``link_b``), and ``said[n]``, its groups in decimal. ``good[n]`` is whether its tokens give its bytes."""

    FLAT = ("a_ids", "b_ids", "sizes", "link_a", "link_b")

    def __init__(self, a: PieceEncoder, b: PieceEncoder, remembered: int = REMEMBERED):
        self.a, self.b, self.remembered = a, b, remembered
        self.known: dict[bytes, int] = {}
        self.said: list[bytes] = []
        self.good = np.zeros(0, bool)
        self.flat = {"a_ids": np.zeros(0, np.int32), "b_ids": np.zeros(0, np.int32), "sizes": np.zeros((0, 2), np.int32), "link_a": np.zeros(0, np.int32), "link_b": np.zeros(0, np.int32)}
        self.at = {name: np.zeros(1, np.int64) for name in self.FLAT}
        most = max(len(a.vocabulary.lengths), len(b.vocabulary.lengths))
        width = len(str(most))
        self.decimal = np.zeros((most, width + 1), np.uint8)
        for i in range(most):
            self.decimal[i, width - len(str(i)) : width] = np.frombuffer(str(i).encode(), np.uint8)

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each of some distinct pieces; good until the next call."""
        kept = len(self.known)
        del self.said[kept:]
        self.good = self.good[:kept]
        for name in self.FLAT:
            self.at[name] = self.at[name][: kept + 1]
            self.flat[name] = self.flat[name][: self.at[name][-1]]
        found = np.fromiter((self.known.get(p, -1) for p in pieces), np.int64, len(pieces))
        fresh = [pieces[i] for i in np.flatnonzero(found < 0)]
        if fresh:
            found[found < 0] = np.arange(kept, kept + len(fresh))
            self._add(fresh)
            more = min(len(fresh), max(0, self.remembered - kept))
            self.known.update(zip(fresh[:more], range(kept, kept + more), strict=True))
        return found

    def _add(self, pieces: list[bytes]) -> None:
        data, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
        ids, counts, good = [], [], np.ones(len(pieces), bool)
        for side in (self.a, self.b):
            own, n = side._encoded(pieces)
            ids.append(own)
            counts.append(n)
            good &= self._same_bytes(side, own, n, data, sizes)
        (a, b), (na, nb) = ([i[np.repeat(good, n)] for i, n in zip(ids, counts, strict=True)], [np.where(good, n, 0) for n in counts])
        size = np.where(good, sizes, 0)
        a_ends, b_ends, ends = np.cumsum(self.a.vocabulary.lengths[a]), np.cumsum(self.b.vocabulary.lengths[b]), np.cumsum(size)
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        edges = np.union1d(a_ends, b_ends)
        groups = np.stack([np.diff(np.searchsorted(x, cuts, "right"), prepend=0) for x in (a_ends, b_ends)], 1).astype(np.int32)
        # between two ends that follow each other lies the overlap of one token of each side
        link_a, link_b = a[np.searchsorted(a_ends, edges)], b[np.searchsorted(b_ends, edges)]
        n_groups, n_links = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (cuts, edges))
        self.said += self._decimals(a, b, groups, na + nb)
        self.good = np.concatenate((self.good, good))
        for name, flat, n in zip(self.FLAT, (a, b, groups, link_a, link_b), (na, nb, n_groups, n_links, n_links), strict=True):
            self.flat[name] = np.concatenate((self.flat[name], flat.astype(np.int32)))
            self.at[name] = np.concatenate((self.at[name], self.at[name][-1] + np.cumsum(n)))

    @staticmethod
    def _same_bytes(side: PieceEncoder, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which pieces' tokens give the piece's bytes."""
        upto = np.concatenate(([0], np.cumsum(side.vocabulary.lengths[ids])))
        ends = np.cumsum(counts)
        same = upto[ends] - upto[ends - counts] == sizes
        wrong = side.vocabulary.joined(ids[np.repeat(same, counts)]) != data[np.repeat(same, sizes)]
        of = np.repeat(np.flatnonzero(same), sizes[same])
        same[of[wrong]] = False
        return same

    def _decimals(self, a: np.ndarray, b: np.ndarray, groups: np.ndarray, tokens: np.ndarray) -> list[bytes]:
        """Each piece's groups as ``a1,a2|b1;`` one after the other."""
        part = np.concatenate((np.repeat(np.arange(len(groups)) * 2, groups[:, 0]), np.repeat(np.arange(len(groups)) * 2 + 1, groups[:, 1])))
        order = np.argsort(part, kind="stable")
        part = part[order]
        last = np.ones(len(part), bool)
        last[:-1] = part[1:] != part[:-1]
        written = self.decimal[np.concatenate((a, b))[order]]
        written[:, -1] = np.where(last, np.where(part % 2 == 0, ord("|"), ord(";")), ord(","))
        shown = written != 0
        flat = written[shown].tobytes()
        upto = np.concatenate(([0], np.cumsum(shown.sum(1))))
        bounds = upto[np.concatenate(([0], np.cumsum(tokens)))].tolist()
        return [flat[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def gathered(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """The values of some pieces, one piece after the other."""
        return self.flat[name][ranges(self.at[name][numbers], self.counts(name, numbers))]

    def counts(self, name: str, numbers: np.ndarray) -> np.ndarray:
        return self.at[name][numbers + 1] - self.at[name][numbers]


@functools.lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    a, b = byte_level(a_path, False), piece_model(b_path)
    a.remembered = b.remembered = 0
    return Aligner(a, b)


def with_space(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts with a space before each that isn't empty, and their offsets."""
    data, offsets = buffers(column)
    there = offsets[1:] > offsets[:-1]
    return np.insert(data, offsets[:-1][there], 0x20), offsets + np.concatenate(([0], np.cumsum(there)))


class Block:
    """Some rows' pieces: ``row`` and ``code`` of each occurrence, ``number`` of each distinct piece, and which rows are ``good``."""

    def __init__(self, aligned: Aligner, data: np.ndarray, offsets: np.ndarray):
        starts = piece_starts(data, offsets)
        self.code, pieces = distinct_pieces(data, starts)
        self.number = aligned.numbers(pieces)
        self.row = np.searchsorted(offsets, starts, "right") - 1
        self.good = np.ones(len(offsets) - 1, bool)
        self.good[self.row[~aligned.good[self.number][self.code]]] = False
        left = self.good[self.row]
        self.code, self.row = self.code[left], self.row[left]
        self.aligned = aligned

    def sums(self, name: str) -> np.ndarray:
        """How many of these values each row has."""
        return np.bincount(self.row, self.aligned.counts(name, self.number)[self.code], len(self.good)).astype(np.int64)

    def lines(self) -> Iterator[bytes]:
        """Each row's groups in decimal."""
        said, numbers = self.aligned.said, self.number[self.code].tolist()
        bounds = np.searchsorted(self.row, np.arange(len(self.good) + 1)).tolist()
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            yield b"".join(map(said.__getitem__, numbers[i:j]))[:-1]


def _blocks(batches: Iterable[pa.RecordBatch], aligned: Aligner, limit: int) -> Iterator[tuple[pa.Array, Block]]:
    """doc_id and pieces of blocks of rows, from (doc_id, text)."""
    rows, size = [], 0

    def cut():
        ids, texts = (pa.concat_arrays([b.column(k) for b in rows]) for k in (0, 1))
        data, offsets = with_space(texts)
        for i, j in row_chunks(offsets, limit):
            yield ids.slice(i, j - i), Block(aligned, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    for batch in batches:
        rows.append(batch)
        size += batch.column(1).nbytes
        if size >= limit:
            yield from cut()
            rows, size = [], 0
    if rows:
        yield from cut()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_or_empty("text").alias("text"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids and groups, an array of (n_a, n_b): how many of each side's ids, in order, the groups have. One pass, no shuffle."""
    rows = _texts(docs)
    ids, group = T.ArrayType(T.IntegerType(), False), T.StructType([T.StructField("n_a", T.IntegerType(), False), T.StructField("n_b", T.IntegerType(), False)])
    schema = T.StructType([rows.schema["doc_id"], T.StructField("a_ids", ids), T.StructField("b_ids", ids), T.StructField("groups", T.ArrayType(group, False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = aligner(a_path, b_path)
        for ids, block in _blocks(batches, aligned, BLOCK_BYTES // 4):
            columns = [ids]
            for name in ("a_ids", "b_ids", "sizes"):
                flat = aligned.gathered(name, block.number[block.code])
                ends = pa.array(np.concatenate(([0], np.cumsum(block.sums(name)))).astype(np.int32))
                values = pa.array(flat) if name != "sizes" else pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["n_a", "n_b"])
                columns.append(pa.ListArray.from_arrays(ends, values))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


class Stripes:
    """How pairs are numbered: by stripe (B's id modulo their number, which deals frequent ids over all), row of the stripe, and A's id."""

    def __init__(self, a_size: int, b_size: int, stripe_ids: int):
        self.a_size, self.count = a_size, -(-b_size // stripe_ids)
        self.rows = -(-b_size // self.count)
        self.cells = self.rows * a_size

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        b, a = b.astype(np.int64), a.astype(np.int64)
        return (b % self.count * self.rows + b // self.count) * self.a_size + a

    def matrix(self) -> np.ndarray:
        return np.zeros((self.rows, self.a_size), np.int64)

    def pairs(self, stripe: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B of cells of a stripe."""
        return cells % self.a_size, cells // self.a_size * self.count + stripe


_RECORD = "kind int, block long, stripe int, body binary, docs binary"


def _records(docs: DataFrame, a_path: str, b_path: str, stripes: Stripes) -> DataFrame:
    """Of each block a record of pairs and counts for each stripe (kind 0), and one with its documents and links (kind 1), which sorts behind the
    stripes' answers."""
    rows = _texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned, block_number = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for ids, block in _blocks(batches, aligned, BLOCK_BYTES):
            times = np.bincount(block.code, minlength=len(block.number))
            links = aligned.counts("link_a", block.number)
            keys, _, of = distinct(stripes.keys(aligned.gathered("link_a", block.number), aligned.gathered("link_b", block.number)))
            counts = np.bincount(of, np.repeat(times, links), len(keys)).astype(np.int64)
            out = []
            edges = np.searchsorted(keys, np.arange(stripes.count + 1) * stripes.cells)
            for stripe in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[stripe], edges[stripe + 1])
                out.append((0, block_number, stripe, packed(np.diff(keys[own] - stripe * stripes.cells, prepend=0), counts[own]), None))
            # of each piece its links' pairs and the rows it stands in; which comes first doesn't count
            body = packed(of, links, times, block.row[np.argsort(block.code, kind="stable")])
            sha = [hashlib.sha256(s).digest() if s else None for s in block.lines()]
            said = pa.RecordBatch.from_arrays([ids, *(pa.array(block.sums(n)) for n in ("a_ids", "b_ids", "sizes", "link_a")), pa.array(sha, pa.binary())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "sha"])
            out.append((1, block_number, stripes.count, body, _written(said)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "block", "stripe", "body", "docs"])
            block_number += 1

    return rows.mapInArrow(run, _RECORD)


def _written(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def _striped(records: DataFrame, phases: tuple[int, ...]) -> DataFrame:
    """Stripes' records, all of a stripe in one task, one phase after the other."""
    rows = records.filter("kind = 0").select("stripe", "block", "body", F.explode(F.array(*map(F.lit, phases))).alias("phase"))
    return rows.repartition(partitions(records), "stripe").sortWithinPartitions("stripe", "phase", "block").select("stripe", "phase", "block", "body")


def _matrices(batches: Iterable[pa.RecordBatch], stripes: Stripes) -> Iterator[tuple[int, int, int, np.ndarray | None, np.ndarray]]:
    """For each record its stripe, phase, block and cells, with the stripe's matrix as far as it is summed; at a stripe's end once more, without cells."""
    now, matrix = None, stripes.matrix()
    for batch in batches:
        for stripe, phase, block, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if stripe != now:
                if now is not None:
                    yield now, -1, -1, None, matrix
                    matrix.fill(0)
                now = stripe
            steps, counts = unpacked(body)
            cells = np.cumsum(steps)
            if phase == 0:
                np.add.at(matrix.reshape(-1), cells, counts)
            yield stripe, phase, block, cells, matrix
    if now is not None:
        yield now, -1, -1, None, matrix


def _answers(records: DataFrame, stripes: Stripes) -> DataFrame:
    """For each block and stripe the counts of the block's pairs over the whole corpus, and which are the highest of their B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, best_of = None, None
        for stripe, phase, block, cells, matrix in _matrices(batches, stripes):
            if phase != 1:
                continue
            if best_of != stripe:
                best, best_of = matrix.max(1), stripe
            counts = matrix.reshape(-1)[cells]
            body = packed(counts, np.packbits(counts == best[cells // stripes.a_size]))
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([block], pa.int64()), pa.array([stripe], pa.int32()), pa.array([body], pa.binary()), pa.array([None], pa.binary())], names=["kind", "block", "stripe", "body", "docs"])

    return _striped(records, (0, 1)).mapInArrow(run, _RECORD)


def _sizes(a_path: str, b_path: str) -> tuple[int, int]:
    return len(byte_level(a_path, False).vocabulary.lengths), len(piece_model(b_path).vocabulary.lengths)


def pair_counts(docs: DataFrame, a_path: str, b_path: str, stripe_ids: int = STRIPE_IDS) -> DataFrame:
    """All linked id pairs of the corpus: a_id, b_id, links, and best, whether no other A id has more links with this B id."""
    stripes = Stripes(*_sizes(a_path, b_path), stripe_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stripe, phase, _, _, matrix in _matrices(batches, stripes):
            if phase == -1:
                cells = np.flatnonzero(matrix)
                a, b = stripes.pairs(stripe, cells)
                counts = matrix.reshape(-1)[cells]
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts), pa.array(counts == matrix.max(1)[cells // stripes.a_size])], names=["a_id", "b_id", "links", "best"])

    return _striped(_records(docs, a_path, b_path, stripes), (0,)).mapInArrow(run, "a_id int, b_id int, links long, best boolean")


def alignment_scores(docs: DataFrame, a_path: str, b_path: str, stripe_ids: int = STRIPE_IDS) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the highest of its B id over the corpus), count_sum (over
    links, of their pair's count) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``; empty without tokens).

    Three shuffles: records to stripes, answers to blocks, blocks to their answers. Texts and tokens aren't shuffled.
    """
    spark = docs.sparkSession
    stripes, scratch = Stripes(*_sizes(a_path, b_path), stripe_ids), Scratch(spark)
    written = f"{scratch.folder}/records"
    _records(docs, a_path, b_path, stripes).write.partitionBy("kind").parquet(written)
    records = spark.read.schema(_RECORD).parquet(written)
    meet = _answers(records, stripes).unionByName(records.filter("kind = 1"))
    meet = meet.repartition(partitions(docs), "block").sortWithinPartitions("block", "stripe").select("body", "docs")
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in numbers), T.StructField("groups_sha256", T.StringType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = [], []
        for batch in batches:
            for body, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if said is None:
                    own, bits = unpacked(body)
                    counts.append(own)
                    best.append(np.unpackbits(bits.astype(np.uint8), count=len(own)))
                    continue
                of, links, times, rows = unpacked(body)
                found = _read(said)
                sums = []
                for values in (best, counts):
                    upto = np.concatenate(([0], np.cumsum(np.concatenate(values).astype(np.int64)[of] if values else of)))
                    ends = np.cumsum(links)
                    piece, row = upto[ends] - upto[ends - links], np.zeros(found.num_rows, np.int64)
                    np.add.at(row, rows, np.repeat(piece, times))
                    sums.append(pa.array(row))
                hexes = pa.array([s.hex() if s else "" for s in found.column(5).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*found.columns[:5], *sums, hexes], names=schema.names)
                counts, best = [], []

    scored = checkpointed(meet.mapInArrow(score, schema))
    scratch.drop()
    return scored
