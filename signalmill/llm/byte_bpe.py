"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the split pattern is encoded by itself: its bytes are symbols in a linked list, and the
adjacent pair of lowest rank is merged, leftmost first, until no pair has a rank. All new pre-tokens of a chunk share
one list (with borders between them) and one queue: a bucket for each rank holds list positions, a
tree of 64-bit words marks the buckets that hold any, and find-first-set leads to the next rank. A position whose pair
has changed meanwhile is stale and skipped. Merges of different pre-tokens don't touch, so the lowest rank of all is
the lowest of its own pre-token. The same queue serves pre-tokens of any length in time in
proportion to their bytes.

Pre-tokens met before are looked up in a table of bounded size, which each Python worker keeps.

Cases: a null text counts as empty and has no tokens; text that looks like a special token is plain text; repeated rows
are encoded one by one; texts of any length are read whole; an empty table gives an empty result; other columns
are ignored or, in ``with_tokens``, passed through.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._text import buffers, row_chunks

#: Bytes of text whose pre-tokens are merged at once; a longer text is taken alone.
CHUNK_BYTES = 4 << 20
#: Tokens that go out in one batch.
OUT_TOKENS = 1_000_000
#: Pre-tokens that a worker remembers; beyond, it starts afresh.
REMEMBERED = 250_000


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file (its size, a vocabulary, is bounded)."""
    local = Path(path)
    raw = local.read_bytes() if local.exists() else spark.read.format("binaryFile").load(path).first()["content"]
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Merges:
    """Tokens, and the rank of each pair of tokens whose joint bytes are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), (), ())))
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.values = keys[order], rank[order]
        # an open table: slot of a pair by its hash, next slots on collision
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.slot_keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.slot_values = np.full((1 << self.bits) + 64, -1, np.int32)
        rest, home, step = np.arange(len(keys)), self._slot(self.keys), 0
        while len(rest):
            at = home[rest] + step
            free = self.slot_keys[at] < 0
            self.slot_keys[at[free]] = self.keys[rest[free]]
            won = self.slot_keys[at] == self.keys[rest]
            self.slot_values[at[won]] = self.values[rest[won]]
            rest, step = rest[~won], step + 1
        self.steps = step
        # whether a merge into a token can bring forth a pair of lower rank
        lowest = np.full(self.size, self.size, np.int64)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        self.only_later = lowest > np.arange(self.size)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = left.astype(np.int64) * self.size + right
        at = self._slot(keys)
        found = self.slot_keys[at]
        out = np.where(found == keys, self.slot_values[at], -1)
        for step in range(1, self.steps):
            open_ = np.flatnonzero((found != keys) & (found >= 0))
            if not len(open_):
                break
            one = self.slot_keys[at[open_] + step]
            hit = one == keys[open_]
            out[open_[hit]] = self.slot_values[at[open_[hit]] + step]
            found[open_] = one
        return out


class RankQueue:
    """Buckets of positions by rank; three levels of 64-bit words (up to 262,144 ranks) mark those in use."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels = [[0] * (ranks // 64 + 1), [0] * (ranks // 4096 + 1), [0] * (ranks // 262_144 + 1)]

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        if len(ranks) == 1:
            self._put(int(ranks[0]), positions)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        firsts = ranks[edges[:-1]].tolist()
        for r, a, b in zip(firsts, edges[:-1], edges[1:], strict=True):
            self._put(r, positions[a:b])

    def _put(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [positions]
            for level in self.levels:
                level[rank >> 6] |= 1 << (rank & 63)
                rank >>= 6
        else:
            bucket.append(positions)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank in use and its positions, in order."""
        for top, word in enumerate(self.levels[2]):
            if word:
                break
        else:
            return None
        at = top
        for level in reversed(self.levels):
            word = level[at]
            at = at << 6 | ((word & -word).bit_length() - 1)
        rank, held = at, self.buckets.pop(at)
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        return rank, held[0] if len(held) == 1 else np.sort(np.concatenate(held), kind="stable")


def encode_words(words: list[bytes], merges: Merges) -> list[bytes]:
    """The token ids of each pre-token, as 32-bit integers in a row."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    total = int(lengths.sum())
    if not total:
        return [b"" for _ in words]
    symbol = merges.byte[np.frombuffer(b"".join(words), np.uint8)]
    ends = np.cumsum(lengths)
    after = np.arange(1, total + 1, dtype=np.int32)
    before = np.arange(-1, total - 1, dtype=np.int32)
    filled = lengths > 0
    after[ends[filled] - 1] = -1
    before[(ends - lengths)[filled]] = -1
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    rank = np.full(total, -1, np.int32)  # of the pair that begins at each place
    inner = np.flatnonzero(after >= 0)
    rank[inner] = merges.pair_ranks(symbol[inner], symbol[after[inner]])
    queue = RankQueue(merges.size)
    live = np.flatnonzero(rank >= 0)
    queue.push(rank[live], live)
    alive = np.ones(total, bool)
    while (next_ := queue.pop()) is not None:
        r, at = next_
        at = at[rank[at] == r]  # the others are stale
        if len(at) > 1:
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            if merges.only_later[r]:
                # of pairs that overlap (a a a), the first, third and so on
                linked = after[at[:-1]] == at[1:]
                if linked.any():
                    begins = np.concatenate(([True], ~linked))
                    run = np.flatnonzero(begins)
                    step = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                    at = at[step % 2 == 0]
            else:
                # a lower rank may come forth in the same pre-token: the leftmost only, the rest later
                first = np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))
                later = at[~first]
                at = at[first]
                queue.push(np.full(len(later), r), later)
        if not len(at):
            continue
        gone = after[at]
        nxt = after[gone]
        symbol[at] = r
        after[at] = nxt
        alive[gone] = False
        rank[gone] = -1
        has = nxt >= 0
        before[nxt[has]] = at[has]
        prev = before[at]
        starts = np.concatenate((prev[prev >= 0], at[has]))
        rank[at] = -1
        if len(starts):
            new = merges.pair_ranks(symbol[starts], symbol[after[starts]])
            rank[starts] = new
            good = new >= 0
            queue.push(new[good], starts[good])
    ids, counts = symbol[alive].tobytes(), np.bincount(owner[alive], minlength=len(words))
    edges = np.concatenate(([0], np.cumsum(counts) * 4)).tolist()
    return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Encoder:
    """Encodes texts; remembers the ids of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.merges = Merges(ranks)
        self.known: dict[str, bytes] = {}

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column."""
        for i, j in row_chunks(buffers(column)[1], CHUNK_BYTES):
            yield from self._chunk(column.slice(i, j - i).to_pylist())

    def _chunk(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, place, split = self.known, {}, self.split
        rows = []
        for text in texts:
            words = split(text or "")
            for w in words:
                if w not in place:
                    place[w] = len(place)
            rows.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
        new = [w for w in place if w not in known]
        for w, ids in zip(new, encode_words([w.encode("utf-8", "replace") for w in new], self.merges), strict=True):
            known[w] = ids
        found = [known[w] for w in place]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(found) else np.zeros(0, np.int64)
        for row in rows:
            n = lengths[row]
            entry = np.repeat(starts[row] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(row) else np.zeros(0, np.int64)
            yield flat[entry]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids."""
        return b"".join(map(self.merges.tokens.__getitem__, ids.tolist()))


def token_digests(docs: DataFrame, vocabulary_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: its id, the count of tokens, and digests of the ids and of their decoded bytes."""
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    schema = T.StructType([T.StructField(id_column, rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    vocabulary = _shared(docs.sparkSession, vocabulary_path, pattern)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(vocabulary)
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for ids in encoder.encode(batch.column(1)):
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=schema.names)

    return rows.mapInArrow(encode, schema)


def with_tokens(docs: DataFrame, vocabulary_path: str, pattern: str, text_column: str = "text", ids_column: str = "token_ids") -> DataFrame:
    """The documents with all columns and, last, the array of token ids (which takes the place of a column of its name)."""
    docs = docs.drop(ids_column)
    place = docs.columns.index(text_column)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_column, T.ArrayType(T.IntegerType(), False))])
    vocabulary = _shared(docs.sparkSession, vocabulary_path, pattern)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(vocabulary)
        for batch in batches:
            ids: list[np.ndarray] = []
            done = held = 0
            for k, one in enumerate(encoder.encode(batch.column(place).cast(pa.string())), 1):
                ids.append(one)
                held += len(one)
                if held > OUT_TOKENS or k == batch.num_rows:
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*batch.slice(done, len(ids)).columns, lists], names=schema.names)
                    ids, done, held = [], k, 0

    return docs.mapInArrow(encode, schema)


_WORKER: dict[str, Encoder] = {}


def _worker_encoder(vocabulary) -> Encoder:
    """The encoder of a Python worker, which may serve many tasks and so keeps what it remembers."""
    ranks, pattern, key = vocabulary.value
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(ranks, pattern)
    return _WORKER[key]


def _shared(spark: SparkSession, path: str, pattern: str):
    ranks = read_ranks(spark, path)
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    return spark.sparkContext.broadcast((ranks, pattern, key))
