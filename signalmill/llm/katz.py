"""Scoring by a Katz backoff model of words.

Counts of n-grams over the training documents are discounted by Good-Turing estimates; what the discounts free goes to
the next shorter history, with a weight for each history that makes its probabilities sum to one exactly. Tokens are
words (A-Z lower-cased) and one end for each text; unknown tokens share one class. Every n-gram of the training documents is in the model.

- P(w) = D(c) / N with D(c) = d(c) c; the class of unknown tokens has what is left.
- P(w | h) = s(h) D(c(hw)) / c(h) where hw was seen, else b(h) P(w | h without its first token).
- b(h) = (1 - sum of P(w | h) over the w seen after h) / (1 - sum of their P(w | shorter h)).
- s(h) is 1, or c(h) / (c(h) + 1) where all w were seen more than MOST_DISCOUNTED times, so that the first sum would leave nothing for the others.
- d(r), r <= 5: (r* / r - a) / (1 - a), with r* = (r + 1) n(r+1) / n(r) and a = 6 n(6) / n(1). Where that is not
  between 0 and 1 (few data, many copies) it is (r - 0.5) / r.

How it runs: documents are written once, in blocks of bounded size, to a table bucketed by block, so later steps don't
shuffle texts. For each order, each block adds up its own n-grams and asks, by ranges of the history's key, for their counts over all
blocks and for what b(h) is made of: how many followers of the history were seen once to five times, and the sum of D over the counts of
the followers after the shorter history (a seen n-gram's shorter one was seen too, so it never backs off). So one exchange an order gives
all; the answers come in the order asked for, which the block can compute again, and are kept in a table partitioned by order.
Only where a block has an unseen n-gram after a history, in a held-out document, does b(h) count there; elsewhere the answer is one bit, which tells s(h).
The last step walks up the orders for each token.

What occurs once needs no exchange: an n-gram with a part that only this place of the corpus has (count 1, in no held-out document) was
itself seen once, here; histories of that kind are complete in their block, and other histories get such followers as a number.
A history of more than ``HISTORY_ROWS`` occurrences is split into salts, each with a part of the followers; who asks adds them up.
A block asks for no more keys than it has places, however many ranges there are; ranges grow with the corpus, so that what one task holds
stays the same. Nothing but the counts of counts comes to the driver. n-grams are known by 64-bit hashes, on the way by 48 bits of their history's,
within its range, and 40 of their own.

Cases: null or empty texts have one token, their end; a null id counts as the empty string for the split; repeated rows
count and are scored as often as they occur; texts of any length are read whole (one is never cut by blocks); without
training documents all probability is that of the unknown class; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import Scratch, buffers, ensure_checkpoint_dir, mix, once, partitions, remove_folder, row_chunks, word_hashes

END = np.uint64(0xE2D0E2D0E2D0E2D1)
#: Bytes of text in a block.
BLOCK_BYTES = 6 << 20
#: Blocks for each range of keys.
RANGE_BLOCKS = 2
#: Bits of a follower's hash beside its history, and of a history's beside its range.
FOLLOWER_BITS, HISTORY_BITS = 40, 48
#: Occurrences of a history that one task holds the followers of; beyond, it is salted.
HISTORY_ROWS = 4_000_000
#: Counts up to this are discounted.
MOST_DISCOUNTED = 5
_K = MOST_DISCOUNTED
_ASK = "block long, bucket int, body binary"
_ANSWER = "block long, bucket int, counts binary, sums binary"


@dataclass
class Level:
    """Counts of counts of the n-grams of one order; total and distinct of words only."""

    total: int = 0
    distinct: int = 0
    of_count: list[int] = field(default_factory=lambda: [0] * (_K + 2))

    def discounts(self) -> np.ndarray:
        """d(0) to d(MOST_DISCOUNTED)."""
        n = self.of_count
        a = (_K + 1) * n[_K + 1] / n[1] if n[1] else 1.0
        out = np.zeros(_K + 1)
        for r in range(1, _K + 1):
            d = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if n[r] and a < 1 else 2.0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        """D(c) = d(c) c."""
        return np.where(counts <= _K, self.discounts()[np.minimum(counts, _K)], 1.0) * counts

    def unigrams(self) -> tuple[float, float]:
        """What D(c) is divided by, and the probability of the unknown class."""
        if not self.total:
            return 1.0, 1.0
        d = self.discounts()
        freed = sum((1 - d[r]) * r * self.of_count[r] for r in range(1, _K + 1))
        return (float(self.total), freed / self.total) if freed > 0 else (self.total + 1.0, 1 / (self.total + 1))


class Block:
    """The documents of a block as keys of n-grams, one for each token's place."""

    def __init__(self, table: pa.Table, order: int):
        data, offsets = buffers(table["text"])
        tokens, starts, at = [], [0], 0
        for i, j in row_chunks(offsets):
            words, rows = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            # an end after each text
            tokens.append(np.insert(words, rows[1:], END))
            starts += (at + rows[1:] + np.arange(1, j - i + 1)).tolist()
            at += len(tokens[-1])
        self.starts = np.array(starts, np.int64)
        lengths = np.diff(self.starts)
        self.place = np.arange(at) - np.repeat(self.starts[:-1], lengths)
        self.train = np.repeat(table["train"].to_numpy(zero_copy_only=False), lengths)
        self.keys = [np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)]
        for n in range(2, order + 1):
            longer = self.keys[0] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)
            longer[1:] += self.keys[-1][:-1] * np.uint64(0xA0761D6478BD642F)
            self.keys.append(mix(longer))


def _before(x: np.ndarray) -> np.ndarray:
    """What stands one place before, 0 for the first."""
    out = np.zeros_like(x)
    out[1:] = x[:-1]
    return out


def _sums(index: np.ndarray, values: np.ndarray | None, size: int) -> np.ndarray:
    return np.bincount(index, values, size).astype(np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, rising; for each a place where it stands; for each place its key."""
    order = np.argsort(keys)
    rising = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = rising[1:] != rising[:-1]
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return rising[new], order[new], of


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, whole numbers that are not negative in as few bytes each as the greatest needs."""
    head, bodies = [len(arrays)], []
    for a in arrays:
        kind = a.dtype.kind
        if kind == "i":
            a = a.astype(next(k for k in ("u1", "u2", "u4", "u8") if not len(a) or int(a.max()) < 1 << 8 * int(k[1])))
        head += [ord(kind), a.dtype.itemsize, len(a)]
        # all lowest bytes first, which packs well
        bodies.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    return zstandard.compress(b"".join([np.array(head, "<i8").tobytes(), *bodies]), 1)


def unpacked(body: bytes) -> list[np.ndarray]:
    """The arrays; whole numbers as 64 bits."""
    raw = zstandard.decompress(body)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(n, 3).tolist(), 8 + 24 * n, []
    for kind, size, length in head:
        whole = kind == ord("i")
        planes = np.frombuffer(raw, np.uint8, length * size, at).reshape(size, length)
        a = np.ascontiguousarray(planes.T).view(f"<{'u' if whole else chr(kind)}{size}").ravel()
        at += size * length
        out.append(a.astype(np.int64) if whole else a)
    return out


def _steps(rising: np.ndarray) -> np.ndarray:
    """Rising numbers as differences."""
    return np.diff(rising.astype(np.int64), prepend=np.zeros(1, np.int64))


def _within(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Keys that rise within each slot as differences in it."""
    out = keys.copy()
    out[1:] -= keys[:-1]
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[starts] = keys[starts]
    return out


def _of_within(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(steps)))
    return upto[1:] - np.repeat(upto[np.cumsum(sizes) - sizes], sizes)


class Asked:
    """What a block asks for one order: different n-grams, for order 2 and more by histories (``slots``: salted).

    ``at``: places whose n-grams are asked for, ``of`` their places among what is asked; ``valid``: places with a history that has followers elsewhere,
    ``history`` theirs; ``hidden``: places of n-grams that occur only there; ``lone``: places whose history does; ``wanted``: slots whose sums
    the block needs in any case."""

    def __init__(self, view: View, n: int, history_rows: int):
        block, self.n = view.block, n
        train, keys = block.train, block.keys[n - 1]
        if n == 1:
            self.at = np.arange(len(block.place))
            self.lone = self.hidden = self.valid = np.zeros(0, np.int64)
            self.names, _, self.of = distinct(keys)
            self.keys = self.route = self.names
        else:
            count, lone = view.count[-1], view.lone[-1]
            inside = block.place >= n - 1
            history_count, history_lone = _before(count), _before(lone)
            self.lone = np.flatnonzero(inside & history_lone)
            self.valid = np.flatnonzero(inside & (history_count > 0) & ~history_lone)
            # histories were asked for as n-grams of the order below
            known = view.index[self.valid - 1]
            used = np.zeros(len(view.names), bool)
            used[known] = True
            self.history = (np.cumsum(used) - 1)[known]
            histories = view.names[used]
            counts = np.zeros(len(histories), np.int64)
            counts[self.history] = history_count[self.valid]
            self.salts = 1 + counts // history_rows
            begin, rank = self._salted(histories)
            followers = count[self.valid] > 0
            # n-grams with an unseen part are not asked for, and back off; a salt doesn't know the others' n-grams
            wanted = np.zeros(len(histories), bool)
            wanted[self.history[~followers]] = True
            wanted[self.history[~train[self.valid]]] |= self.salts[self.history[~train[self.valid]]] > 1
            self.wanted = wanted[self.owner]
            hidden = lone[self.valid]
            self.at, self.hidden = self.valid[followers & ~hidden], self.valid[hidden]
            mine = self.history[followers & ~hidden]
            turn = (keys[self.at] % self.salts[mine].astype(np.uint64)).astype(np.int64)
            slot = rank[begin[mine] + turn].astype(np.uint64)
            # by slot, then by the first bits of the n-gram
            both, first, self.of = distinct(slot << np.uint64(FOLLOWER_BITS) | keys[self.at] >> np.uint64(64 - FOLLOWER_BITS))
            self.names, self.keys = keys[self.at[first]], (both & np.uint64((1 << FOLLOWER_BITS) - 1)).astype(np.int64)
            lower = count[self.at[first]]
            self.followers = np.bincount((both >> np.uint64(FOLLOWER_BITS)).astype(np.int64), minlength=len(self.slots))
            self.singles = np.bincount(rank[begin[self.history[hidden]]], minlength=len(self.slots))
            self.route = self.slots
        mine = _sums(self.of, train[self.at], len(self.names))
        # the count, and whether a held-out place has it
        self.counts = 2 * mine + (np.bincount(self.of, minlength=len(self.names)) > mine)
        if n > 1:
            # who has it in training tells
            self.lower = np.where(mine > 0, lower, 0)

    def _salted(self, histories: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets the slots, rising, and the history of each. Returns where each history's salts begin, and the slot of each salt."""
        begin = np.cumsum(self.salts) - self.salts
        self.owner = np.repeat(np.arange(len(histories)), self.salts)
        slots = histories[self.owner]
        if len(self.owner) > len(histories):
            salt = np.arange(len(self.owner)) - begin[self.owner]
            slots = np.where(salt == 0, slots, mix(slots + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(slots)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.slots, self.owner = slots[order], self.owner[order]
        return begin, rank

    def rows(self, block: int, ranges: int) -> list[tuple]:
        if self.n == 1:
            return [(block, b, packed(self.keys[i:j], self.counts[i:j])) for b, i, j in _ranges(self.route, ranges)]
        edge = np.concatenate(([0], np.cumsum(self.followers)))
        out = []
        for b, i, j in _ranges(self.route, ranges):
            mine = slice(edge[i], edge[j])
            heads = _steps(self.slots[i:j] >> np.uint64(64 - HISTORY_BITS))
            body = packed(heads, self.followers[i:j], 2 * self.singles[i:j] + self.wanted[i:j], _within(self.keys[mine], self.followers[i:j]), self.counts[mine], self.lower[mine])
            out.append((block, b, body))
        return out


def _ranges(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to): sorted keys cut into ranges of equal width."""
    if not len(keys):
        return
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(edges, np.append(edges[1:], len(keys)), strict=True):
        yield int(bucket[a]), int(a), int(b)


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def answer(table: pa.Table, n: int, keep: bool) -> pa.Table:
    """The answers to all blocks' asks for one range of keys, and its counts of counts (block -1: n(1) to n(6), distinct, total)."""
    bucket, blocks = table["bucket"][0].as_py(), table["block"].to_pylist()
    bodies = [unpacked(b.as_py()) for b in table["body"]]
    if n > 1:
        bodies = [[np.cumsum(b[0]).astype(np.uint64), *b[1:3], _of_within(b[3], b[1]), *b[4:]] if block >= 0 else b for block, b in zip(blocks, bodies, strict=True)]
    alone = sum(int(b[0][0]) for block, b in zip(blocks, bodies, strict=True) if block < 0)
    asks = [(block, b) for block, b in zip(blocks, bodies, strict=True) if block >= 0]
    joined = lambda i, kind: np.concatenate([b[i] for _, b in asks]) if asks else np.zeros(0, kind)
    if n == 1:
        keys, counts = joined(0, np.uint64), joined(1, np.int64)
    else:
        slots, followers, singles, keys, counts, below = (joined(i, k) for i, k in enumerate((np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64)))
        names, _, slot = distinct(slots)
        singles, wanted = singles >> 1, singles & 1
        entry = np.repeat(np.arange(len(slots)), followers)
        whose = slot[entry]
        keys = mix(names[whose] * np.uint64(0xA24BAED4963EE407) + keys.astype(np.uint64))
    known, first, of = distinct(keys)
    totals = _sums(of, counts >> 1, len(known))
    marked = (2 * totals + (_sums(of, counts & 1, len(known)) > 0))[of]
    histogram = np.bincount(np.minimum(totals, _K + 2), minlength=_K + 3)[1 : _K + 2]
    histogram[0] += alone
    sizes = np.cumsum([0, *(len(b[-1 if n == 1 else 4]) for _, b in asks)])
    if n == 1:
        rows = [(block, bucket, packed(marked[i:j]), b"") for (block, _), i, j in zip(asks, sizes[:-1], sizes[1:], strict=True)]
    else:
        mine, seen = whose[first], totals > 0
        by_count = np.stack([_sums(mine[totals == r], None, len(names)) for r in range(1, _K + 1)], 1)
        single = _sums(slot, singles, len(names))
        by_count[:, 0] += single
        histogram[0] += single.sum()
        # the followers' counts after the shorter history: how many of one to five, and the sum of the others
        less, trained = np.zeros(len(known), np.int64), counts > 1
        less[of[trained]] = below[trained]
        short = np.stack([_sums(mine[less == r], None, len(names)) for r in range(1, _K + 1)], 1)
        short[:, 0] += single
        more = _sums(mine, np.where(less > _K, less, 0), len(names))
        edges = np.cumsum([0, *(len(b[0]) for _, b in asks)])
        # a history's sums go where one of its n-grams is unseen
        wanted[entry[~seen[of]]] = 1
        flags = 2 * by_count.any(1)[slot] + wanted
        rows = []
        for (block, _), i, j, x, y in zip(asks, sizes[:-1], sizes[1:], edges[:-1], edges[1:], strict=True):
            told = slot[x:y][wanted[x:y] > 0]
            rows.append((block, bucket, packed(marked[i:j]), packed(flags[x:y], *by_count[told].T, *short[told].T, more[told])))
    rows.append((-1, bucket, packed(histogram, np.array([(totals > 0).sum(), totals.sum()])), b""))
    if keep:
        rows.append((-2, bucket, packed(known[totals > 0], totals[totals > 0]), b""))
    return _rows(_ANSWER, rows)


class View:
    """What a block knows of the model by the answers to the first orders, at each of its places."""

    def __init__(self, block: Block, answers: pa.Table | None, levels: list[Level], history_rows: int, scored: bool = False):
        self.block, self.levels, self.history_rows, self.scored = block, levels, history_rows, scored
        #: by order: training count of the n-gram that ends at each place, and whether it occurs nowhere else in all documents
        self.count: list[np.ndarray] = []
        self.lone: list[np.ndarray] = []
        self.p = self.norm = np.zeros(len(block.place))
        for n in range(1, len(levels) + 1):
            self._learn(n, answers)

    def ask(self) -> Asked:
        """What the next order needs."""
        return Asked(self, len(self.count) + 1, self.history_rows)

    def _learn(self, n: int, answers: pa.Table) -> None:
        asked, level = self.ask(), self.levels[n - 1]
        mine = answers.filter(pa.compute.equal(answers["n"], n)).sort_by("bucket")
        marked = np.concatenate([unpacked(b.as_py())[0] for b in mine["counts"]]) if mine.num_rows else np.zeros(0, np.int64)
        count, lone = np.zeros(len(self.block.place), np.int64), np.zeros(len(self.block.place), bool)
        count[asked.at] = (marked >> 1)[asked.of]
        lone[asked.at] = (marked == 2)[asked.of]
        self.names, self.index = asked.names, np.full(len(count), -1)
        self.index[asked.at] = asked.of
        # lone parts make lone n-grams
        for at in (asked.hidden, asked.lone):
            count[at], lone[at] = 1, True
        if n == 1:
            whole, unknown = level.unigrams()
            self.p = np.where(count > 0, level.discounted(count) / whole, unknown)
            self.norm = np.full(len(count), 1 / whole)
        elif self.scored:
            sums = [unpacked(b.as_py()) for b in mine["sums"]]
            self._back_off(asked, level, count, [np.concatenate(c) for c in zip(*sums, strict=True)])
        self.count.append(count)
        self.lone.append(lone)

    def _back_off(self, asked: Asked, level: Level, count: np.ndarray, sums: list[np.ndarray]) -> None:
        """Brings the probability and s(h) / c(h) at each place up by one order. sums: by salted history, whether a follower was seen five times
        at most (2) and whether the sums follow (1); for these the followers seen once to five times, those of such counts after the shorter
        history, and the sum of the greater counts there."""
        discounts, size, below = level.discounts(), len(asked.salts), self.levels[len(self.count) - 1].discounts()
        flags, *parts = sums or [np.zeros(0, np.int64)] * (2 * _K + 2)
        # no place uses what was not told
        freed, low = np.full((2, len(flags)), np.nan)
        told = (flags & 1) > 0
        freed[told] = sum(r * (1 - discounts[r]) * x for r, x in enumerate(parts[:_K], 1))
        low[told] = parts[-1] + sum(r * below[r] * x for r, x in enumerate(parts[_K:-1], 1))
        # over the salts of each history
        some, freed, below = (np.bincount(asked.owner, x, size)[asked.history] for x in (flags >> 1, freed, low))
        total = self.count[-1][asked.valid - 1]
        scale, backoff = weights(some > 0, freed / total, self.norm[asked.valid] * below, total)
        seen = count[asked.valid]
        p, norm = self.p.copy(), np.zeros(len(self.p))
        p[asked.valid] = np.where(seen > 0, scale * level.discounted(seen) / total, backoff * p[asked.valid])
        norm[asked.valid] = scale / total
        # histories that occur once have one follower
        p[asked.lone], norm[asked.lone] = discounts[1], 1.0
        self.p, self.norm = p, norm


def weights(some: np.ndarray, freed: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale and backoff weight of histories: whether a follower is discounted, the share that discounts free, the sum after the shorter history."""
    scale = np.where(some, 1.0, counts / (counts + 1.0))
    return scale, np.where(some, freed, 1 / (counts + 1.0)) / np.maximum(1 - low, 1e-300)


class KatzModel:
    """The steps over the tables of one corpus. ``order``: tokens of the longest n-gram."""

    def __init__(self, docs: DataFrame, train: Column, id_column: str, text_column: str, order: int, keep_keys: bool = False):
        self.spark, self.order, self.keep_keys = docs.sparkSession, order, keep_keys
        self.name = f"katz_{uuid.uuid4().hex}"
        self.folder = f"{ensure_checkpoint_dir(self.spark)}/{self.name}"
        self.levels: list[Level] = []
        rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
        self.id_type = rows.schema["id"].dataType
        self._write_blocks(rows, partitions(docs))
        blocks = self.spark.table(self.name).select("block").distinct().count()
        self.ranges = max(1, -(-blocks // RANGE_BLOCKS))

    def _write_blocks(self, rows: DataFrame, buckets: int) -> None:
        schema = T.StructType([*rows.schema.fields, T.StructField("block", T.LongType())])
        size = BLOCK_BYTES

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, held = TaskContext.get().partitionId() << 32, 0
            for batch in batches:
                sizes, blocks = np.diff(buffers(batch.column(1))[1]).tolist(), []
                for n in sizes:
                    if held and held + n > size:
                        block, held = block + 1, 0
                    held += n
                    blocks.append(block)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], names=schema.names)

        writer = rows.mapInArrow(number, schema).write.format("parquet").option("compression", "zstd")
        writer.bucketBy(buckets, "block").sortBy("block").saveAsTable(self.name)

    def drop(self) -> None:
        """Removes the tables of blocks and answers."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_folder(self.spark, self.folder)

    def _over_blocks(self, function, schema, sums: bool = False) -> DataFrame:
        """The function over each block's documents and the answers to it so far."""
        docs = self.spark.table(self.name).groupBy("block")
        columns = ["block", "bucket", "counts", *(["sums"] if sums else [])]
        parts = [self.spark.read.parquet(f"{self.folder}/order={n}").filter("block >= 0").select(*columns, F.lit(n).alias("n")) for n in range(1, len(self.levels) + 1)]
        if not parts:
            return docs.applyInArrow(lambda table: function(table, None), schema)
        return docs.cogroup(reduce(DataFrame.union, parts).groupBy("block")).applyInArrow(function, schema)

    def count(self) -> None:
        """Counts the n-grams of the next order over all blocks and stores the answers."""
        levels, ranges, keep, history_rows = list(self.levels), self.ranges, self.keep_keys, HISTORY_ROWS
        n = len(levels) + 1

        def ask(table: pa.Table, answers: pa.Table | None) -> pa.Table:
            asked = View(Block(table, n), answers, levels, history_rows).ask()
            # n-grams of histories that occur once are counted here
            return _rows(_ASK, [*asked.rows(table["block"][0].as_py(), ranges), (-1, 0, packed(np.array([len(asked.lone)])))])

        def reply(table: pa.Table) -> pa.Table:
            return answer(table, n, keep)

        path = f"{self.folder}/order={n}"
        with once(self.spark):
            self._over_blocks(ask, _ASK).groupBy("bucket").applyInArrow(reply, _ANSWER).write.option("compression", "zstd").parquet(path)
        found = self.spark.read.parquet(path).filter("block = -1").select("counts").mapInArrow(_added, "n array<long>").collect()
        numbers = [int(sum(x)) for x in zip(*(r.n for r in found), strict=True)] or [0] * (_K + 3)
        self.levels.append(Level(numbers[-1], numbers[-2], [0, *numbers[: _K + 1]]))

    def scores(self, id_column: str) -> DataFrame:
        """One row for each document: id, held_out, tokens, known tokens, training tokens, unigram base score, score."""
        levels, order, history_rows = list(self.levels), self.order, HISTORY_ROWS
        fields = (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))
        schema = T.StructType([T.StructField(id_column, self.id_type), *(T.StructField(c, t) for c, t in fields)])
        names = schema.names

        def score(table: pa.Table, answers: pa.Table) -> pa.Table:
            block = Block(table, order)
            view = View(block, answers, levels, history_rows, scored=True)
            base = np.log10((view.count[0] + 1) / (levels[0].total + levels[0].distinct + 1))
            columns = [np.add.reduceat(x, block.starts[:-1]) for x in ((view.count[0] > 0).astype(np.int64), base, np.log10(view.p))]
            lengths = np.diff(block.starts)
            held, constant = pa.compute.invert(table["train"]), np.full(len(lengths), levels[0].total)
            return pa.Table.from_arrays([table["id"], held, *map(pa.array, (lengths, columns[0], constant, columns[1], columns[2]))], names=names)

        return self._over_blocks(score, schema, sums=True)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of counts of a task's ranges, added up: a row of eight numbers."""
    total = np.zeros(_K + 3, np.int64)
    for batch in batches:
        for body in batch.column(0):
            total += np.concatenate(unpacked(body.as_py()))
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n"])


def train_share(id_column: str = "doc_id") -> Column:
    """Documents to learn from: crc32 of the id as text is not 2 mod 7."""
    return F.crc32(F.encode(F.coalesce(F.col(id_column).cast("string"), F.lit("")), "UTF-8")) % 7 != 2


def katz_scores(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text", order: int = 3) -> DataFrame:
    """Scores all documents by a model of those for which ``train`` is true. The tables go when the scores are written;
    to keep them, use KatzModel."""
    model = KatzModel(docs, train, id_column, text_column, order)
    for _ in range(order):
        model.count()
    scratch = Scratch(model.spark)
    out = scratch.keep(model.scores(id_column))
    model.drop()
    return out
