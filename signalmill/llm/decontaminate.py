"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised: each letter or digit becomes one lower-case unit, anything else a space, and runs of
spaces one. A document leaks a passage of m units if it holds it with m / 10 edits at most, whatever its length. A passage (or a segment
of a long one, see Passages) of m units with at most e edits keeps at least m + 1 - q - q e of its
q-grams (q is 8, or 5 where 8 leaves none), on diagonals (place in the document less place in the passage) that differ by e at most.
So, for each document:

1. the q-grams of the document are looked up among those of the benchmark (as bytes, in which units that are not ASCII share 128 classes);
2. the hits are counted by passage and diagonal band; bands are 2 (e + 1) wide and overlap by half, so
   that one of them holds all hits of a match;
3. bands that reach the bound are retained, those of a passage that overlap are joined, and one banded alignment of the units themselves, by bits,
   finds the passage's least number of edits.

The q-grams most frequent in the benchmark are left out of a passage's lookup, and its bound is lowered by as many, so
nothing within the edit budget is lost. The benchmark is broadcast in slices of bounded size, one after the other: each is one more scan of the
documents, whose result is kept in the checkpoint folder before the next slice is made.

Cases: null or empty texts match nothing; passages that are null or have fewer than 8 units match nothing; documents
of any length are read whole; repeated rows are searched one by one; empty tables give an empty
result or leave all documents; other columns are ignored by ``find_leaks`` and passed through by
``drop_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import checkpointed

Q = 8
# for short passages whose bound is not positive with Q
SHORT_Q = 5
_SLOT_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LeakOptions:
    """edit_rate: edits per unit of a passage that still count as a leak. frequent: q-grams that stand oftener than this in the
    benchmark are not looked up, as far as half of a passage's bound allows. slice_chars: benchmark text that is broadcast at once."""

    edit_rate: float = 0.1
    frequent: int = 16
    segment_chars: int = 400
    slice_chars: int = 16_000_000
    batch_chars: int = 1 << 20


_LOWER: list[np.ndarray] = []


def lower_table() -> np.ndarray:
    """For each code point its unit: a letter or digit in lower case, a space for anything else."""
    if not _LOWER:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalnum():
                table[c] = ord(s.lower()[0])
        table[0] = 0  # stands between texts
        _LOWER.append(table)
    return _LOWER[0]


def folded(units: np.ndarray) -> np.ndarray:
    """Units as bytes, for q-grams: ASCII as it is, others in 128 classes. Equal units fold alike, so no shared q-gram is lost."""
    return np.where(units < 128, units, 128 + (units * np.uint32(2654435761) >> np.uint32(7)) % np.uint32(128)).astype(np.uint8)


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of all texts, each text after a 0; where each begins (with the end); the code point in the joined texts of each unit."""
    joined = "\0" + "\0".join((t or "").replace("\0", " ") for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    units = lower_table()[points]
    keep = np.ones(len(units), bool)
    keep[1:] = (units[1:] != 32) | ((units[:-1] != 32) & (units[:-1] != 0))
    places = np.flatnonzero(keep)
    units = units[places]
    return units, np.flatnonzero(units == 0) + 1, places


def grams(units: np.ndarray) -> np.ndarray:
    """Each run of eight units as one number."""
    n = len(units) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    raw = units.tobytes()
    for o in range(Q):
        part = np.frombuffer(raw, "<u8", (len(raw) - o) // 8, o)
        out[o::8] = part[: len(out[o::8])]
    return out


def short_grams(units: np.ndarray) -> np.ndarray:
    """Each run of five units as one number."""
    return grams(np.concatenate((units, np.zeros(Q - SHORT_Q, np.uint8)))) & np.uint64((1 << 8 * SHORT_Q) - 1)


class Passages:
    """Benchmark passages, cut into segments, and the lookup of the segments' q-grams.

    A passage with e edits that is cut into k segments has one with e / k at most, which is what a segment is searched with; what it finds is
    verified for the whole passage and all its edits. ``whole``: each segment's passage; places are places in the passage."""

    def __init__(self, items: list[tuple], options: LeakOptions):
        self.items, self.units, self.most, self.whole, self.edits, self.bounds, self.short = [], [], [], [], [], [], False
        owners, places, keys = [], [], []
        for key, text in items:
            units = normalised([text])[0][1:-1]
            units = units[: len(units) - (len(units) > 0 and units[-1] == 32)]
            if len(units) < Q:
                continue
            most, k = int(options.edit_rate * len(units)), -(-len(units) // options.segment_chars)
            self.items.append(key)
            self.units.append(units)
            self.most.append(most)
            bytes_, edges = folded(units), np.linspace(0, len(units), k + 1).astype(int)
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                segment, m, e = bytes_[start:end], int(end - start), most // k
                q = Q if m + 1 - Q - Q * e >= 1 else SHORT_Q
                self.short |= q < Q
                self.whole.append(len(self.items) - 1)
                self.edits.append(e)
                self.bounds.append(max(1, m + 1 - q - q * e))
                keys.append(grams(segment) if q == Q else short_grams(segment))
                places.append(start + np.arange(len(keys[-1])))
                owners.append(np.full(len(keys[-1]), len(self.whole) - 1))
        self.edits, self.bounds = np.array(self.edits, np.int64), np.array(self.bounds, np.int64)
        if not self.items:
            self.keys = np.zeros(0, np.uint64)
            return
        every = np.concatenate(keys)
        _, inverse, often = np.unique(every, return_inverse=True, return_counts=True)
        often, at, kept = often[inverse], 0, []
        for i, k in enumerate(keys):  # leave out the most frequent, as far as the bound allows
            spare = max(0, int(self.bounds[i]) // 2)
            counts = often[at : at + len(k)]
            order = np.argsort(-counts, kind="stable")[:spare]
            out = order[counts[order] > options.frequent]
            self.bounds[i] -= len(out)
            mask = np.ones(len(k), bool)
            mask[out] = False
            kept.append(mask)
            at += len(k)
        mask = np.concatenate(kept)
        every, owners, places = every[mask], np.concatenate(owners)[mask], np.concatenate(places)[mask]
        order = np.argsort(every, kind="stable")
        self.owners, self.places = owners[order], places[order]
        self.keys, self.starts = np.unique(every[order], return_index=True)
        self.counts = np.diff(np.append(self.starts, len(every)))
        self.slots = np.zeros(1 << _SLOT_BITS, bool)
        self.slots[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _MULTIPLIER) >> np.uint64(64 - _SLOT_BITS)

    def hits(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the folded units, segment, place in its passage) of each shared q-gram."""
        found = grams(units)
        at = np.flatnonzero(self.slots[self._slot(found)])
        found = found[at]
        if self.short:
            less = short_grams(units)
            there = np.flatnonzero(self.slots[self._slot(less)])
            at, found = np.concatenate((at, there)), np.concatenate((found, less[there]))
        key = np.searchsorted(self.keys, found)
        same = self.keys[np.minimum(key, len(self.keys) - 1)] == found
        at, key = at[same], key[same]
        counts = self.counts[key]
        entry = np.repeat(self.starts[key] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        return np.repeat(at, counts), self.owners[entry], self.places[entry]


def banded_alignment(passage: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """The least number of edits between the passage and a part of the text on diagonals from low - most to high + most, and where it first
    ends; None beyond ``most``. Steps between rows of the band are bits of whole numbers, so a unit of the text takes a few operations on them;
    the band moves down every so many units, and ends where all of it is beyond ``most``."""
    size, raw, wanted = text.dtype.itemsize, text.tobytes(), passage.tobytes()
    whole = raw.find(wanted, max(low, 0) * size)
    while whole >= 0 and whole % size:
        whole = raw.find(wanted, whole + 1)
    if 0 <= whole <= high * size:
        return 0, whole // size + len(passage)
    at, last = max(0, low - most), min(len(text), high + most + len(passage))
    top, bottom = 0, 0  # rows (units of the passage) top + 1 to bottom are held
    up, down, value, best = 0, 0, 0, None  # steps between rows as bits, the value of row top
    while at < last:
        stop, before = min(last, at + _COLUMNS), bottom
        gone = max(0, at - high - most) - top
        if gone > 0:
            cut = (1 << gone) - 1
            value += (up & cut).bit_count() - (down & cut).bit_count()
            up, down, top = up >> gone, down >> gone, top + gone
        bottom = max(before, min(len(passage), stop - low + most))
        if bottom <= top:
            break
        mask = (1 << bottom - top) - 1
        up |= mask & ~((1 << max(0, before - top)) - 1)
        if top and value + _least_sum(up, down, bottom - top) > most:
            break
        units, places = np.unique(text[at:stop], return_inverse=True)
        same = [int.from_bytes(np.packbits(passage[top:bottom] == u, bitorder="little").tobytes(), "little") for u in units]
        # a match begins anywhere above the passage's first row; rows that are gone grow by one
        step, width = int(top > 0), bottom - top
        whole = value + up.bit_count() - down.bit_count() if bottom == len(passage) else None
        if whole is not None and whole <= most and (best is None or whole < best[0]):
            best = whole, at
        for column, u in enumerate(places.tolist(), at + 1):
            eq = same[u]
            vertical = eq | down
            across = ((((eq & up) + up) ^ up) | eq) & mask
            more, less = down | mask ^ (across | up), up & across
            if whole is not None:
                whole += (more >> width - 1) - (less >> width - 1)
                if whole <= most and (best is None or whole < best[0]):
                    best = whole, column
            more, less = (more << 1 | step) & mask, less << 1 & mask
            up, down = less | mask ^ (vertical | more), more & vertical
        value, at = value + step * (stop - at), stop
    return best


_COLUMNS = 256


def _least_sum(up: int, down: int, width: int) -> int:
    """The least sum of steps from the first row on."""
    size = -(-width // 8)
    rows = [np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), bitorder="little")[:width].astype(np.int32) for x in (up, down)]
    return min(0, int(np.cumsum(rows[0] - rows[1]).min()))


def find_in_texts(texts: list[str | None], passages: Passages) -> list[list[tuple]]:
    """For each text, its leaks (item, start, end, edits, passage units): the best place of each item."""
    out: list[list[tuple]] = [[] for _ in texts]
    if not len(passages.keys):
        return out
    units, begins, places = normalised(texts)
    at, owner, i = passages.hits(folded(units))
    if not len(at):
        return out
    document = np.searchsorted(begins, at, "right") - 1
    edits = passages.edits[owner]
    band = (at - i) // (edits + 1)
    both = [np.stack((document, owner, band - k)) for k in (0, 1)]  # band b: diagonals b (e + 1) to (b + 2) (e + 1) - 1
    keys, counts = np.unique(np.concatenate(both, 1), axis=1, return_counts=True) if len(at) < 50_000 else _counted(np.concatenate(both, 1))
    keep = counts >= passages.bounds[keys[1]]
    best: dict[tuple, tuple] = {}
    for (d, w), (low, high) in _joined_bands(keys[:, keep], begins, passages):
        passage, item = passages.units[w], passages.items[w]
        # what is found later must be better
        e = min(passages.most[w], best.get((d, item), (1 << 30,))[0] - 1)
        if e < 0:
            continue
        # the segment's diagonals; the alignment may leave them by the whole passage's edits
        a, z = max(0, low - e), min(int(begins[d + 1]) - 1 - int(begins[d]), high + e + len(passage))
        if z <= a:
            continue
        text = units[begins[d] + a : begins[d] + z]
        found = banded_alignment(passage, text, low - a, high - a, e)
        if found:
            end = a + found[1]
            best[d, item] = (found[0], max(0, end - len(passage)), end, len(passage))
    for (d, item), (n, start, end, m) in best.items():
        origin = places[begins[d]]
        first, last = places[begins[d] + start] - origin, places[begins[d] + max(start, end - 1)] - origin + 1
        out[d].append((item, int(first), int(last), n, m))
    return out


def _joined_bands(bands: np.ndarray, begins: np.ndarray, passages: Passages) -> Iterator[tuple]:
    """((document, passage), (first, last diagonal)) of retained bands; those of a document and a passage that an alignment would see together are one."""
    d, o, b = bands
    step = passages.edits[o] + 1
    w, low = np.array(passages.whole, np.int64)[o], b * step - begins[d]
    high, order = low + 2 * step - 1, np.lexsort((low, w, d))
    held: tuple | None = None
    for one, first, last in zip(zip(d[order].tolist(), w[order].tolist(), strict=True), low[order].tolist(), high[order].tolist(), strict=True):
        if held and held[0] == one and first <= held[1][1] + 2 * passages.most[one[1]]:
            held = one, (held[1][0], max(held[1][1], last))
            continue
        if held:
            yield held
        held = one, (first, last)
    if held:
        yield held


def _counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique over columns of three numbers, by one packed number."""
    low = rows.min(1, keepdims=True)
    span = (rows.max(1, keepdims=True) - low + 1).astype(object)
    if int(span[0, 0]) * int(span[1, 0]) * int(span[2, 0]) >= 2**62:
        return np.unique(rows, axis=1, return_counts=True)
    rows, (b, c) = rows - low, (int(span[1, 0]), int(span[2, 0]))
    packed, counts = np.unique((rows[0] * b + rows[1]) * c + rows[2], return_counts=True)
    return np.stack((packed // (b * c), packed // c % b, packed % c)) + low, counts


def _slices(benchmark: DataFrame, item_column: str, text_column: str, options: LeakOptions) -> Iterator[tuple]:
    """Broadcasts of benchmark slices, each of a bounded size, and whether it is the only one. The next is made when the one before is used up."""
    rows = benchmark.select(F.col(item_column).alias("item"), F.col(text_column).cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // options.slice_chars))
    for s in range(n):
        items = [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == s).collect()]
        held = rows.sparkSession.sparkContext.broadcast(Passages(items, options))
        yield held, n == 1
        if n > 1:
            held.destroy()


def _batches(batches: Iterator[pa.RecordBatch], place: int, chars: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches of about so many characters each, with their texts."""
    for batch in batches:
        texts = batch.column(place).cast(pa.string()).to_pylist()
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (j == i or held + len(texts[j] or "") <= chars):
                held += len(texts[j] or "")
                j += 1
            yield batch.slice(i, j - i), texts[i:j]
            i = j


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", options: LeakOptions | None = None) -> DataFrame:
    """One row for each document and benchmark item in it: where (code points), the edits and the units of the passage."""
    options = options or LeakOptions()
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    kinds = rows.schema["id"].dataType, benchmark.schema[item_column].dataType
    longs = ("start", "end", "edits", "passage_units")
    schema = T.StructType([T.StructField(id_column, kinds[0]), T.StructField(item_column, kinds[1]), *(T.StructField(n, T.LongType()) for n in longs)])

    def with_slice(passages) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in _batches(batches, 1, options.batch_chars):
                found = find_in_texts(texts, passages.value)
                at = [k for k, f in enumerate(found) for _ in f]
                leaks = [x for f in found for x in f]
                if leaks:
                    items, *rest = zip(*leaks, strict=True)
                    arrow = pa.array(items, _arrow_type(kinds[1]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), arrow, *(pa.array(r, pa.int64()) for r in rest)], names=schema.names)

        return rows.mapInArrow(search, schema)

    parts = [with_slice(p) if only else checkpointed(with_slice(p)) for p, only in _slices(benchmark, item_column, item_text_column, options)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", options: LeakOptions | None = None) -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns."""
    options = options or LeakOptions()
    place = docs.columns.index(text_column)

    def with_slice(frame: DataFrame, passages) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in _batches(batches, place, options.batch_chars):
                yield batch.filter(pa.array([not f for f in find_in_texts(texts, passages.value)], pa.bool_()))

        return frame.mapInArrow(search, frame.schema)

    for passages, only in _slices(benchmark, item_column, item_text_column, options):
        docs = with_slice(docs, passages) if only else checkpointed(with_slice(docs, passages))
    return docs


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
