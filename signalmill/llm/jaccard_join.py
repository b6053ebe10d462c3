"""N-gram Jaccard join: T-occurrence search by DivideSkip over inverted lists of word shingles.

Two documents link when the Jaccard similarity of their shingle sets reaches a bound. Steps:

1. Documents with equal sets form a class; the smallest id stands for it.
2. A global order puts rare shingles first: by the count of the rarest word, which no shingle exceeds.
   Counts come from a table of 2^19 hashed counters that every task fills with all words of its documents; the
   table has a fixed size, so it may be broadcast. Any order gives whole results. Sets that reach the bound share
   l shingles at least among their first n - ceil(t n) + l in that order; l is a share of n (``SHARED_PERCENT``).
3. The inverted list of each such shingle names its smallest id as hub. All documents of a list
   meet in the group of its hub, so each linking pair meets in one group at least, while a
   document goes only to its few distinct hubs rather than to each of its shingles. Long lists are salted.
   Sets with fewer than l shingles in lists of two or more are out. Each set leaves the hubs it shares fewest lists with, for
   less than l / 2 lists in all: a linking pair then still has a list in common.
4. In a group, DivideSkip answers which sets reach the overlap T: the short inverted lists are
   merged and counted, the L longest are probed by binary search. Groups over a size go in blocks: first
   the hub against each block, then what didn't link with the hub against all blocks. Tasks
   return a spanning forest of the links, never all pairs; no pair that could join two components is skipped.
5. Connected components of the forests, by repeated contraction to the smallest neighbour.

Cases: null or blank texts have an empty set and link with nothing, not even each other; rows that share an id are
each judged by their own text; a null id gets a null component and gives its id to none; very long
texts are read whole; an empty table gives an empty result; other columns are ignored or, in
``keep_first``, passed through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import Scratch, buffers, checkpointed, mix, partitions, row_chunks, shingle_hashes, unused, word_hashes

#: Counters of words, as a power of 2; the broadcast table holds 8 bytes for each.
SKETCH_BITS = 19
#: Shingles that must be shared among the first ones, as a percentage of the set.
SHARED_PERCENT = 4
#: Rows of an inverted list that go to one task; longer lists are salted.
LIST_ROWS = 65_536
#: Shingles of a group that one task holds; larger groups go in blocks.
BLOCK_SHINGLES = 400_000
#: Hubs of groups over a block that are broadcast at most.
BROADCAST_HUBS = 500_000


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text of a column."""
    data, offsets = buffers(column)
    for i, j in row_chunks(offsets):
        words, rows = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            yield words[a:b]


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    for words in _words(column):
        yield np.unique(shingle_hashes(words, k))


def _rarity_of_shingles(counts: np.ndarray, k: int) -> np.ndarray:
    """The least of the counts of each shingle's words."""
    if len(counts) < k:
        return counts.min(keepdims=True)
    return np.lib.stride_tricks.sliding_window_view(counts, k).min(1)


def least_overlap(n: int, m: int, percent: int) -> int:
    """Shingles that sets of n and m share at least when 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + max(1, SHARED_PERCENT * n // 100)


# ---- DivideSkip in one group


class _Forest:
    """The trees that the sets of a group are joined in so far, by one label for each set; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.tree, self.links = np.arange(n), []

    def join(self, i: int, others: np.ndarray) -> None:
        """Links set i with others, none of them in its tree; one link for each tree is kept."""
        trees, first = np.unique(self.tree[others], return_index=True)
        self.links += [(i, int(j)) for j in others[first]]
        self.tree[np.isin(self.tree, trees)] = self.tree[i]


class InvertedLists:
    """The inverted lists of some sets; each list holds the places of the sets that have its shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.entries = owner[order]
        self.keys, self.starts = np.unique(every[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(every))

    def search(self, query: np.ndarray, percent: int, tree: np.ndarray | None = None, own: int = -1) -> np.ndarray:
        """Places of the sets that share the least overlap with the query; not those whose tree is the query's own."""
        n = len(query)
        if n == 0 or len(self.keys) == 0:
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.keys, query)
        at = at[self.keys[np.minimum(at, len(self.keys) - 1)] == query]
        t = least_overlap(n, -(-percent * n // 100), percent)
        if len(at) < t:
            return np.zeros(0, np.int64)
        lengths = self.ends[at] - self.starts[at]
        at = at[np.argsort(lengths, kind="stable")]
        longest = int(lengths.max())
        long = min(t - 1, int(t / (0.0085 * math.log2(longest + 1) + 1)))
        short = at[: len(at) - long]
        # merge the short lists: sorted runs, brought into one order and counted
        merged = np.sort(np.concatenate([self.entries[self.starts[i] : self.ends[i]] for i in short]), kind="stable")
        found, counts = np.unique(merged, return_counts=True)
        need = np.maximum(t, -(-percent * (n + self.sizes[found]) // (100 + percent)))
        fits = (100 * np.minimum(n, self.sizes[found]) >= percent * np.maximum(n, self.sizes[found])) & (counts >= need - long)
        if tree is not None:
            fits &= tree[found] != own
        found, counts, need = found[fits], counts[fits], need[fits]
        # probe the long lists by binary search, while the candidate can still reach the overlap
        for left, i in zip(range(long - 1, -1, -1), at[len(at) - long :], strict=True):
            if not len(found):
                break
            one = self.entries[self.starts[i] : self.ends[i]]
            place = np.searchsorted(one, found)
            counts = counts + (one[np.minimum(place, len(one) - 1)] == found)
            alive = counts >= need - left
            found, counts, need = found[alive], counts[alive], need[alive]
        return found[counts >= need]


def link_group(sets: list[np.ndarray], queries: list[int], percent: int, forest: _Forest, base: int | None) -> None:
    """Adds to the forest the links between the queries (places of sets) and all sets.

    A query that is in the component of ``base`` by its turn needs no search: whatever else links
    with it is out of that component, so is a query, here or in another task, and finds it.
    """
    lists = InvertedLists(sets)
    for q in queries:
        own = int(forest.tree[q])
        if base is None or q == base or own != forest.tree[base]:
            found = lists.search(sets[q], percent, forest.tree, own)
            if len(found):
                forest.join(q, found)


# ---- the distributed join


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _pieces(table: np.ndarray, n: int = 64) -> pa.RecordBatch:
    """A table of counters as rows of (piece, counts), to be summed by piece."""
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(np.split(np.minimum(table, 2**30).astype(np.int32), n), pa.list_(pa.int32()))], names=["piece", "counts"])


def _summed(frame: DataFrame) -> np.ndarray:
    """The sum of the tasks' counters: at most 2^SKETCH_BITS numbers come to the driver."""

    def add(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in pieces:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[piece] = np.minimum(total.get(piece, 0) + counts.values.to_numpy().astype(np.int64), 2**30).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.int32()))], names=["piece", "counts"])

    rows = frame.repartition(min(64, partitions(frame)), "piece").mapInArrow(add, "piece int, counts array<int>").toArrow()
    out = np.zeros((64, (1 << SKETCH_BITS) // 64), np.int64)
    for piece, counts in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
        out[piece] = counts.values.to_numpy()
    return out.ravel()


def _digest(s: np.ndarray) -> int:
    """One number for a whole set, the key of its class."""
    return int(mix(np.add.reduce(mix(s + np.uint64(0x632BE59BD9B4E019)))[None] + np.uint64(len(s)))[0].astype(np.int64))


def _described(rows: DataFrame, k: int) -> DataFrame:
    """Rows (id, n, node) for each document, and rows (piece, counts) of the rarity table for each task."""
    schema = T.StructType([*rows.select("id").schema.fields, T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kind = np.zeros(1 << SKETCH_BITS, np.int64), None
        for batch in batches:
            kind, n, node, seen, held = batch.schema.field(0).type, [], [], [], 0
            for words in _words(batch.column(1)):
                s = np.unique(shingle_hashes(words, k))
                n.append(len(s))
                node.append(_digest(s) if len(s) else None)
                seen.append(_slot(words))
                held += len(words)
                if held > 1_000_000:
                    table += np.bincount(np.concatenate(seen), minlength=len(table))
                    seen, held = [], 0
            if held:
                table += np.bincount(np.concatenate(seen), minlength=len(table))
            empty = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), *empty], names=schema.names)
        if kind is not None:
            p = _pieces(table)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(p), kind), pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.int64()), *p.columns], names=schema.names)

    return rows.mapInArrow(describe, schema)


def _postings(rows: DataFrame, k: int, percent: int, rarity) -> DataFrame:
    """Entries of the inverted lists: (shingle, salt, salts, node, n) for each shingle of the rare prefix of each set."""

    limit = LIST_ROWS

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = rarity.value, set()
        for batch in batches:
            keys, counts, nodes, sizes, lengths = [], [], [], [], []
            for words in _words(batch.column(1)):
                s, first = np.unique(shingle_hashes(words, k), return_index=True)
                if not len(s) or (node := _digest(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                rare = _rarity_of_shingles(table[_slot(words)], k)[first]
                order = np.argsort(rare, kind="stable")[: prefix_length(len(s), percent)]
                keys.append(s[order])
                counts.append(rare[order])
                nodes.append(node)
                sizes.append(len(s))
                lengths.append(len(keys[-1]))
            if keys:
                x = np.concatenate(keys)
                node, n = np.repeat(nodes, lengths), np.repeat(sizes, lengths)
                salts = 1 + np.concatenate(counts) // limit
                salt = mix(node.astype(np.uint64)).astype(np.int64) % salts
                arrays = [x.astype(np.int64), salt.astype(np.int32), salts.astype(np.int32), node, n]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["x", "salt", "salts", "node", "n"])

    return rows.mapInArrow(post, "x long, salt int, salts int, node long, n long")


def _groups(postings: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(hub, node, n): the sets that meet."""
    one = Window.partitionBy("x", "salt")
    local = postings.withColumns({"low": F.min("node").over(one), "high": F.max("node").over(one)})
    local = scratch.keep(local.filter((F.col("salts") > 1) | (F.col("low") < F.col("high"))))
    light = local.filter("salts = 1").select(F.col("low").alias("hub"), "node", "n")
    heavy = local.filter("salts > 1")
    tops = heavy.groupBy("x").agg(F.min("low").alias("hub"), F.max("high").alias("top")).filter("hub < top")
    met = light.union(heavy.join(tops, "x").select("hub", "node", "n")).groupBy("hub", "node", "n").agg(F.count("*").alias("lists"))
    mine = Window.partitionBy("node")
    shared = F.expr(f"greatest(1, {SHARED_PERCENT} * (({percent} * n + 99) DIV 100) DIV 100)")
    met = met.withColumns({"shared": shared, "in_all": F.sum("lists").over(mine), "up_to": F.sum("lists").over(mine.orderBy("lists", "hub"))})
    return met.filter("in_all >= shared AND up_to > (shared - 1) DIV 2").select("hub", "node", "n")


def _sets_of(rows: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the sets in groups. A bitmap of fixed size drops most others before any shuffle."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            table[_slot(mix(batch.column(0).to_numpy().astype(np.uint64)))] = 1
        yield _pieces(table)

    wanted = groups.select("node").distinct()
    marks = rows.sparkSession.sparkContext.broadcast(_summed(wanted.mapInArrow(mark, "piece int, counts array<int>")) > 0)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = marks.value
        for batch in batches:
            nodes, sets, held = [], [], 0
            for s in shingle_sets(batch.column(1), k):
                if len(s) and table[_slot(mix(np.array([node := _digest(s)], np.int64).astype(np.uint64)))[0]]:
                    nodes.append(node)
                    sets.append(s.astype(np.int64))
                    held += len(s)
                if held > BLOCK_SHINGLES:
                    yield _sets_batch(nodes, sets)
                    nodes, sets, held = [], [], 0
            if nodes:
                yield _sets_batch(nodes, sets)

    found = rows.mapInArrow(gather, "node long, shingles array<long>")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _sets_batch(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["node", "shingles"])


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of consecutive batches, one list for each run of equal leading keys; the last column is an array."""
    now, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:-1]]
        arrays, offsets = batch.columns[-1].values.to_numpy(), batch.columns[-1].offsets.to_numpy()
        for i in range(batch.num_rows):
            key = tuple(c[i] for c in columns[:keys])
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append((*(c[i] for c in columns[keys:]), arrays[offsets[i] : offsets[i + 1]].astype(np.uint64)))
    if held:
        yield now, held


def _members(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, pivot, blocks, node, shingles). blocks: how many tasks share a group of over BLOCK_SHINGLES; its pivot is its smallest node.

    Groups of one block are left as they are, so that only the few large hubs are joined: one for each BLOCK_SHINGLES shingles
    at most, broadcast up to ``BROADCAST_HUBS`` of them."""
    size = F.ceil(F.col("shingles_in_all") / BLOCK_SHINGLES).cast("int")
    large = groups.groupBy("hub").agg(F.sum("n").alias("shingles_in_all"), F.min("node").alias("pivot")).withColumn("blocks", size)
    large = large.filter("blocks > 1").select("hub", "pivot", "blocks")
    if large.count() <= BROADCAST_HUBS:
        large = F.broadcast(large)
    groups = groups.join(large, "hub", "left").na.fill(1, ["blocks"])
    return groups.select("hub", "pivot", "blocks", "node").join(sets, "node").select("hub", "pivot", "blocks", "node", "shingles")


def _links(members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): links between sets, a spanning forest of each group."""
    tasks = partitions(members)
    own = F.pmod(F.hash("node"), F.col("blocks"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)

    def dealt(frame: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
        return frame.repartition(tasks, *keys).sortWithinPartitions(*keys, "node").select(*keys, *rest, "shingles")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hub, _, blocks), rows in _by_group(batches, 3):
            if len(rows) < 2:
                continue
            nodes, forest, whole = [r[1] for r in rows], _Forest(len(rows)), blocks == 1
            # the pivot goes first
            base = 0 if whole else next(i for i, r in enumerate(rows) if r[0] == r[1])
            link_group([r[2] for r in rows], range(len(rows)) if whole else [base], percent, forest, base)
            a, b = [nodes[i] for i, _ in forest.links], [nodes[j] for _, j in forest.links]
            if not whole:
                left = [nodes[i] for i in np.flatnonzero(forest.tree != forest.tree[base])]
                a, b = a + [hub] * len(left), b + left
            done = [True] * len(forest.links) + [False] * (len(a) - len(forest.links))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(done, pa.bool_())], names=["a", "b", "linked"])

    # the pivot of a large group goes to every block
    placed = members.withColumn("block", F.explode(F.when(F.col("node") == F.col("pivot"), every).otherwise(F.array(own))))
    tried = scratch.keep(dealt(placed, ["hub", "block", "blocks"], ["pivot", "node"]).mapInArrow(first, "a long, b long, linked boolean"))
    links = tried.filter("linked").select("a", "b")
    open_ = tried.filter("NOT linked").select(F.col("a").alias("hub"), F.col("b").alias("node"))

    # what did not link with the pivot of a large group, against all its blocks
    large = members.filter("blocks > 1")
    asked = large.join(open_, ["hub", "node"], "left_semi")
    query_blocks = asked.groupBy("hub").agg(F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES).cast("int").alias("query_blocks"))
    queries = asked.join(query_blocks, "hub").withColumns({"turn": F.pmod(F.xxhash64("node"), F.col("query_blocks")).cast("int"), "asks": F.lit(1)}).withColumn("block", F.explode(every))
    answers = large.join(query_blocks, "hub").join(open_.withColumn("apart", F.lit(True)), ["hub", "node"], "left")
    answers = answers.withColumns({"block": own, "asks": F.when(F.col("apart"), 2).otherwise(0)}).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    columns = ["hub", "block", "turn", "asks", "node", "shingles"]

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_group(batches, 3):
            rows.sort(key=lambda r: r[0])
            nodes, forest = [r[1] for r in rows], _Forest(len(rows))
            joined = sum(r[0] == 0 for r in rows)
            forest.tree[:joined] = 0  # with the pivot already
            link_group([r[2] for r in rows], [i for i, r in enumerate(rows) if r[0] == 1], percent, forest, 0 if joined else None)
            a, b = [nodes[i] for i, _ in forest.links], [nodes[j] for _, j in forest.links]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    more = dealt(queries.select(columns).union(answers.select(columns)), ["hub", "block", "turn"], ["asks", "node"]).mapInArrow(second, "a long, b long")
    return links.union(more.filter("a <> b"))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is one number for each component.

    Each round maps every node to the smallest of itself and its neighbours and keeps the edges
    between the images; a path shrinks by more than half, a star in one round.
    """
    edges = scratch.keep(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")))
        steps.append(step)
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("u")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("v")), "b")
        edges = scratch.keep(moved.filter("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return reduce(_follow, steps[1:], steps[0].withColumnRenamed("to", "root"))


def _follow(labels: DataFrame, step: DataFrame) -> DataFrame:
    moved = labels.join(step.select(F.col("node").alias("root"), "to"), "root", "left")
    return moved.select("node", F.coalesce("to", "root").alias("root"))


def _classed(docs: DataFrame, id_column: str, text_column: str, shingle_words: int, percent: int) -> DataFrame:
    """(id, n, node, root) of each document. node: the class of its set; root: one number for each component; both null for an empty set."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    described = scratch.keep(_described(rows, shingle_words))
    rarity = spark.sparkContext.broadcast(_summed(described.filter("piece IS NOT NULL").select("piece", "counts")))
    groups = scratch.keep(_groups(_postings(rows, shingle_words, percent, rarity), percent, scratch))
    rarity.destroy()
    members = scratch.keep(_members(groups, _sets_of(rows, groups, shingle_words)))
    labels = connected_components(_links(members, percent, scratch), scratch)
    known = described.filter("piece IS NULL").select("id", "n", "node")
    out = checkpointed(known.join(labels, "node", "left").select("id", "n", "node", F.coalesce("root", "node").alias("root")))
    scratch.drop()
    return out


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: its id, ``n_shingles`` and ``component_id``, the smallest id it reaches by links."""
    found = _classed(docs, id_column, text_column, shingle_words, percent)
    least = found.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"))
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
    return found.join(least, "root", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), own)


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all columns: the one with the smallest id, of equal ids that with the smaller digest of its set.

    Rows that repeat an id are judged by id and set, so a text with no copy stays; of rows equal in both, the one with the smallest
    hash of its columns stays. Rows without an id all stay."""
    found = _classed(docs, id_column, text_column, shingle_words, percent).filter("id IS NOT NULL")
    first = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("id", "node")).alias("first"))
    judged = found.join(first, "root", "left").withColumn("gone", F.coalesce(F.col("first") != F.struct("id", "node"), F.lit(False)))
    again, gone, node = (unused(docs, n) for n in ("_again", "_gone", "_node"))
    repeated = judged.groupBy(F.col("id").alias(again)).agg(F.count("*").alias("rows")).filter("rows > 1").select(again)
    out = docs.join(judged.filter("gone").select(F.col("id").alias(gone)).distinct(), docs[id_column] == F.col(gone), "left_anti")
    if repeated.isEmpty():
        return out
    once = out.join(repeated, docs[id_column] == F.col(again), "left_anti")
    # rows that share an id: by id and set
    twice = docs.join(repeated, docs[id_column] == F.col(again), "left_semi")
    twice = _with_node(twice, text_column, shingle_words, node)
    leave = judged.filter("gone").select(F.col("id").alias(gone), F.col("node").alias(again)).distinct()
    twice = twice.join(leave, (twice[id_column] == F.col(gone)) & (twice[node] == F.col(again)), "left_anti")
    plain = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]
    one = twice.groupBy(id_column, node).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias(again))
    return once.unionByName(one.select(f"{again}.*"))


def _with_node(docs: DataFrame, text_column: str, k: int, name: str) -> DataFrame:
    """The documents with the digest of their set as one more column."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    place = docs.columns.index(text_column)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(place).cast(pa.string()), k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_digest(s) if len(s) else None for s in sets], pa.int64())], names=schema.names)

    return docs.mapInArrow(digest, schema)
