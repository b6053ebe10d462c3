"""Repair of conversations by weighted finite-state composition.

Three machines are composed. The input acceptor is the chain of a conversation's rows, each with its role's initial and its fault. The edit
transducer keeps, reroles or deletes a row, or inserts one, each at a cost and with an initial as label. The grammar acceptor reads the
initials of the roles that are left. A path through the composition is a repair; its weight is the pair of its cost and its label string,
compared in this order, so the cheapest repair is single: ties go to the least string of labels.

The composition has no cycle, since a run of inserts that comes back to a state of the grammar costs more than none: a run has at most as
many inserts as the grammar has states, less one. So weights go from the end to the start, in topological order. From the end they are
right for strings of any lengths, as a label before two strings keeps their order. Strings aren't stored: of two weights at one place only
the order of their strings counts, so a rank stands for each, and a layer of weights is kept as differences of cost with ranks. Few such layers
exist, so each is composed when a conversation first needs it, and after that a row takes one look-up.

Defined results: rows of a conversation stand by turn, null first, then by role and a hash of the text; copies stand together. Null role or text is an empty
string. A row whose role's initial the grammar doesn't take can only be reroled or deleted. A null conv_id is a conversation too. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import partitions, text_or_empty

#: White space is space and tab to carriage return.
_SOLID, _CLOSED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


@dataclass(frozen=True)
class Edits:
    """The edit transducer: costs of edits, roles to insert or to change to, and faults that forbid all but deletion."""

    keep: int = 0
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    kept_truncated: int = 1
    roles: tuple[str, ...] = ("user", "assistant")
    must_go: tuple[str, ...] = ("blank", "duplicate")

    def arcs(self, initial: str, fault: str | None) -> Iterator[tuple[str, int, str | None]]:
        """Label, cost and the initial that is left (None if the row goes), for a row."""
        if fault not in self.must_go:
            more = self.kept_truncated if fault == "truncated" else 0
            yield "K", self.keep + more, initial
            for role in self.roles:
                yield "R", self.rerole + more, role[0]
        yield "D", self.delete, None


@dataclass(frozen=True)
class Grammar:
    """An acceptor of initials: for each state the states that initials lead to. The default takes ``(s?(ua)+)?``."""

    next: dict[str, dict[str, str]] = field(default_factory=lambda: {"empty": {"s": "system", "u": "user"}, "system": {"u": "user"}, "user": {"a": "assistant"}, "assistant": {"u": "user"}})
    start: str = "empty"
    accept: tuple[str, ...] = ("empty", "assistant")


class Composition:
    """The composed machine, layer by layer. A layer has, for each state of the grammar, the least cost from there to the end (less the
    layer's least) and the rank of that path's string, or None if no path leads to the end."""

    def __init__(self, edits: Edits, grammar: Grammar):
        self.edits, self.states = edits, list(grammar.next)
        at = {s: i for i, s in enumerate(self.states)}
        self.next = [{c: at[to] for c, to in grammar.next[s].items()} for s in self.states]
        self.start, self.accept = at[grammar.start], {at[s] for s in grammar.accept}
        self.symbols: dict[tuple[str, str | None], int] = {}
        self.layers: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int, list]] = {}
        self.end = self._number(self._weights(None, []))

    def symbol(self, initial: str, fault: str | None) -> int:
        return self.symbols.setdefault((initial, fault), len(self.symbols))

    def _weights(self, row: tuple[str, str | None] | None, after) -> list:
        """Cost, rank and moves from each state, at a row (None: past the last) with the layer after it. A move is a label, the initial left and the
        next state; inserts come before the row's own edit."""
        level = None
        for _ in self.states:
            options = [self._options(state, row, after, level) for state in range(len(self.states))]
            best = [min(o, key=lambda x: x[:3], default=None) for o in options]
            ranks = {key: i for i, key in enumerate(sorted({b[1:3] for b in best if b}))}
            level = [b and (b[0], ranks[b[1:3]], b[3]) for b in best]
        return level

    def _options(self, state: int, row, after, deeper) -> list[tuple[int, str, int, tuple]]:
        """Cost, first label, rank of the string behind it, and moves. deeper: weights with one more insert before this place."""
        found = []
        if row is None:
            if state in self.accept:
                found.append((0, "", 0, ()))
        else:
            for label, cost, left in self.edits.arcs(*row):
                to = state if left is None else self.next[state].get(left)
                if to is not None and after[to]:
                    found.append((cost + after[to][0], label, after[to][1], ((label, left, to),)))
        for role in self.edits.roles if deeper else ():
            to = self.next[state].get(role[0])
            if to is not None and deeper[to]:
                cost, rank, moves = deeper[to]
                found.append((self.edits.insert + cost, "I", rank, (("I", role[0], to), *moves)))
        return found

    def _number(self, weights: list) -> tuple[int, int, list]:
        """The layer's number, its least cost, and the moves from each state."""
        least = min((w[0] for w in weights if w), default=0)
        layer = tuple(w and (w[0] - least, w[1]) for w in weights)
        if layer not in self.numbers:
            self.numbers[layer] = len(self.layers)
            self.layers.append(layer)
        return self.numbers[layer], least, [w and w[2] for w in weights]

    def before(self, symbol: int, layer: int) -> tuple[int, int, list]:
        """The layer before a row, from the one after it; composed when first asked for."""
        step = self.steps.get((symbol, layer))
        if step is None:
            step = self.steps[symbol, layer] = self._number(self._weights(list(self.symbols)[symbol], self.layers[layer]))
        return step

    def repair(self, symbols: Iterable[int]) -> Iterator[tuple]:
        """For each row the moves up to its own edit, then those past the last row. Takes 8 bytes a row."""
        symbols = array("i", symbols)
        layers = array("i", bytes(4 * (len(symbols) + 1)))
        layers[-1] = self.end[0]
        for i in range(len(symbols) - 1, -1, -1):
            layers[i] = self.before(symbols[i], layers[i + 1])[0]
        state = self.start
        for i, symbol in enumerate(symbols):
            moves = self.steps[symbol, layers[i + 1]][2][state]
            if moves is None:
                raise ValueError("no edits lead to a conversation that the grammar takes")
            state = moves[-1][2]
            yield moves
        if self.end[2][state] is None:
            raise ValueError("no edits lead to a conversation that the grammar takes")
        yield self.end[2][state]


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and each row's first fault: blank, duplicate (an earlier row of the conversation has its role and text),
    truncated, or null. One shuffle, by conversation, which the window for duplicates then uses."""
    kept = rows.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    marked = kept.repartition(partitions(rows), "conv_id").withColumn("nth", F.row_number().over(same))
    fault = F.when(~F.col("text").rlike(_SOLID), "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("text").rlike(_CLOSED), "truncated")
    return marked.withColumn("fault", fault)


_OUT = "edit string, cost long, fault string, turn long, old_role string, role string, text string"


def repair(rows: DataFrame, edits: Edits | None = None, grammar: Grammar | None = None) -> DataFrame:
    """All rows of the cheapest repairs, with inserted ones: conv_id, edit (K, R, D or I), its cost, the row's fault, turn, old_role (null for
    inserted ones), role (of what is left), text.

    The rows of a conversation come out together and in order. They pass a task twice, first without text to find the repair, then with it, so
    a conversation of any length takes 8 bytes a row and never stands in memory with its texts.
    """
    edits, grammar = edits or Edits(), grammar or Grammar()
    # both passes have the same order, so the text is there as a hash too
    twice = with_faults(rows).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "fault", F.xxhash64("text").alias("hash"), F.explode(F.array(F.lit(False), F.lit(True))).alias("second"))
    twice = twice.withColumn("text", F.when(F.col("second"), F.col("text")))
    ordered = twice.sortWithinPartitions("conv_id", "second", F.asc_nulls_first("turn"), "role", "hash").select("conv_id", "second", "turn", "role", "fault", "text")
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(_OUT).fields])
    cost_of = {"K": edits.keep, "R": edits.rerole, "D": edits.delete, "I": edits.insert}
    role_of = {r[0]: r for r in edits.roles}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Composition(edits, grammar)
        now, symbols, moves = object(), array("i"), None

        def inserted(steps):
            return [("I", edits.insert, None, None, None, role_of[left], "") for _, left, _ in steps]

        for batch in batches:
            out: list[tuple] = []
            for conv, second, turn, role, fault, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not second:
                    if conv != now:
                        if moves is not None:
                            out += [(now, *r) for r in inserted(next(moves))]
                        now, symbols, moves = conv, array("i"), None
                    symbols.append(machine.symbol(role[:1], fault))
                    continue
                if moves is None:
                    moves = machine.repair(symbols)
                *more, (label, left, _) = next(moves)
                out += [(conv, *r) for r in inserted(more)]
                cost = cost_of[label] + (edits.kept_truncated if fault == "truncated" and label != "D" else 0)
                out.append((conv, label, cost, fault, turn, role, role_of[left] if label == "R" else role, text))
            if out:
                yield _batch(out, schema)
        if moves is not None and (last := [(now, *r) for r in inserted(next(moves))]):
            yield _batch(last, schema)

    return ordered.mapInArrow(walk, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(f.dataType.simpleString())) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)


def repaired(rows: DataFrame) -> DataFrame:
    """The conversations after their repair: conv_id, place (from 0), role and text, from what ``repair`` returns."""
    left = rows.filter("edit <> 'D'").select("conv_id", "role", "text", F.monotonically_increasing_id().alias("place"))
    return left.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("place")) - 1).select("conv_id", "place", "role", "text")


def digests(rows: DataFrame) -> DataFrame:
    """A row for each conversation of what ``repair`` returns, in its order: gaps in turns, faults, illegal pairs of initials before the repair,
    the cost, the string of edits, and the sha256 of the repaired ``role:text`` lines. A task keeps one conversation's string and sums."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(n, T.LongType()) for n in names), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    legal = {("s", "u"), ("u", "a"), ("a", "u")}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun = None, False
        for batch in batches:
            out = []
            for conv, edit, cost, fault, turn, old, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != now:
                    if begun:
                        out.append(closed(now, state))
                    now, begun = conv, True
                    state = {"low": None, "high": None, "turns": 0, "faults": dict.fromkeys(names[1:4], 0), "illegal": 0, "cost": 0, "audit": [], "before": None, "hash": hashlib.sha256(), "lines": 0}
                state["cost"] += cost
                state["audit"].append(edit)
                if fault:
                    state["faults"][fault] += 1
                if edit != "I":
                    if state["before"] is not None and (state["before"], old[:1]) not in legal:
                        state["illegal"] += 1
                    state["before"] = old[:1]
                    if turn is not None and turn != state["high"]:
                        state["turns"] += 1
                        state["high"] = turn
                        state["low"] = turn if state["low"] is None else state["low"]
                if edit != "D":
                    state["hash"].update((b"\n" if state["lines"] else b"") + f"{role}:{text}".encode())
                    state["lines"] += 1
            if out:
                yield _batch(out, schema)
        if begun:
            yield _batch([closed(now, state)], schema)

    def closed(conv, state) -> tuple:
        gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
        return conv, gaps, *state["faults"].values(), state["illegal"], state["cost"], "".join(state["audit"]), state["hash"].hexdigest()

    return rows.mapInArrow(fold, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations, of which some get a fault by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes its sentence
    ends, 3 repeats it, 4 makes its role user. Nulls in the crc, role and text count as one space."""
    or_space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(or_space["conv_id"], F.lit(":"), or_space["turn"]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", or_space["role"].alias("role"), or_space["text"].alias("text"), kind.alias("kind")).filter("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Digests of the repairs of damaged conversations, one for each conv_id of the table; zeros and empty strings where no row is left."""
    found = digests(repair(damaged(conversations)))
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(found.withColumnRenamed("conv_id", "found_id"), F.col("conv_id").eqNullSafe(F.col("found_id")), "left").drop("found_id")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.select("conv_id", *(F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in found.columns[1:]))
