"""Stateful processors: many sessions and traces in one group, so that all rows of a micro-batch go through array work together.

Groups are hash buckets. In a bucket, states lie in blocks: a record of the state store has the states of all names of a block as one value of bytes,
with when each ends in event time. So a micro-batch makes two calls of the store a block, not two a name, and nothing is converted a number at a time
on the way between Python and the store. A timer for each bucket removes what has ended. State whose end the watermark has passed counts as gone, even before its timer ran.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import trace as core
from ..functions.folds import spaced
from ..functions.windows import trailing_average, trailing_slope, trailing_sums, whole_micros

_CORE = ("ema", "disagreement", "latched", "fire_count", "last_fire", "band_since", "last_t", "first_t")
_KEYED = "session_id string, key string"
_BODY = "body binary"


def milliseconds(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[ms]").astype(np.int64)


def run_starts(*columns: pd.Series) -> np.ndarray:
    """Where runs of equal values begin, with the end."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        values = c.to_numpy()
        new[1:] |= values[1:] != values[:-1]
    new[:1] = True
    return np.append(np.flatnonzero(new), len(new))


def heads_of(pdf: pd.DataFrame, starts: np.ndarray, *keys: str) -> tuple[list[int], list[tuple]]:
    """The block and the name of each run."""
    heads = pdf.iloc[starts[:-1]]
    return heads["block"].tolist(), list(zip(*(heads[k].tolist() for k in keys), strict=True))


def _packed(value) -> tuple[bytes]:
    """A record of the state store."""
    return (pickle.dumps(value, 5),)


def _unpacked(record):
    return None if record is None else pickle.loads(record[0])


class Blocks:
    """A map state of blocks of names: a record is kept under the first name of its block, and one index a bucket tells which that is. Each block is read
    once and written once between two calls of ``save``."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, key: str):
        self.state = handle.getMapState(name, key, _BODY)
        self.index = handle.getValueState(f"{name}_index", _BODY)
        self._reset()

    def _reset(self) -> None:
        self.firsts, self.read, self.changed = None, {}, set()

    def _first(self) -> dict[int, tuple]:
        """The names that blocks are kept under."""
        if self.firsts is None:
            self.firsts = _unpacked(self.index.get()) or {}
        return self.firsts

    def block(self, number: int) -> dict[tuple, tuple]:
        if number not in self.read:
            first = self._first().get(number)
            self.read[number] = _unpacked(self.state.getValue(first)) if first is not None else {}
        return self.read[number]

    def get(self, number: int, name: tuple, now: int) -> tuple | None:
        value = self.block(number).get(name)
        return None if value is None or value[-1] <= now else value[:-1]

    def put(self, number: int, name: tuple, value: tuple) -> None:
        self.block(number)[name] = value
        self.changed.add(number)

    def save(self) -> None:
        moved = False
        for number in self.changed:
            names, old = self.read[number], self._first().get(number)
            if old is None or old not in names:
                moved = True
                if old is not None:
                    self.state.removeKey(self.firsts.pop(number))
                if names:
                    self.firsts[number] = next(iter(names))
            if names:
                self.state.updateValue(self.firsts[number], _packed(names))
        if moved:
            self.index.update(_packed(self.firsts))
        self._reset()

    def end(self, now: int) -> list[int]:
        """Removes what has ended; when the others end."""
        left, numbers = [], {n: b for b, n in self._first().items()}
        for first, body in list(self.state.iterator()) if numbers else []:
            names = _unpacked(body)
            ends = [v[-1] for v in names.values()]
            if min(ends) <= now:
                number = numbers[tuple(first)]
                self.read[number] = {n: v for n, v in names.items() if v[-1] > now}
                self.changed.add(number)
            left += [e for e in ends if e > now]
        self.save()
        return left


class Ending(StatefulProcessor):
    """Named states that end."""

    def __init__(self, idle_s: float, key: str = _KEYED):
        self.idle_ms, self.key = int(idle_s * 1000), key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = Blocks(handle, "state", self.key)
        self.due = handle.getValueState("due", "ms long")

    def store(self, block: int, name: tuple, value: tuple, newest: int, now: int) -> int:
        ends = max(newest + self.idle_ms, now + 1)
        self.state.put(block, name, (*value, ends))
        return ends

    def watch(self, ends: list[int]) -> None:
        """Sets the bucket's timer, if it has none."""
        if ends and not self.due.exists():
            self.handle.registerTimer(min(ends))
            self.due.update((min(ends),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        left = self.state.end(now)
        self.due.clear()
        self.watch([max(min(left), now + 1)] if left else [])
        return iter([])

    def close(self) -> None:
        pass


def _trace_of(value: tuple | None) -> core.TraceState:
    if value is None:
        return core.TraceState()
    return core.TraceState(**dict(zip(_CORE, value, strict=False)), recent=_samples(value[8]))


def _samples(body: bytes) -> np.ndarray:
    """Times and values."""
    return np.frombuffer(body).reshape(2, -1)


def _values(state: core.TraceState) -> tuple:
    return (*(getattr(state, c) for c in _CORE), state.recent.tobytes())


def _advance(rows: pd.DataFrame, starts: np.ndarray, states: list[core.TraceState]) -> dict[str, np.ndarray]:
    t, value, alt, *spec = (rows[c].to_numpy(float) for c in ("t", "value", "alt", *core.SPEC))
    return core.run(starts, t, value, alt, np.stack([c[starts[:-1]] for c in spec], 1), states)


class Traces(Ending):
    """The trace recurrence: all traces of a bucket advance in one run."""

    def __init__(self, idle_s: float):
        super().__init__(idle_s)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        pdf = pd.concat(list(rows)).sort_values(["session_id", "key", "t", "tick"], kind="stable", ignore_index=True)
        starts = run_starts(pdf["session_id"], pdf["key"])
        blocks, names = heads_of(pdf, starts, "session_id", "key")
        states = [_trace_of(self.state.get(b, n, now)) for b, n in zip(blocks, names, strict=True)]
        found = _advance(pdf, starts, states)
        newest = np.maximum.reduceat(milliseconds(pdf["ts"]), starts[:-1]).tolist()
        self.watch([self.store(b, n, _values(s), m, now) for b, n, s, m in zip(blocks, names, states, newest, strict=True)])
        self.state.save()
        yield pd.DataFrame({**{c: pdf[c] for c in ("session_id", "key", "t", "tick", "value")}, **{c: found[c] for c in core.OUT if c != "slope"}})


class Quotas(Ending):
    """The first rows of each session, key and bin."""

    def __init__(self, idle_s: float, per_bin: int):
        super().__init__(idle_s, "session_id string, key string, bin long")
        self.per_bin = per_bin

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        pdf = pd.concat(list(rows)).sort_values(["session_id", "key", "bin", "t", "tick"], kind="stable", ignore_index=True)
        starts = run_starts(pdf["session_id"], pdf["key"], pdf["bin"])
        blocks, names = heads_of(pdf, starts, "session_id", "key", "bin")
        before = np.array([(self.state.get(b, n, now) or (0,))[0] for b, n in zip(blocks, names, strict=True)])
        sizes = np.diff(starts)
        taken = np.arange(len(pdf)) - np.repeat(starts[:-1], sizes) + np.repeat(before, sizes) < self.per_bin
        counts = np.minimum(before + sizes, self.per_bin).tolist()
        newest = np.maximum.reduceat(milliseconds(pdf["ts"]), starts[:-1]).tolist()
        self.watch([self.store(b, n, (c,), m, now) for b, n, c, m in zip(blocks, names, counts, newest, strict=True)])
        self.state.save()
        yield pdf.loc[taken, ["session_id", "key", "bin", "t", "tick", "raw"]]


class Sessions(Ending):
    """Wide states of whole sessions, a row for each tick: what the deck reads of each trace's latest sample, which keys fired at the tick, and the
    last question. ``measures``: for each key the measures to carry; ``fires``: keys of which edges are told."""

    def __init__(self, idle_s: float, measures: dict[str, list[str]], fires: list[str], columns: dict[str, str], slope_s: float, integral_s: float, question_s: float, most_chars: int):
        super().__init__(idle_s)
        self.measures, self.fires, self.columns = measures, fires, columns
        self.slope_us, self.integral_us = round(slope_s * 1e6), round(integral_s * 1e6)
        self.question_s, self.most_chars = question_s, most_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.asked = Blocks(handle, "asked", "session_id string")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.asked.end(timerValues.getCurrentWatermarkInMs())
        return super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        pdf = pd.concat(list(rows))
        said = pdf[pdf["tick"].isna()].sort_values(["session_id", "t"], kind="stable", ignore_index=True)
        pdf = pdf[pdf["tick"].notna()].sort_values(["session_id", "key", "t", "tick"], kind="stable", ignore_index=True)
        if len(pdf):
            pdf["tick"] = pdf["tick"].astype("int64")
            yield self._wide(pdf, said, now)
        for session, one in said.groupby("session_id"):
            newest = one.iloc[-1]
            self.asked.put(int(newest["block"]), (session,), (float(newest["t"]), newest["text"], int(milliseconds(one["ts"]).max()) + self.idle_ms))
        self.state.save()
        self.asked.save()

    def _wide(self, pdf: pd.DataFrame, said: pd.DataFrame, now: int) -> pd.DataFrame:
        starts = run_starts(pdf["session_id"], pdf["key"])
        blocks, names = heads_of(pdf, starts, "session_id", "key")
        at = {s: b for b, (s, _) in zip(blocks, names, strict=True)}
        loaded = {n: self.state.get(at[n[0]], n, now) for n in {*names, *((s, k) for s in at for k in self.measures)}}
        states = [_trace_of(loaded[n]) for n in names]
        found = _advance(pdf, starts, states)
        t, newest = pdf["t"].to_numpy(float), milliseconds(pdf["ts"])
        found["slope"], found["integral30"], found["fire"] = np.zeros(len(pdf)), np.zeros(len(pdf)), pdf["fire"].to_numpy(float)
        ends = []
        for name, state, i, j in zip(names, states, starts[:-1], starts[1:], strict=True):
            kept, old = self.measures.get(name[1], ()), loaded[name]
            past = np.array([[], []])
            if "slope" in kept or "integral30" in kept:
                before = _samples(old[9]) if old else past
                both = np.concatenate((before, [t[i:j], found["ema"][i:j]]), axis=1)
                us, own = whole_micros(both[0]), slice(before.shape[1], None)
                if "slope" in kept:
                    found["slope"][i:j] = trailing_slope(us, both[1], self.slope_us)[own]
                if "integral30" in kept:
                    found["integral30"][i:j] = trailing_average(both[0], us, both[1], self.integral_us)[own]
                past = both[:, us >= us[-1] - max(self.slope_us, self.integral_us if "integral30" in kept else 0)]
            last = tuple(float(found[c][j - 1]) for c in ("slope", "integral30", "in_band_for")) + (bool(found["warm"][j - 1]), float(found["fire"][j - 1]))
            ends.append(self.store(at[name[0]], name, (*_values(state), past.tobytes(), *last), int(newest[i:j].max()), now))
        self.watch(ends)
        edges = found["fired"] & ~pdf["silent"].fillna(False).to_numpy(bool)
        ticks = pdf.groupby(["session_id", "tick"], as_index=False).agg(t=("t", "max"), ts=("ts", "max")).sort_values(["session_id", "t", "tick"], kind="stable", ignore_index=True)
        by = ["session_id", "tick"]
        place = {"ema": 0, "slope": 10, "integral30": 11, "in_band_for": 12, "warm": 13, "fire": 14}
        for k in dict.fromkeys((*self.measures, *self.fires)):
            mine = (pdf["key"] == k).to_numpy()
            kept = list(self.measures.get(k, ()))
            rows = pd.DataFrame({"session_id": pdf["session_id"][mine], "tick": pdf["tick"][mine], **{m: found[m][mine].astype(float) for m in kept}, "fired": edges[mine]})
            rows = rows.groupby(by, as_index=False).agg({**dict.fromkeys(kept, "last"), "fired": "max"})
            merged = ticks[by].merge(rows, on=by, how="left")
            if k in self.fires:
                ticks[f"{self.columns[k]}__fired"] = merged["fired"].eq(True)
            for m in kept:
                held = merged.groupby("session_id")[m].ffill()
                old = {s: float(loaded[s, k][place[m]]) for s in at if loaded[s, k] is not None}
                held = held.fillna(ticks["session_id"].map(old).astype(float))
                ticks[f"{self.columns[k]}__{m}"] = held if m != "warm" else held.map(lambda x: None if math.isnan(x) else bool(x)).astype("object")
        ticks["last_question"] = self._questions(ticks, said, at, now)
        return ticks

    def _questions(self, ticks: pd.DataFrame, said: pd.DataFrame, at: dict[str, int], now: int) -> list[str]:
        """For each tick the newest question of the last seconds, cut if it is long."""
        out, new = [""] * len(ticks), dict(list(said.groupby("session_id")))
        old = {s: q for s, b in at.items() if (q := self.asked.get(b, (s,), now)) is not None}
        if not old and not new:
            return out
        starts = run_starts(ticks["session_id"])
        for session, i, j in zip(ticks["session_id"].iloc[starts[:-1]], starts[:-1], starts[1:], strict=True):
            times, texts = ([x] for x in old[session]) if session in old else ([], [])
            if session in new:
                times, texts = [*times, *new[session]["t"]], [*texts, *new[session]["text"]]
            if not times:
                continue
            own = ticks["t"].iloc[i:j].to_numpy(float)
            for n, (t, last) in enumerate(zip(own, np.searchsorted(np.array(times, float), own, "right") - 1, strict=True), i):
                text = texts[last] if last >= 0 and t - times[last] <= self.question_s else ""
                out[n] = text if len(text) <= self.most_chars else text[: self.most_chars - 3] + "..."
        return out


class Cooldowns(Ending):
    """Hits of each session and rule that are at least the rule's time after the one kept before."""

    def __init__(self, idle_s: float):
        super().__init__(idle_s, "session_id string, rule string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        pdf = pd.concat(list(rows)).sort_values(["session_id", "rule", "t", "tick"], kind="stable", ignore_index=True)
        starts, t, gaps = run_starts(pdf["session_id"], pdf["rule"]), pdf["t"].to_numpy(float), pdf["refractory_s"].to_numpy(float)
        newest, keep, ends = milliseconds(pdf["ts"]), np.zeros(len(pdf), bool), []
        for block, name, i, j in zip(*heads_of(pdf, starts, "session_id", "rule"), starts[:-1], starts[1:], strict=True):
            (last,) = self.state.get(block, name, now) or (math.nan,)
            keep[i:j] = spaced(t[i:j], gaps[i], last)
            kept = np.flatnonzero(keep[i:j])
            ends.append(self.store(block, name, (float(t[i + kept[-1]]) if len(kept) else last,), int(newest[i:j].max()), now))
        self.watch(ends)
        self.state.save()
        yield pdf.loc[keep].drop(columns="block")


class Meter(Ending):
    """Exact rates over a trailing window: calls wait in their block until the watermark has passed them, then each is told with the sums of its
    window, and what no window reaches any more goes. All sessions of a bucket go through one window search. A block's record is a list of pieces, one for
    each micro-batch, so a new one is put beside the others as they are."""

    _CALL = ("session_id", "t", "tick", "tokens", "ms", "told")

    def __init__(self, idle_s: float, window_s: float):
        super().__init__(idle_s)
        self.window_us = round(window_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("state", "block int", _BODY)
        self.due = handle.getValueState("due", "ms long")

    def _pieces(self, calls: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
        """Each block of calls that are sorted by it, and its piece."""
        starts, columns = run_starts(calls["block"]), [calls[c].to_numpy() for c in self._CALL]
        for block, i, j in zip(calls["block"].iloc[starts[:-1]].tolist(), starts[:-1], starts[1:], strict=True):
            yield block, pickle.dumps([c[i:j] for c in columns], 5)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        pdf = pdf.assign(ms=milliseconds(pdf["ts"]), told=False).sort_values("block", kind="stable")
        for block, piece in self._pieces(pdf):
            self.state.updateValue((block,), _packed([*(_unpacked(self.state.getValue((block,))) or ()), piece]))
        self.watch([max(int(pdf["ms"].min()), timerValues.getCurrentWatermarkInMs()) + 1])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        pieces = [(block, pickle.loads(piece)) for (block,), record in self.state.iterator() for piece in _unpacked(record)]
        self.due.clear()
        if not pieces:
            return iter(out)
        calls = pd.DataFrame({n: np.concatenate([columns[i] for _, columns in pieces]) for i, n in enumerate(self._CALL)})
        calls["block"] = np.repeat([b for b, _ in pieces], [len(columns[0]) for _, columns in pieces])
        calls["session"] = pd.factorize(calls["session_id"], sort=True)[0]
        # those that are told stay ahead: new ones are later than the watermark that let these go
        calls["new"] = ~calls["told"]
        calls = calls.iloc[np.lexsort([calls[c].to_numpy() for c in ("ms", "tokens", "tick", "t", "new", "session")])].reset_index(drop=True)
        passed = calls[calls["ms"] < now].reset_index(drop=True)
        kept = [calls[calls["ms"] >= now]]
        if len(passed):
            starts, t = run_starts(passed["session"]), passed["t"].to_numpy(float)
            us = whole_micros(t)
            sums, counts, oldest = trailing_sums(t, passed["tokens"].to_numpy(float), self.window_us, starts)
            found = passed.assign(tokens=sums, calls=counts, oldest=oldest)
            out.append(found.loc[passed["new"], ["session_id", "tick", "t", "tokens", "calls", "oldest"]])
            reached = us >= np.repeat(us[starts[1:] - 1], np.diff(starts)) - self.window_us
            kept.insert(0, passed[reached].assign(told=True))
        kept = pd.concat(kept)
        ends = kept.groupby("session")["ms"].transform("max") + self.idle_ms
        kept = kept.assign(ends=ends)[ends > now].sort_values("block", kind="stable")
        left = {block: piece for block, piece in self._pieces(kept)}
        for block, piece in left.items():
            self.state.updateValue((block,), _packed([piece]))
        for block in {b for b, _ in pieces}.difference(left):
            self.state.removeKey((block,))
        waiting = kept.loc[~kept["told"], "ms"]
        self.watch([max(int(x), now + 1) for x in ([kept["ends"].min(), *([waiting.min() + 1] if len(waiting) else [])] if len(kept) else [])])
        return iter(out)
