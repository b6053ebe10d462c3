"""Repairs against a search of all edit sequences, and the digests against a plain reading of their definition."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from signalmill.llm import conversation_repair as R

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def by_search(rows):
    """The least (cost, labels) and its (role, text) lines over all edits, with up to two inserts before each row and at the end. Rows that the
    grammar can't take as a beginning are given up; what follows depends on the last initial only."""

    @functools.cache
    def rest(i, last, run):
        found = []

        def add(cost, label, line, i, run):
            now = last if line is None else line[0][:1]
            if line is not None and (last, now) not in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                return
            tail = rest(i, now, run)
            if tail:
                found.append((cost + tail[0], label + tail[1], ([] if line is None else [line]) + tail[2]))

        if i == len(rows):
            found += [(0, "", [])] if last in ("", "a") else []
        else:
            role, text, fault = rows[i]
            add(3, "D", None, i + 1, 0)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                add(0 + more, "K", (role or "?", text), i + 1, 0)
                for new in ("user", "assistant"):
                    add(2 + more, "R", (new, text), i + 1, 0)
        if run < 2:
            for new in ("user", "assistant"):
                add(2, "I", (new, ""), i, run + 1)
        return min(found, key=lambda x: x[:2], default=None)

    return rest(0, "", 0)


FAULTS = (None, None, None, "blank", "duplicate", "truncated")
machine = R.Composition(R.Edits(), R.Grammar())


def by_composition(rows):
    moves = list(machine.repair([machine.symbol(role[:1], fault) for role, _, fault in rows]))
    labels = [label for step in moves for label, _, _ in step]
    left = "".join(c for step in moves for _, c, _ in step if c)
    return labels, left


@pytest.mark.parametrize("seed", range(40))
def test_composition_finds_what_a_search_of_all_edits_finds(seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(("user", "assistant", "system", "user", "assistant", "tool", "")), f"t{i}", rnd.choice(FAULTS)) for i in range(rnd.randint(0, 5))]
    cost, labels, lines = by_search(rows)
    found, left = by_composition(rows)
    assert "".join(found) == labels and left == "".join(r[:1] for r, _ in lines)


def test_layers_repeat_and_long_conversations_are_cheap():
    fresh = R.Composition(R.Edits(), R.Grammar())
    rnd = random.Random(1)
    symbols = [fresh.symbol(rnd.choice("usat"), rnd.choice(FAULTS)) for _ in range(200_000)]
    assert sum(1 for _ in fresh.repair(symbols)) == 200_001
    assert len(fresh.layers) < 500
    assert list(fresh.repair([])) == [()]


def test_other_costs_and_grammars():
    strict = R.Composition(R.Edits(roles=("user",)), R.Grammar(next={"a": {"x": "b"}, "b": {}}, start="a", accept=("b",)))
    with pytest.raises(ValueError):
        list(strict.repair([strict.symbol("u", None)]))
    pair = R.Composition(R.Edits(delete=9, insert=1, roles=("user", "assistant")), R.Grammar())
    found = [label for step in pair.repair([pair.symbol("a", None)]) for label, _, _ in step]
    assert found == ["I", "K"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def digest(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    turns = {t for _, t, _, _ in rows if t is not None}
    seen, marked = set(), []
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role, text, fault))
    cost, labels, lines = by_search(marked)
    count = lambda f: sum(m[2] == f for m in marked)
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    said = "\n".join(f"{r}:{t}" for r, t in lines)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, labels, hashlib.sha256(said.encode()).hexdigest())


def conversations():
    rnd = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "well", " \t", "", "Hé. \n", "a.b", None, "x" * 3000 + "."]
    rows = []
    for conv in range(150):
        roles = ["system"] * (conv % 3 == 0) + ["user", "assistant"] * 3
        for turn, role in enumerate(roles[: rnd.randint(1, 5)]):
            rows.append((conv, turn * rnd.choice((1, 1, 2)), rnd.choice((role, role, role, "user", "tool", None)), rnd.choice(texts)))
    # distinct turns within a conversation, but for null ones
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hm."), (900, None, "user", "Late."), (900, None, "user", "Late."), (900, 3, "assistant", "So.")]
    gone = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Away.")]
    rnd.shuffle(rows)
    return rows, gone


def test_digests_match_the_definition(spark):
    rows, gone = conversations()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, second int, fault string").repartition(5)
    got = R.repair_digests(table)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r[1:]) for r in got.collect()}
    assert got.keys() == {r[0] for r in rows}
    left = damage(rows)
    for conv in got:
        assert got[conv] == digest([r for r in left if r[0] == conv]), conv
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert R.repair_digests(table.limit(0)).collect() == []


def test_repaired_conversations_have_the_grammar_and_a_long_one_passes(spark):
    rnd = random.Random(9)
    long = [(1, i, rnd.choice(("user", "assistant", "user", "assistant", "system")), f"line {i}" + rnd.choice((".", ""))) for i in range(30_000)]
    rows = spark.createDataFrame([*long, (2, 0, "assistant", "Hi."), (3, 0, "user", "Hi."), (3, 1, "user", "Hi."), (4, 0, None, None)], "conv_id long, turn long, role string, text string").repartition(4)
    fixed = R.repair(rows).cache()
    texts = {}
    for r in R.repaired(fixed).orderBy("conv_id", "place").collect():
        texts.setdefault(r.conv_id, []).append((r.role, r.text))
    assert all(GRAMMAR.match("".join(role[0] for role, _ in lines)) for lines in texts.values())
    assert texts[2] == [("user", ""), ("assistant", "Hi.")] and texts[3] == [("user", "Hi."), ("assistant", "")] and 4 not in texts
    assert len(texts[1]) > 25_000
    assert fixed.filter("conv_id = 1 AND edit <> 'I'").count() == 30_000
