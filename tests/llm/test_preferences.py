import random

import duckdb
import pandas as pd

from signalmill.llm import preferences as P


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def render(turns):
        out, spans = "", []
        for role, text in turns:
            head = f"<|{role or 'unknown'}|>\n"
            end = f"{text or ''}<|end|>\n"
            if role == "assistant":
                spans.append(f"{len(out) + len(head)}:{len(out) + len(head) + len(end)}")
            out += head + end
        return out, ",".join(spans)

    (a, am), (b, bm) = render(chosen[n:]), render(rejected[n:])
    return (n, render(chosen[:n])[0], a, b, am, bm)


def test_pairs_against_brute_force(spark):
    rnd = random.Random(1)
    turn = lambda: (rnd.choice(("user", "assistant", "system", None)), rnd.choice(("a", "é🙂", "", None, "long " * 50)))
    rows = [(0, [], []), (1, None, [("user", "x")]), (2, [("user", None)], [("user", "")])]
    for i in range(3, 150):
        base = [turn() for _ in range(rnd.randrange(6))]
        rows.append((i, base + [turn() for _ in range(rnd.randrange(3))], base + [turn() for _ in range(rnd.randrange(3))]))
    pairs = spark.createDataFrame(rows, f"pair_id long, chosen {P.TURN}, rejected {P.TURN}")
    got = {r[0]: tuple(r)[1:] for r in P.format_preferences(pairs).collect()}
    assert got == {i: brute(c or [], r or []) for i, c, r in rows}


def test_query_against_sql_on_odd_tables(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(("user", "assistant", None)), rnd.choice((None, "", "hi", "same", "é"))) for c in range(60) for t in range(rnd.randrange(1, 7))]
    rows += rows[:3] + [(99, 0, "user", "only")]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = sorted(con.execute(P.ORACLE).fetchall())
    pairs = P.last_reply_pairs(P.conversations_as_arrays(turns))
    assert sorted(map(tuple, P.format_preferences(pairs).collect())) == want
    assert P.format_preferences(P.last_reply_pairs(P.conversations_as_arrays(turns.limit(0)))).count() == 0
