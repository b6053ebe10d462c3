import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.llm import katz as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


class Plain:
    """The model by its definition, one n-gram at a time; shares no code with the module."""

    def __init__(self, texts, order):
        self.order = order
        self.all = [Counter() for _ in range(order)]
        for t in texts:
            w = tokens(t)
            for n in range(1, order + 1):
                self.all[n - 1].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        self.discounts = [self.good_turing(Counter(x.values())) for x in self.all]
        self.followers = {}
        for n in range(1, order):
            for k in self.all[n]:
                self.followers.setdefault(k[:-1], []).append(k[-1])
        self.known = {}
        self.tokens = sum(self.all[0].values())
        self.used = sum(self.d(0, c) for c in self.all[0].values())

    @staticmethod
    def good_turing(of):
        """d(1) to d(5) by Katz, exactly; (r - 1/2) / r where the estimate is no discount."""
        out = {}
        lost = Fraction(6 * of[6], of[1]) if of[1] else Fraction(1)
        for r in range(1, 6):
            good = None
            if of[r] and lost < 1:
                star = Fraction((r + 1) * of[r + 1], of[r])
                good = (star / r - lost) / (1 - lost)
            out[r] = good if good is not None and 0 < good < 1 else Fraction(2 * r - 1, 2 * r)
        return out

    def d(self, n, c):
        return float(self.discounts[n][c] * c) if c < 6 else float(c)

    def p(self, w, h):
        if not h:
            c = self.all[0][(w,)]
            if not self.tokens:
                return 1.0
            whole = self.tokens if self.used < self.tokens - 1e-9 else self.tokens + 1
            return self.d(0, c) / whole if c else 1 - self.used / whole
        scale, backoff = self.weight(h)
        c = self.all[len(h)][(*h, w)]
        if c:
            return scale * self.d(len(h), c) / self.all[len(h) - 1][h]
        return backoff * self.p(w, h[1:])

    def weight(self, h):
        if h not in self.followers:
            return 1.0, 1.0
        if h not in self.known:
            follow, count = self.followers[h], self.all[len(h) - 1][h]
            high = sum(self.d(len(h), self.all[len(h)][(*h, w)]) / count for w in follow)
            low = sum(self.p(w, h[1:]) for w in follow)
            scale = 1.0 if high < 1 - 1e-9 else count / (count + 1)
            self.known[h] = scale, (1 - scale * high) / (1 - low)
        return self.known[h]

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.p(x, tuple(w[max(0, i - self.order + 1) : i]))) for i, x in enumerate(w))


def cases():
    rnd = random.Random(6)
    words = [f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(6000)]
    texts = [None, "", "  ", "one", "One ONE one", "a\vb\x85c"]
    at = 0
    while at < len(words) - 60:
        n = rnd.randrange(1, 60)
        texts.append(" ".join(words[at : at + n]))
        at += n
    return texts + texts[20:26]


@pytest.mark.parametrize(("order", "block", "history"), [(2, 400, 4_000_000), (3, 1500, 7), (4, 3000, 50)])
def test_scores_against_the_definition(spark, monkeypatch, order, block, history):
    monkeypatch.setattr(K, "BLOCK_BYTES", block)
    monkeypatch.setattr(K, "HISTORY_ROWS", history)
    rows = [(i, t, 0.0) for i, t in enumerate(cases())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows}
    plain = Plain([t for i, t, _ in rows if not held[i]], order)
    whole, kinds = plain.tokens, len(plain.all[0])
    got = K.katz_scores(docs, K.train_share(), order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        w = tokens(rows[r.doc_id][1])
        known = [plain.all[0][(x,)] for x in w]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c > 0 for c in known), whole)
        assert r.base_score == pytest.approx(sum(math.log10((c + 1) / (whole + kinds + 1)) for c in known), abs=1e-9)
        assert r.score == pytest.approx(plain.score(rows[r.doc_id][1]), abs=1e-8)


def test_probabilities_sum_to_one():
    for texts in (cases(), ["a b a b a b"] * 9, ["x"]):
        plain = Plain(texts, 3)
        vocabulary = [k[0] for k in plain.all[0]] + ["never seen"]
        histories = [(), ("never seen",), *list(plain.followers)[:60]]
        for h in histories:
            assert sum(plain.p(w, h) for w in vocabulary) == pytest.approx(1, abs=1e-9)


def test_better_than_the_base_on_held_out_texts(spark):
    rnd = random.Random(1)
    nouns = [f"n{i}" for i in range(50)]
    texts = [" ".join(f"the {rnd.choice(nouns)} of" for _ in range(20)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = K.katz_scores(docs, K.train_share()).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.9 * got[1] and got[0] > got[1] * 0.75


def test_discounts_are_the_exact_estimates():
    of = {1: 1000, 2: 420, 3: 230, 4: 160, 5: 110, 6: 70}
    exact = Plain.good_turing(Counter(of))
    got = K.Level(of_count=[0, *of.values()]).discounts()
    assert got[1:].tolist() == pytest.approx([float(exact[r]) for r in range(1, 6)], abs=1e-12)
    # the estimates free n(1) occurrences, as Good and Turing have it
    assert sum((1 - exact[r]) * r * of[r] for r in range(1, 6)) == of[1]


def test_packing():
    arrays = [np.array([3, 300, 2**40]), np.zeros(0, np.int64), np.array([1, 2**63 + 5], np.uint64), np.array([0.5, -1]), np.array([7, 0])]
    back = K.unpacked(K.packed(*arrays))
    assert all(a.tolist() == b.tolist() for a, b in zip(arrays, back)) and back[0].dtype == np.int64
    keys = np.array([5, 2**39 + 3], np.uint64)
    assert np.cumsum(K._steps(keys)).tolist() == keys.tolist() and len(K._steps(keys[:0])) == 0
    keys, sizes = np.array([5, 9, 2**39, 1, 7]), np.array([0, 3, 0, 1, 1, 0])
    assert K._of_within(K._within(keys, sizes), sizes).tolist() == keys.tolist()


def test_tables_by_order(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "a b d")], "doc_id long, text string")
    model = K.KatzModel(docs, F.lit(True), "doc_id", "text", 3, keep_keys=True)
    for n, once in enumerate((2, 5, 6), 1):
        model.count()
        (row,) = [K.unpacked(bytes(r.counts)) for r in spark.read.parquet(f"{model.folder}/order={n}").filter("block = -2").collect()]
        assert model.levels[n - 1].of_count[1] == once and (n > 1 or sorted(row[1].tolist()) == [1, 1, 2, 3, 3])
    model.drop()


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert K.katz_scores(docs, F.lit(False)).select("n_tokens", "n_known", "score").orderBy("n_tokens").collect() == [(1, 0, 0.0), (3, 0, 0.0)]
    assert K.katz_scores(docs.limit(0), F.lit(True)).count() == 0


def test_sums_go_only_where_a_block_backs_off(spark):
    texts = [(1, "a b a b c"), (2, "a b d"), (3, "b c b c")]
    docs = spark.createDataFrame([*texts, (4, "b a a d x b")], "doc_id long, text string")
    told = []
    for train in (F.lit(True), F.col("doc_id") < 4):
        model = K.KatzModel(docs, train, "doc_id", "text", 3)
        for _ in range(3):
            model.count()
        rows = spark.read.parquet(model.folder).filter("block >= 0 AND order > 1").select("sums").collect()
        parts = [K.unpacked(bytes(r.sums)) for r in rows]
        assert all(len(p) == 2 + 2 * K._K and len(p[1]) == (p[0] & 1).sum() <= len(p[0]) for p in parts)
        told.append(sum(len(p[1]) for p in parts))
        scores = {r.doc_id: r.score for r in model.scores("doc_id").collect()}
        model.drop()
        plain = Plain([t for _, t in texts] + ["b a a d x b"] * (not told[1:]), 3)
        assert scores[4] == pytest.approx(plain.score("b a a d x b"), abs=1e-9)
    # all in training: every n-gram was seen, so nothing backs off
    assert told[0] == 0 < told[1]
