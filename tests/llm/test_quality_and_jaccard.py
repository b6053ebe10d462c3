import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import zstandard

from signalmill.llm import jaccard_join as J
from signalmill.llm import quality_rules as Q
from signalmill.llm._text import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(seed, n, words=400):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


ODD = [None, "", " \n\t ", "é ñ x y", "a", "A b C", "x" * 50_000, "a\x00b \x85c"]


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    from signalmill.llm._text import buffers

    data, offsets = buffers(pa.array([*ODD, "One one\vtwo\ftwo ONE"]))
    hashes, rows = word_hashes(data, offsets)
    seen = {}
    for text, a, b in zip([*ODD, "One one\vtwo\ftwo ONE"], rows[:-1], rows[1:]):
        words = WORD.findall(low(text))
        assert len(words) == b - a
        for w, h in zip(words, hashes[a:b]):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def between(n, ratio, band):
    """Limits by straight lines between the given points."""
    at, lows, highs = band
    x = math.log2(n)
    k = next((i for i, a in enumerate(at) if a > x), len(at))
    if k == 0:
        return lows[0] <= ratio <= highs[0]
    if k == len(at):
        rise = (highs[-1] - highs[-2]) / (at[-1] - at[-2]) if len(at) > 1 else 0
        return lows[-1] <= ratio <= highs[-1] + rise * (x - at[-1])
    part = (x - at[k - 1]) / (at[k] - at[k - 1])
    low, high = (v[k - 1] + part * (v[k] - v[k - 1]) for v in (lows, highs))
    return low <= ratio <= high


def brute_quality(text, rules=Q.QualityRules()):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    raw, pack = text.encode(), zstandard.ZstdCompressor(level=3).compress
    ratio = len(raw) / len(pack(raw)) if raw else 0.0
    chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    band = rules.bands[sum(b > 127 for b in raw) > 0.01 * len(raw)]
    bad = sum(not between(len(c), len(c) / len(pack(c)), band) for c in chunks)
    kept = not failed and between(len(raw), ratio, band) and bad <= 0.5 * len(chunks)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed, kept)


def quality_cases():
    noise = "".join(random.Random(5).choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(9000))
    noise = " ".join(noise[i : i + 60] for i in range(0, 9000, 60))
    return [*ODD, prose(1, 300), prose(1, 300), prose(2, 60, 3), "same words here " * 200, "line one two\n" * 40 + prose(3, 100), noise, prose(4, 30_000, 5000)]


def test_quality_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(quality_cases())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {r.doc_id: tuple(r)[1:8] for r in Q.quality_features(docs).collect()}
    assert got == {i: brute_quality(t) for i, t, _ in rows}
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if v[-1]}
    assert {8, 9} <= {r.doc_id for r in kept.collect()}
    assert Q.quality_features(docs.limit(0)).count() == 0


def written(seed, n, letters="etaoinshrdlucmfw", accents=0.0):
    """Text of syllables, which compresses as prose does."""
    rnd = random.Random(seed)
    parts = [a + b for a in letters for b in letters[:6]]
    words = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) + ("é" if rnd.random() < accents else "") for _ in range(n)]
    return " ".join(words)


def test_fitted_bands_reject_noise_and_repetition_and_keep_prose(spark):
    rnd = random.Random(8)
    good = [written(i, rnd.choice((120, 400, 1500)), accents=(i % 2) * 0.5) for i in range(600)]
    noise = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    base64 = [" ".join("".join(rnd.choice(noise) for _ in range(40)) for _ in range(n)) for n in (60, 200, 400)]
    hexes = [" ".join("".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(n)) for n in (60, 200, 400)]
    # no word window stands twice, so the base rule passes it
    cycle = [" ".join(f"item{a}of{b}" for a in range(30) for b in range(30))]
    texts = [*good, *base64, *hexes, *cycle]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, other string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 600)) for i in [*range(0, 600, 2), *range(600, 604)]] + [(None, 1), (99_999, 1), (0, 1)], "doc_id long, quality int")
    rules = Q.fit_bands(docs, labels)
    rows = {r.doc_id: r for r in Q.quality_features(docs, rules=rules).collect()}
    assert not any(rows[i].base_failed for i in range(len(texts)))
    assert sum(rows[i].kept for i in range(600)) >= 0.97 * 600
    assert not any(rows[i].kept for i in range(600, len(texts)))
    assert {i: r.kept for i, r in rows.items()} == {i: brute_quality(t, rules)[-1] for i, t in enumerate(texts)}
    assert Q.fit_bands(docs.repartition(1), labels).bands == rules.bands
    # only ASCII texts are labelled: the others are judged by the base rule alone
    assert rules.bands[0] != Q.OPEN and rules.bands[1] == Q.OPEN and all(rows[i].kept for i in range(1, 600, 2))
    both = spark.createDataFrame([(i, 1) for i in range(600)], "doc_id long, quality int")
    judged = Q.fit_bands(docs, both)
    assert Q.OPEN not in judged.bands
    kept = {r.doc_id for r in Q.keep_good(docs, rules=judged).select("doc_id").collect()}
    for script in (range(0, 600, 2), range(1, 600, 2)):
        assert len(kept & {*script}) >= 0.97 * 300
    assert not kept & {*range(600, len(texts))}
    # limits of one script only
    accents = spark.createDataFrame([(i, 1) for i in range(1, 600, 2)], "doc_id long, quality int")
    assert Q.fit_bands(docs, accents).bands[0] == Q.OPEN
    assert Q.fit_bands(docs, labels.limit(0)).bands == Q.QualityRules().bands
    assert Q.fit_bands(docs.limit(0), labels).bands == Q.QualityRules().bands


# ---- Jaccard


def brute_sets(texts, k):
    out = []
    for t in texts:
        w = WORD.findall(low(t))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute_components(rows, k, percent):
    sets = brute_sets([t for _, t in rows], k)
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(rows[a][0]), root(rows[b][0])
                up[max(x, y)] = min(x, y)
    return {(i, len(s), root(i)) for (i, _), s in zip(rows, sets)}


def near(text, rnd, edits):
    words = text.split()
    for _ in range(edits):
        i = rnd.randrange(len(words))
        words[i] = f"e{rnd.randrange(10**6)}"
    return " ".join(words)


def jaccard_cases():
    rnd = random.Random(7)
    texts = [*ODD, "A B c", "a b C"]
    common = prose(99, 60)
    for g in range(12):
        base = prose(100 + g, rnd.choice((5, 8, 40, 150, 400)), 4000)
        texts += [base, base.upper(), *(near(base, rnd, rnd.randrange(0, 9)) for _ in range(6))]
    base = prose(500, 160, 4000)
    texts += [near(base, rnd, rnd.randrange(0, 10)) for _ in range(60)]
    texts += [f"{prose(600 + i, 50, 4000)} {common}" for i in range(20)]
    texts += [f"{prose(700 + i, 4, 4000)} {common}" for i in range(6)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "percent", "block", "listed"), [(4, 85, 400_000, 65_536), (5, 80, 1500, 7), (2, 60, 3000, 3)])
def test_components_against_brute_force(spark, monkeypatch, k, percent, block, listed):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(J, "LIST_ROWS", listed)
    rows = jaccard_cases()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int").repartition(5)
    got = J.jaccard_components(docs, shingle_words=k, percent=percent)
    assert {tuple(r) for r in got.collect()} == brute_components(rows, k, percent)
    kept = {r.doc_id for r in J.keep_first(docs, shingle_words=k, percent=percent).collect()}
    assert kept == {c for _, _, c in brute_components(rows, k, percent)}


def test_jaccard_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (0, None)], "doc_id long, text string")
    got = sorted(map(tuple, J.jaccard_components(docs, shingle_words=4, percent=85).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (0, 0, 0)], key=str)
    assert J.jaccard_components(docs.limit(0)).count() == 0
    assert sorted(map(tuple, J.keep_first(docs, shingle_words=4, percent=85).collect()), key=str) == sorted([(1, "a b c d e"), (None, "a b c d e"), (0, None)], key=str)


def test_rows_that_share_an_id(spark):
    a, b, c = (prose(900 + i, 60, 4000) for i in range(3))
    rows = [(5, a, 1, "x"), (5, b, 2, "x"), (2, b, 3, "x"), (5, a, 4, "x"), (7, c, 5, "x"), (7, None, 6, "x"), (7, "", 7, "x"), (None, c, 8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _again string").repartition(3)
    kept = J.keep_first(docs)
    assert kept.columns == docs.columns
    found = [tuple(r) for r in kept.collect()]
    assert sorted((i or -1, t or "") for i, t, *_ in found) == sorted([(5, a), (2, b), (7, c), (7, ""), (-1, c)])
    assert {r[2] for r in found} == {r[2] for r in J.keep_first(docs.repartition(1)).collect()}


def test_large_group_of_sets_that_do_not_link():
    rnd = np.random.default_rng(5)
    shared = np.uint64(7)
    sets = [np.unique(np.append(rnd.choice(2**62, 30).astype(np.uint64), shared)) for _ in range(6000)]
    forest, began = J._Forest(len(sets)), time.time()
    J.link_group(sets, range(len(sets)), 85, forest, 0)
    assert not forest.links and time.time() - began < 10


def test_divide_skip_against_all_overlaps():
    rnd = np.random.default_rng(3)
    base = rnd.choice(2**40, 80, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[rnd.random(80) < 0.95], rnd.choice(2**40, rnd.integers(0, 12)).astype(np.uint64)))) for _ in range(70)]
    lists = J.InvertedLists(sets)
    for q in sets:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))]
        assert sorted(lists.search(q, 80).tolist()) == want


def test_every_good_text_counts_for_the_limits(spark):
    # more good texts than were once drawn; one in a hundred compresses far better than the others
    rnd = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rnd.integers(0, 26, 6)) for _ in range(3000)]
    rows = [(i, " ".join(["same"] * 80) if i % 100 == 0 else " ".join(words[w] for w in rnd.integers(0, 3000, 57))) for i in range(7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    rules = Q.fit_bands(docs, docs.selectExpr("doc_id", "1 AS quality"))
    pack = Q.zstandard.ZstdCompressor(level=3).compress
    sizes, ratios = (np.array(x) for x in zip(*((len(t), len(t) / len(pack(t.encode()))) for _, t in rows), strict=True))
    for at, low, high in zip(*rules.bands[0], strict=True):
        mine = np.floor(2 * np.log2(sizes)) == np.floor(2 * at)
        assert mine.sum() == len(rows) or mine.sum() >= 30
        assert low == pytest.approx(np.quantile(ratios[mine], 0.001) * 0.985, rel=2e-4)
        assert high == pytest.approx(max(np.quantile(ratios[mine], 0.999) * 1.015, 0), rel=2e-4)
