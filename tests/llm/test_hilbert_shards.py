import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from signalmill.llm import hilbert_shards as H


def plain_index(point, bits):
    """The curve by its plain definition, in a loop over bits."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ t) >> b & 1)
    return out


def test_curve_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 2), (1, 4)):
        side = 1 << bits
        points = spark.range(side**n).select(*(F.expr(f"CAST(id DIV {side**i} % {side} AS INT)").alias(f"c{i}") for i in range(n)))
        rows = points.withColumn("h", H.hilbert_index([F.col(f"c{i}") for i in range(n)], bits)).collect()
        order = sorted(rows, key=lambda r: r.h)
        assert [r.h for r in order] == list(range(side**n))
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(order, order[1:]))
        assert all(r.h == plain_index(r[:n], bits) for r in rows)


def plain_text_cuts(values, bits):
    """The greatest value whose last row lies in each step of equal shares, but for the last step."""
    values = sorted((v for v in values if v is not None), key=str.encode)
    last = {v: i + 1 for i, v in enumerate(values)}
    steps = {}
    for v, upto in last.items():
        steps[-(-upto * 2**bits // len(values))] = v
    return [v for k, v in sorted(steps.items()) if k < 2**bits]


def cases():
    rnd = random.Random(3)
    rows = [(i, None if i % 50 == 7 else "é" * rnd.randrange(60), rnd.choice(("en", "de", None)), "hot" if i % 3 else f"s{rnd.randrange(9)}", rnd.randrange(5000), 1) for i in range(500)]
    return rows + [rows[4], rows[4], (None, "x", None, None, None, 1)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int"


def test_shards_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "PART_ROWS", 40)
    docs = spark.createDataFrame(cases(), SCHEMA).repartition(4)
    got = H.shard_rows(docs, 24).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in cases())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    cuts = H.cut_points(docs, ["lang", "source", "n_chars"], 4)
    assert cuts["lang"] == plain_text_cuts([r[2] for r in cases()], 4) and cuts["source"] == plain_text_cuts([r[3] for r in cases()], 4)
    cells = {r[0]: [0 if v is None else sum(c < v for c in cuts[d]) for d, v in zip(cuts, r[2:5])] for r in cases()}
    assert all(r.curve == plain_index(cells[r.doc_id], 4) for r in got)


def test_strings_with_a_long_common_head_are_parted(spark):
    rows = [(i, "x", f"https://archive.example.org/{i % 40:02d}" + "y" * (i % 40 == 3) * 5000) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert H.cut_points(docs, ["source"], 4)["source"] == plain_text_cuts([r[2] for r in rows], 4)
    cells = Counter(r.curve for r in H.shard_rows(docs, 8).collect())
    assert len(cells) >= 13 and max(cells.values()) <= 80


def test_an_id_that_fills_a_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(H, "PART_ROWS", 20)
    docs = spark.createDataFrame([(None, "same", "s", 5)] * 700 + [(i, "t", "s", 5) for i in range(60)], "doc_id long, text string, source string, n_chars long").repartition(6)
    counts = Counter((r.shard, r.slot) for r in H.shard_rows(docs, 7).collect())
    assert len(counts) == 760 and max(counts.values()) == 1


def test_odd_tables(spark):
    docs = spark.createDataFrame(cases(), SCHEMA)
    assert H.shard_rows(docs.limit(0), 24).count() == 0
    assert [(r.shard, r.slot) for r in H.shard_rows(docs.limit(1), 24).collect()] == [(0, 0)]
    assert H.shard_rows(docs.select("doc_id", "text"), 5).count() == len(cases())


def test_files_prune(spark, tmp_path):
    docs = spark.createDataFrame(cases(), SCHEMA).withColumn("_shard", F.lit("taken"))
    H.write_shards(docs, str(tmp_path / "out"), 8, files=20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(tuple(r) for r in back.drop("_shard_").collect()) == Counter(tuple(r) for r in docs.collect())
    sizes = Counter(r["_shard_"] for r in back.collect())
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    # a shard is written by several tasks
    assert max(len(list(p.glob("*.parquet"))) for p in (tmp_path / "out").iterdir()) > 1
    spans = back.groupBy("_shard_").agg(F.min("n_chars").alias("a"), F.max("n_chars").alias("b")).collect()
    assert sum(r.b - r.a for r in spans) < 0.9 * 8 * 5000
