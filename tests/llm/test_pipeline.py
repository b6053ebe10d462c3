import random
import sys
from pathlib import Path

import public_tokenizers

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_byte_bpe import library  # noqa: E402
from test_decontaminate import least_edits, norm  # noqa: E402
from test_pii import brute as personal  # noqa: E402
from test_quality_and_jaccard import brute_components, brute_quality, near, prose  # noqa: E402


def table():
    rnd = random.Random(21)
    items = [(i, prose(800 + i, 16, 3000)) for i in range(4)]
    texts = [None, "", "too short", "same line again\n" * 60, " ".join(["word"] * 300)]
    for g in range(8):
        base = prose(900 + g, rnd.choice((60, 90, 140)), 3000)
        texts += [base, base, near(base, rnd, 2), near(base, rnd, 30)]
    texts += [f"{prose(950 + i, 40, 3000)} {items[i][1].upper()}. {prose(960 + i, 40, 3000)}" for i in range(4)]
    texts += [f"{prose(970 + i, 70, 3000)} me{i}@mail.example.com +1 (555) 234-567{i} 10.0.0.{i} é" for i in range(4)]
    rnd.shuffle(texts)
    return items, [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]


def redacted(text):
    spans = [s.split(":") for s in personal(text).split(",") if s]
    out, at = "", 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in spans), key=lambda s: s[1]):
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    return out + text[at:]


def brute(items, rows):
    rows = [r for r in rows if brute_quality(r[1])[-1]]
    first = {c for _, _, c in brute_components([(r[0], r[1]) for r in rows], 5, 80)}
    rows = [r for r in rows if r[0] in first]
    clean = lambda t: all(least_edits(norm(b), norm(t)) > len(norm(b)) // 10 for _, b in items)
    rows = [r for r in rows if clean(r[1])]
    encode = library()[1].encode_ordinary
    out = {}
    for i, t, lang, source, n in rows:
        new = redacted(t)
        ids = encode(new)
        out[i] = (lang, source, len(new) if new != t else n, len(ids), ids)
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    items, rows = table()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = brute(items, rows)
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert 10 < len(want) < len(rows) - 10


def test_stages_keep_the_columns(spark, tmp_path):
    items, rows = table()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, str(tmp_path))
            assert frame.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
        assert last.count() <= len(rows)
    assert corpus_pipeline.ORACLE_SQL is None and public_tokenizers.PATTERN
