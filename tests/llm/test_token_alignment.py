"""Alignment of two tokenizers against the libraries on whole texts and counts by plain dictionaries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa

from signalmill.llm import token_alignment as A

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Of each text its groups (lists of A ids and B ids) and links."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_lib.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def b_bytes(i):
        said = b_lib.id_to_piece(i)
        return bytes([int(said[3:5], 16)]) if b_lib.is_byte(i) else said.replace("▁", " ").encode()

    out = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        sides = []
        for ids, said in ((a_lib.encode(" " + (text or ""), add_special_tokens=False).ids, lambda i: bytes(byte[c] for c in a_lib.id_to_token(i))), (b_lib.encode(text or ""), b_bytes)):
            spans, at = [], 0
            for i in ids:
                spans.append((i, at, at := at + len(said(i))))
            sides.append((spans, b"".join(map(said, ids))))
        if not text or sides[0][1] != whole or sides[1][1] != whole:
            out.append(([], [], 0, 0))
            continue
        (a, _), (b, _) = sides
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append(([i for i, s, e in a if low <= s and e <= cut], [i for i, s, e in b if low <= s and e <= cut]))
            low = cut
        out.append((groups, links, len(a), len(b)))
    return out


def corpus():
    rnd = random.Random(5)
    parts = ["the", "Thenth", "éa", "tionne", "日本", "слово", "x9", "...", "\n", "  ", "\t", "of.\nThe", "Ünder", "<|endoftext|>", "<s>", " ", "🙂", "a's"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    texts += ["", None, " ", "  lead", "trail  ", "▁ marked", "a▁b", "same again", "same again", "same again", "x" * 3000, "\x00", "Zeile\r\n\r\nzwei"]
    return [(i, t) for i, t in enumerate(texts)] + [(7, "repeated id"), (None, "no id")]


def expected(rows):
    found = brute([t for _, t in rows])
    counts = Counter(link for _, links, *_ in found for link in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (i, _), (groups, links, n_a, n_b) in zip(rows, found, strict=True):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out, counts, best


def key(row):
    return (row[0] is not None, *map(str, row))


def test_scores_match_brute_force(spark):
    rows = corpus()
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, n_a int").repartition(5)
    want, counts, best = expected(rows)
    got = A.alignment_scores(docs, A_PATH, B_PATH, stripe_ids=5)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    # another width of stripes
    assert sorted(map(tuple, A.alignment_scores(docs, A_PATH, B_PATH, stripe_ids=40_000).collect()), key=key) == sorted(want, key=key)
    pairs = A.pair_counts(docs, A_PATH, B_PATH).collect()
    assert {(r.a_id, r.b_id): r.links for r in pairs} == counts and all(r.best == (r.links == best[r.b_id]) for r in pairs)
    assert A.alignment_scores(docs.limit(0), A_PATH, B_PATH).collect() == []


def test_groups_of_a_text_and_small_blocks():
    rows = corpus()
    found = brute([t for _, t in rows])
    few = A.Aligner(A.byte_level.__wrapped__(A_PATH, False), A.piece_model.__wrapped__(B_PATH), remembered=10)
    few.a.remembered = few.b.remembered = 0
    batch = pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["doc_id", "text"])
    at, ids = 0, []
    for _ in range(2):
        at = 0
        for numbers, block in A._blocks([batch.slice(0, 20), batch.slice(20)], few, 300):
            ids += numbers.to_pylist()
            for line, n_a, n_links in zip(block.lines(), block.sums("a_ids"), block.sums("link_a"), strict=True):
                groups, links, tokens, _ = found[at]
                assert line.decode() == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
                assert (n_a, n_links) == (tokens, len(links))
                at += 1
        assert at == len(rows)
    assert len(few.known) == 10 and ids == 2 * [i for i, _ in rows]


def test_align_gives_ids_and_group_sizes(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in A.align(docs, A_PATH, B_PATH).collect()}
    for (i, _), (groups, _, n_a, n_b) in zip(rows, brute([t for _, t in rows]), strict=True):
        assert [(g.n_a, g.n_b) for g in got[i].groups] == [(len(a), len(b)) for a, b in groups]
        assert got[i].a_ids == [x for a, _ in groups for x in a] and got[i].b_ids == [x for _, b in groups for x in b]
        assert (len(got[i].a_ids), len(got[i].b_ids)) == (n_a, n_b)
