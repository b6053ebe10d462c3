import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from signalmill.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cases():
    rnd = random.Random(1)
    return [None, "", " ", "a" * 5000, " " * 50 + "x", "ab" * 3000, "héé" * 100, "日本語テキスト" * 30, "<|endoftext|>", "don't we'll I'd", "\n\n \t x", "".join(chr(rnd.randrange(32, 0x3000)) for _ in range(4000)), "".join(rnd.choice("abc") for _ in range(6000)), "🙂🙃" * 9, "the same", "the same"]


def test_encoder_against_the_library(monkeypatch):
    ranks, other = library()
    for chunk in (50, 4 << 20):
        monkeypatch.setattr(B, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(B, "REMEMBERED", chunk)
        encoder = B.Encoder(ranks, public_tokenizers.PATTERN)
        for text, ids in zip(cases(), encoder.encode(pa.array(cases()))):
            assert ids.tolist() == other.encode_ordinary(text or "")
            assert encoder.decode(ids) == (text or "").encode()


@pytest.mark.parametrize("seed", range(6))
def test_odd_vocabularies(seed):
    """Ranks in any order: the pair of lowest rank, leftmost first, one at a time."""
    rnd = random.Random(seed)
    tokens = {bytes([b]) for b in b"abc"}
    while len(tokens) < 30:
        tokens.add(rnd.choice(sorted(tokens)) + rnd.choice(sorted(tokens)))
    many = sorted(tokens, key=lambda t: (len(t) > 1, rnd.random()))
    ranks = {t: i for i, t in enumerate(many)}
    words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(0, 25))) for _ in range(200)]

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    got = B.encode_words(words, B.Merges(ranks))
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [plain(w) for w in words]


def test_queue_gives_the_lowest_rank():
    rnd, queue, held = random.Random(3), B.RankQueue(50_000), {}
    for _ in range(2000):
        if rnd.random() < 0.6 or not held:
            r, p = rnd.choice((rnd.randrange(50_000), rnd.randrange(100))), rnd.randrange(10**6)
            queue.push(np.array([r]), np.array([p]))
            held.setdefault(r, []).append(p)
        else:
            r, at = queue.pop()
            assert r == min(held) and at.tolist() == sorted(held.pop(r))


def test_on_spark(spark):
    ranks, other = library()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases())], "doc_id long, text string, n_tokens string").repartition(3)
    rows = {r.doc_id: r for r in B.token_digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    full = {r.doc_id: r for r in B.with_tokens(docs, PATH, public_tokenizers.PATTERN, ids_column="token_ids").collect()}
    for i, text in enumerate(cases()):
        ids = other.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids) and full[i].token_ids == ids and full[i].text == text
        assert rows[i].ids_sha256 == hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert B.token_digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
