"""Token files against the libraries' ids of whole texts, their encodings, and readers that leave out what isn't asked for."""

import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalmill.llm import _pieces as P
from signalmill.llm import token_files as F
from signalmill.llm._text import buffers

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SPACES = " \t\n\r\x0b\x1c\x1f\x85\xa0   　"
ODD = ["", " ", "  ", "a ", " a", "a  b", "a  b", "a   b", "it's 'll 9 99", "x <|endoftext|> y", "<|endoftext|>", "▁ a▁b", "日本語 の テキスト", "слово слово", "a\n b\n\nc", "\x00 \x00a"]


def library(texts, special=True):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = not special
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def by_pieces(encoder, texts):
    ids, ends = encoder.rows(*buffers(pa.array(texts, pa.string())))
    return [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:], strict=True)]


def model(texts):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(texts, num_threads=1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(SPACES + "abзя日.,'s19é<|>▁"), max_size=40), min_size=1, max_size=6))
def test_pieces_have_the_ids_of_whole_texts(texts):
    assert by_pieces(P.byte_level(BYTES, True), texts) == library(texts)
    assert by_pieces(P.byte_level(BYTES, False), texts) == library(texts, special=False)
    assert by_pieces(P.piece_model(PIECES), [" " + t for t in texts]) == model(texts)


def test_odd_texts_and_pieces_that_are_not_remembered():
    few = P.byte_level.__wrapped__(BYTES, True)
    few.remembered = 5
    for _ in range(3):
        assert by_pieces(few, ODD) == library(ODD)
    assert len(few.known) == 5 and by_pieces(few, []) == []
    assert by_pieces(P.piece_model(PIECES), [" " + t for t in ODD]) == model(ODD)
    said = P.byte_level(BYTES, True)
    ids = np.array([i for t in library(ODD) for i in t])
    assert said.vocabulary.joined(ids).tobytes() == "".join(ODD).encode()


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeiou") for _ in range(rnd.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(4)
    rows = [(i, words(rnd, rnd.choice((1, 30, 400))), "en", i % 7) for i in range(300)]
    rows += [(500, None, "x", 1), (501, "", None, None), (None, "no id", "x", 1), (502, words(rnd, 60_000), "long", 2), (503, "x" * 100_000, "long", 2)]
    rows += [(7, "another seven", "x", 1), *[(9, "the same", "x", 1)] * 40]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, file string, first long").repartition(6)


def test_digests_match_brute_force(spark, docs):
    got = sorted(map(tuple, F.token_digests(frame(spark, docs), BYTES, 2).collect()), key=lambda r: r[1])
    assert [r[0] is None for r in got] == [True] + [False] * (len(docs) - 1)
    assert [r[0] for r in got[1:]] == sorted(d[0] for d in docs if d[0] is not None)
    at, want = 0, {}
    for (i, text, *_), ids in zip(docs, library([d[1] or "" for d in docs]), strict=True):
        ids = [*ids, 2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for i, start, n, crc in got:
        assert start == at
        at += n
        want[i].remove((n, crc))
    assert not any(want.values())


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_have_the_layout_and_readers_take_what_they_need(spark, docs, encoding):
    folder = tempfile.mkdtemp(prefix="tokens-") + "/f"
    layout = F.TokenFormat(encoding=encoding, row_group_bytes=40_000, page_rows=16)
    F.write_tokens(frame(spark, docs), folder, BYTES, 2, files=3, layout=layout, metadata=("file", "first"))
    files = sorted(p for p in __import__("glob").glob(folder + "/*.parquet"))
    assert len(files) == 3
    groups, last = 0, -1
    for p in files:
        said = pq.ParquetFile(p)
        order = [x if x is not None else -1 for x in said.read(["doc_id"]).column(0).to_pylist()]
        assert order == sorted(order) and order[0] >= last
        last = order[-1]
        for g in range(said.metadata.num_row_groups):
            groups += 1
            columns = {said.metadata.row_group(g).column(c).path_in_schema: said.metadata.row_group(g).column(c) for c in range(said.metadata.num_columns)}
            ids = columns["ids.list.element"]
            assert ("RLE_DICTIONARY" in ids.encodings) == (encoding == "dictionary") and ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta")
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    assert groups > 3
    counts = F.read_counts(spark, folder)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in "".join(line for line in plan.splitlines() if "ReadSchema" in line)
    whole = sorted(F.read_documents(spark, folder).collect(), key=lambda r: r.start)
    assert sorted((r.start, r.n_tokens, r.meta.file) for r in counts.collect()) == [(r.start, r.n_tokens, r.meta.file) for r in whole]
    some = F.read_documents(spark, folder, 5, 9)
    assert "GreaterThanOrEqual(doc_id,5)" in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.start for r in some.collect()) == [r.start for r in whole if r.doc_id is not None and 5 <= r.doc_id <= 9]
    stream = [i for r in whole for i in r.ids]
    for begin, end in ((0, 1), (100, 900), (len(stream) - 5, len(stream) + 50), (0, len(stream))):
        pieces = sorted(F.read_positions(spark, folder, begin, end).collect(), key=lambda r: r.start)
        assert [i for r in pieces for i in r.ids] == stream[begin:end]
        assert [r.start for r in pieces] == list(np.cumsum([begin, *(len(r.ids) for r in pieces)])[:-1])
    assert F.read_positions(spark, folder, len(stream), len(stream) + 1).count() == 0


def test_empty_table_and_a_wrong_encoding(spark):
    assert F.token_digests(spark.createDataFrame([], "doc_id long, text string"), BYTES, 2).collect() == []
    with pytest.raises(ValueError):
        F.TokenFormat(encoding="plain").options()
