"""Texts as pieces that tokenizers treat apart, and a library's token ids for the distinct ones.

A piece begins at a space between two characters that are no white space. Byte-level BPE never joins a token across such a
place, as its pattern ends a match there, nor does a piece model whose vocabulary has no space after another character. So the
ids of a text are those of its pieces, one after the other, and a piece that comes again need not be encoded again.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_NO_WORD = np.zeros(256, bool)
_NO_WORD[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
#: White space, or the first byte of characters of which some are white space
_MAYBE_SPACE = _NO_WORD.copy()
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True

#: Bytes of text that the library gets at once when pieces are joined.
JOINED_BYTES = 4096
#: Pieces whose ids a worker remembers: some 100 bytes each.
REMEMBERED = 600_000


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of some rows; each row that is not empty begins one."""
    n = len(data)
    begin = np.zeros(n, bool)
    if n > 2:
        begin[1:-1] = (data[1:-1] == 0x20) & ~_NO_WORD[data[:-2]] & ~_MAYBE_SPACE[data[2:]]
    # a space that ends its row has no next character of its own
    last = offsets[1:] - 1
    begin[last[(last >= 0) & (offsets[1:] > offsets[:-1])]] = False
    begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(begin)


def distinct_pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each piece among the distinct ones, and these."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    bounds = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pc.dictionary_encode(pieces)
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of runs, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Vocabulary:
    """The bytes of each token id."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of some ids, joined."""
        return self.data[ranges(self.begins[ids], self.lengths[ids])]


class PieceEncoder:
    """Ids of pieces by a library's ``encode`` of many texts. It remembers the first pieces up to a number and encodes others each time."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.encode, self.vocabulary, self.remembered = encode, vocabulary, remembered
        self.known: dict[bytes, int] = {}
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """For each of some distinct pieces its number n: its ids are ids[bounds[n] : bounds[n + 1]], until the next call."""
        kept = len(self.known)
        self.bounds = self.bounds[: kept + 1]
        self.ids = self.ids[: self.bounds[-1]]
        known = self.known
        at = np.fromiter((known.get(p, -1) for p in pieces), np.int64, len(pieces))
        fresh = [pieces[i] for i in np.flatnonzero(at < 0)]
        if fresh:
            ids, counts = self._encoded(fresh)
            at[at < 0] = np.arange(kept, kept + len(fresh))
            self.ids = np.concatenate((self.ids, ids))
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(counts)))
            more = min(len(fresh), max(0, self.remembered - kept))
            known.update(zip(fresh[:more], range(kept, kept + more), strict=True))
        return at

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Their ids and how many each has. Pieces that begin with a space and a word are joined for the library and told apart by bytes."""
        texts, members, room = [], [], 0
        for i, p in enumerate(pieces):
            joins = len(p) > 1 and p[0] == 0x20 and not _MAYBE_SPACE[p[1]] and not _NO_WORD[p[-1]]
            if joins and room >= len(p):
                texts[-1].append(p)
                members[-1].append(i)
                room -= len(p)
            else:
                texts.append([p])
                members.append([i])
                room = JOINED_BYTES - len(p) if joins else 0
        found: list = [None] * len(pieces)
        alone = []
        for group, ids in zip(members, self.encode([b"".join(t).decode() for t in texts]), strict=True):
            if len(group) == 1:
                found[group[0]] = ids
                continue
            ends = np.cumsum(self.vocabulary.lengths[ids])
            wanted = np.cumsum([len(pieces[i]) for i in group])
            cut = np.searchsorted(ends, wanted)
            if cut[-1] < len(ends) and (ends[cut] == wanted).all():
                begin = 0
                for i, c in zip(group, (cut + 1).tolist(), strict=True):
                    found[i] = ids[begin:c]
                    begin = c
            else:
                alone += group
        for i, ids in zip(alone, self.encode([pieces[i].decode() for i in alone]) if alone else [], strict=True):
            found[i] = ids
        counts = np.array([len(f) for f in found], np.int64)
        return np.array([i for f in found for i in f], np.int32), counts

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole rows, and where each row's begin (with the end)."""
        starts = piece_starts(data, offsets)
        code, pieces = distinct_pieces(data, starts)
        at = self.numbers(pieces)[code]
        counts = self.bounds[at + 1] - self.bounds[at]
        ids = self.ids[ranges(self.bounds[at], counts)]
        ends = np.concatenate(([0], np.cumsum(counts)))
        return ids, ends[np.searchsorted(starts, offsets)]


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(4)
def byte_level(path: str, special: bool) -> PieceEncoder:
    """A byte-level BPE file of the tokenizers library. special: strings of special tokens in a text become these tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    assert said["normalizer"] is None and said["pre_tokenizer"]["type"] == "ByteLevel" and not said["pre_tokenizer"]["add_prefix_space"], path
    byte, tokens = _byte_of(), [b""] * tokenizer.get_vocab_size()
    for token, i in said["model"]["vocab"].items():
        tokens[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
    for added in said["added_tokens"]:
        # a token that takes white space beside it would reach over the end of a piece
        assert not (added["lstrip"] or added["rstrip"] or added["single_word"] or " " in added["content"]), added
        tokens[added["id"]] = added["content"].encode()
    return PieceEncoder(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], Vocabulary(tokens))


@functools.lru_cache(4)
def piece_model(path: str) -> PieceEncoder:
    """A model file of the sentencepiece library, for pieces that begin with the space that the library adds itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert model.encode("  a  b ") and model.decode(model.encode("  a  b ")) == "  a  b ", "white space must be kept"
    tokens, mark = [], "▁"
    for i in range(model.vocab_size()):
        said = model.id_to_piece(i)
        if model.is_byte(i):
            tokens.append(bytes([int(said[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            tokens.append(b"")
        else:
            assert mark not in said.lstrip(mark), "a piece of the vocabulary goes on after a space"
            tokens.append(said.replace(mark, " ").encode())
    return PieceEncoder(lambda texts: model.encode([t[1:] for t in texts], num_threads=1), Vocabulary(tokens))
