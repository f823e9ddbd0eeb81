"""A SentencePiece model's pieces, and the chunks of a text that no piece crosses.

The escaped text is the text with a space before it, if it is not empty, and every space as U+2581. A chunk is a run of
U+2581 and what follows it up to the next one. Models in which no piece has U+2581 after another character can be
applied chunk by chunk; that is checked when a model is loaded, as are the other properties this relies on.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

from ._text import LOW_BYTES, eights, mix, split_words

MARK = "▁"
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[0x20] = False


class Vocabulary(NamedTuple):
    """Pieces that can be matched, the score of an unknown character, and the ids of bytes."""

    ids: dict[str, int]
    scores: np.ndarray  # by id
    unknown: float
    byte_ids: np.ndarray
    text: list[bytes]  # by id: what decoding gives
    longest: int


@lru_cache(4)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _fields(data: bytes):
    """(number, value) of the fields of a protobuf message."""
    i = 0

    def varint():
        nonlocal i
        shift = value = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[i : i + n]
            i += n


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """The pieces of a model file, which must split at spaces, fall back to bytes and not normalise."""
    with open(path, "rb") as f:
        fields = list(_fields(f.read()))
    pieces = [dict(_fields(v)) for k, v in fields if k == 1]
    names = [p[1].decode() for p in pieces]
    kinds = [p.get(3, 1) for p in pieces]  # 1: normal, 4: user-defined, 6: byte
    scores = np.array([np.frombuffer(p[2], np.float32)[0] if 2 in p else 0.0 for p in pieces])
    normal = dict(_fields(next(v for k, v in fields if k == 3)))
    if normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1):
        raise ValueError("the model normalises texts; only those that keep them and add a space before are covered")
    if kinds.count(6) != 256 or 4 in kinds:
        raise ValueError("the model has no byte fallback or has user-defined pieces")
    ids = {name: i for i, (name, kind) in enumerate(zip(names, kinds, strict=True)) if kind == 1}
    if any(MARK in name.lstrip(MARK) for name in ids):
        raise ValueError("the model has pieces across words")
    byte_ids = np.empty(256, np.int32)
    text = [n.replace(MARK, " ").encode() for n in names]
    for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
        if kind == 6:
            byte_ids[int(name[3:5], 16)] = i
            text[i] = bytes([int(name[3:5], 16)])
        elif kind != 1:
            text[i] = b""
    normal_scores = scores[list(ids.values())]
    return Vocabulary(ids, scores, float(normal_scores.min() - 10), byte_ids, text, max(map(len, ids)))


class Chunks(NamedTuple):
    """Chunks of a block: each one's key (a hash), begin (without its first mark), end, and documents' ranges of them.

    Keys may collide; chunks are told apart by their bytes, as numbers of eight.
    """

    key: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    numbers: np.ndarray

    def words(self, rows: np.ndarray) -> np.ndarray:
        """The bytes of some chunks as numbers of eight, each chunk's last one filled up with zeros."""
        size = self.end[rows] - self.begin[rows]
        n = (size + 7) >> 3
        out = self.numbers[np.repeat(self.begin[rows] - 8 * (np.cumsum(n) - n), n) + 8 * np.arange(int(n.sum()))]
        full = n > 0
        out[np.cumsum(n)[full] - 1] &= LOW_BYTES[(size - 8 * (n - 1))[full]]
        return out

    def same(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether chunks equal others of this block, byte by byte."""
        size = self.end[rows] - self.begin[rows]
        out = size == self.end[others] - self.begin[others]
        at = np.flatnonzero(out)
        return _all_equal(out, at, size[at], self.words(rows[at]), self.words(others[at]))

    def texts(self, rows: np.ndarray) -> list[str]:
        return texts_of(self.data, self.begin[rows], self.end[rows])


def _all_equal(out: np.ndarray, at: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``out`` without those of ``at`` whose numbers, (size + 7) // 8 each, differ."""
    if len(bad := np.flatnonzero(a != b)):
        ends = np.cumsum((size + 7) >> 3)
        out[at[np.unique(np.searchsorted(ends, bad, "right"))]] = False
    return out


class ChunkTable:
    """Values of chunks, found by hash and told apart by their bytes; of colliding chunks the first is held."""

    def __init__(self, columns: int = 1):
        self.key = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.numbers = np.zeros(0, np.uint64)
        self.values = np.zeros((0, columns), np.int64)

    def find(self, chunks: Chunks, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of chunks, and which of them are here."""
        if not len(self.key):
            return np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        key = chunks.key[rows]
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        size = chunks.end[rows] - chunks.begin[rows]
        ok = (self.key[place] == key) & (self.size[place] == size)
        at = np.flatnonzero(ok)
        n = (size[at] + 7) >> 3
        mine = self.numbers[np.repeat(self.at[place[at]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return place, _all_equal(ok, at, size[at], chunks.words(rows[at]), mine)

    def add(self, chunks: Chunks, rows: np.ndarray, values: np.ndarray) -> None:
        """Chunks of different keys, of which those stay out whose key is here."""
        if len(self.key):
            place = np.minimum(np.searchsorted(self.key, chunks.key[rows]), len(self.key) - 1)
            new = self.key[place] != chunks.key[rows]
            rows, values = rows[new], values[new]
        size = chunks.end[rows] - chunks.begin[rows]
        n = (size + 7) >> 3
        key = np.concatenate([self.key, chunks.key[rows]])
        order = np.argsort(key, kind="stable")
        self.at = np.concatenate([self.at, np.cumsum(n) - n + len(self.numbers)])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.values = np.concatenate([self.values, values.reshape(len(rows), self.values.shape[1])])[order]
        self.numbers = np.concatenate([self.numbers, chunks.words(rows)])
        self.key = key[order]


def distinct(chunks: Chunks, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct chunks: a row of each, each row's place among them, how many rows each has, and rows that are none of
    them, as their key collides with another chunk's."""
    _, one, back, often = np.unique(chunks.key[rows], return_index=True, return_inverse=True, return_counts=True)
    one = rows[one]
    odd = rows[~chunks.same(rows, one[back])]
    return one, back, often, odd


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> Chunks:
    """Of a block without U+2581 in it. Spaces at a text's end are a chunk of their own."""
    words = split_words(data, offsets, _NOT_SPACE, fold=False)
    count = np.diff(words.first)
    before = np.empty(len(words.start), np.int64)
    before[1:] = words.end[:-1]
    begins = words.first[:-1][count > 0]
    # A chunk's text lacks its first mark: the space before, which for a document's first chunk is the one that is added.
    begin = before + 1
    begin[begins] = offsets[:-1][count > 0]
    key = words.hash.copy()
    gap = words.start - begin
    far = gap > 0
    key[far] ^= mix(gap[far].astype(np.uint64))
    # Spaces at the end: after the last word, or of a text that is nothing but spaces.
    last_end = offsets[:-1].copy()
    last_end[count > 0] = words.end[words.first[1:][count > 0] - 1] + 1
    tail = np.flatnonzero((offsets[1:] >= last_end) & (count > 0) | (count == 0) & (offsets[1:] > offsets[:-1]))
    if len(tail):
        size = offsets[1:][tail] - last_end[tail]
        at = words.first[1:][tail]
        key = np.insert(key, at, mix(size.astype(np.uint64) + np.uint64(1 << 40)))
        begin, end = np.insert(begin, at, last_end[tail]), np.insert(words.end, at, offsets[1:][tail])
        extra = np.zeros(len(count), np.int64)
        extra[tail] = 1
        first = words.first + np.concatenate([[0], np.cumsum(extra)])
    else:
        end, first = words.end, words.first
    return Chunks(key, begin, end, first, data, eights(data))


def marks_as_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block with U+2581, which encodes as a space does, as a space."""
    raw = data.tobytes()
    if MARK.encode() not in raw:
        return data, offsets
    texts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def texts_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def encode_chunks(path: str, texts: list[str]) -> list[list[int]]:
    """The library's ids of chunks, given without their first mark."""
    found = processor(path).encode(texts, out_type=int, num_threads=1)
    v = vocabulary(path)
    alone = [v.ids[MARK]] if MARK in v.ids else v.byte_ids[list(MARK.encode())].tolist()
    return [x or alone for x in found]
