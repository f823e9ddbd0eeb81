"""Columnar text kernels shared by the corpus operators.

Everything here works on the UTF-8 bytes of an Arrow string column, a block of whole documents at a time, so that a
task's memory is bounded by the block (``BLOCK_BYTES``, or one document if that is longer) and no Python object is made
for a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
BLOCK_BYTES = 1 << 19

_ODD, _ODD2, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)
#: The low bytes of a number, by how many.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed by blake2b.
LONG_WORD = 64

#: Bytes of a word under the ASCII word rule: 0-9, A-Z, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of a word that ends at white space only.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: A-Z to a-z, everything else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


_owner: dict[str, dict] = {}


def worker_cache(name: str, cache: dict) -> dict:
    """``cache`` of an operator in a Python worker, which serves one task after the other: those of other operators, which
    take as much memory and won't be asked again soon, are emptied."""
    for other, held in list(_owner.items()):
        if other != name:
            held.clear()
            del _owner[other]
    _owner[name] = cache
    return cache


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, which spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """At each byte, the number that it and the next seven make (zeros after the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), "<u8", padded, 0, (1,)).copy()


def hash_ranges(data: np.ndarray, numbers: np.ndarray, start: np.ndarray, end: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """64-bit hashes of byte ranges that are not empty, and with ``wide`` a second, independent one.

    Eight bytes at a time are mixed into the hash of those before, so that no arrangement of bytes cancels out; of
    ranges up to 8 bytes and of one length, no two have the same hash.
    """
    size = end - start
    first = numbers[start] & LOW_BYTES[np.minimum(size, 8)]
    one = mix(first ^ size.astype(np.uint64) * _ODD)
    two = mix(first * _ODD2 + size.astype(np.uint64) * _SECOND) if wide else None
    left = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    for k in range(8, LONG_WORD, 8):
        left = left[size[left] > k]
        if not len(left):
            break
        more = numbers[start[left] + k] & LOW_BYTES[np.minimum(size[left] - k, 8)]
        one[left] = mix(one[left] * _ODD2 ^ more)
        if wide:
            two[left] = mix(two[left] * _SECOND + mix(more + _ODD))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest()
        one[i] = int.from_bytes(digest[:8], "little")
        if wide:
            two[i] = int.from_bytes(digest[8:], "little")
    return one, two


class Words(NamedTuple):
    """Words of a block: 64-bit hash, byte range, for each document the range of its words, and a second hash if asked."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(documents) + 1
    second: np.ndarray | None = None


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive documents of a column: first, last + 1, their bytes, offsets from 0. At least one document each."""
    data, offsets = string_parts(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM, heads: tuple[int, ...] = (), fold: bool = True, wide: bool = False) -> Words | tuple[Words, list[np.ndarray]]:
    """Maximal runs of the bytes in ``table``, within documents; hashed with A-Z lower-cased if ``fold``.

    With ``heads``, also for each number of bytes, 8 at most, the hashes of the words' first bytes; 0 for words not longer.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        words = Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64), none.astype(np.uint64))
        return (words, [words.hash for _ in heads]) if heads else words
    inside = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    begins[at] = inside[at]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    folded = LOWER[data] if fold else data
    numbers = eights(folded)
    one, two = hash_ranges(folded, numbers, start, end, wide)
    words = Words(one, start, end, np.searchsorted(start, offsets), two)
    if not heads:
        return words
    first = numbers[start]
    return words, [np.where(end - start > k, mix((first & LOW_BYTES[k]) ^ np.uint64((k + 1) * int(_SECOND) & (1 << 64) - 1)), np.uint64(0)) for k in heads]


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words in each document, with each document's range of them.

    A document of fewer words, but not none, is one shingle of all its words.
    """
    count = np.diff(words.first)
    each = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    first = np.zeros(len(count) + 1, np.int64)
    np.cumsum(each, out=first[1:])
    at = np.repeat(words.first[:-1] - first[:-1], each) + np.arange(first[-1])
    h = np.concatenate([words.hash, np.zeros(width, np.uint64)])
    left = np.repeat(words.first[1:], each) - at
    out = np.zeros(first[-1], np.uint64)
    for k in range(width):
        out = out * _ODD2 + np.where(left > k, h[at + k], np.uint64(0))
    return mix(out), first
