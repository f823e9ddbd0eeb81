"""SentencePiece encoding by streaming Viterbi, and decoding.

The ids of a text are the pieces of the segmentation with the highest total score (of equal ones, that whose last piece is
the longest, then the same for what precedes it); a character that no piece covers becomes its UTF-8 bytes. Two
forms of one recursion:

* :class:`Stream` reads a text character by character. Boundaries survive from which a piece can still reach the next
  character; no more than ``longest`` of them do. Scores and backpointers are kept since the last commit. When
  the backpointer paths from all surviving boundaries meet in one boundary, the ids up to it are committed and forgotten;
  that is looked for every ``STEP`` characters, or less often while it fails.
* A boundary before U+2581 that follows another character is crossed by no piece: all paths meet there. So chunks
  between such boundaries are independent, and the distinct chunks of a block advance together in numpy lanes. Chunks
  of more than ``LANE`` characters go through :class:`Stream`.

Pieces are found by walking the trie of their characters, so a match is exact; chunks that are met again are found by hash
and count as the same if their bytes are.

The scores are those in the model file. In a file of the BPE kind they are merge ranks; the library's merge order gives
other ids for some words, this gives what the library gives for the same pieces in its unigram mode.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types

from ._pieces import MARK, Chunks, ChunkTable, chunk_bounds, distinct, marks_as_spaces, vocabulary
from ._shared import in_batches
from ._text import _ODD, blocks, worker_cache

LANE, STEP = 32, 16
#: Chunks that a Python worker remembers.
CACHE = 1 << 18
_SLOT_BITS = 20
_FREE = np.uint64((1 << 64) - 1)


class Trie(NamedTuple):
    """Pieces by their characters: ``step`` of node << 21 | character is the next node, ``piece`` a node's id or -1.

    ``key`` and ``value`` hold the same steps in open addressing, for many look-ups at once.
    """

    step: dict[int, int]
    piece: list[int]
    key: np.ndarray
    value: np.ndarray
    pieces: np.ndarray

    def follow(self, node: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where there is none."""
        want = node.astype(np.uint64) << np.uint64(21) | points.astype(np.uint64)
        slot = _slot(want)
        got = self.key[slot]
        out = np.where(got == want, self.value[slot], -1)
        more = np.flatnonzero((got != want) & (got != _FREE))
        while len(more):
            slot[more] = slot[more] + 1 & (1 << _SLOT_BITS) - 1
            got = self.key[slot[more]]
            hit = got == want[more]
            out[more[hit]] = self.value[slot[more[hit]]]
            more = more[~hit & (got != _FREE)]
        return out


def _slot(key: np.ndarray) -> np.ndarray:
    return (key * _ODD >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


@lru_cache(4)
def trie(path: str) -> Trie:
    step: dict[int, int] = {}
    piece = [-1]
    for name, i in vocabulary(path).ids.items():
        node = 0
        for c in name:
            key = node << 21 | ord(c)
            if (after := step.get(key)) is None:
                after = step[key] = len(piece)
                piece.append(-1)
            node = after
        piece[node] = i
    if 2 * len(step) > 1 << _SLOT_BITS:
        raise ValueError("the model has too many pieces")
    keys, values = np.fromiter(step, np.uint64), np.fromiter(step.values(), np.int64)
    table, value = np.full(1 << _SLOT_BITS, _FREE), np.zeros(1 << _SLOT_BITS, np.int64)
    slot = _slot(keys)
    while len(keys):
        _, first = np.unique(slot, return_index=True)
        first = first[table[slot[first]] == _FREE]
        table[slot[first]], value[slot[first]] = keys[first], values[first]
        left = np.ones(len(keys), bool)
        left[first] = False
        keys, values, slot = keys[left], values[left], slot[left] + 1 & (1 << _SLOT_BITS) - 1
    return Trie(step, piece, table, value, np.array(piece))


class Stream:
    """Viterbi over characters that arrive one by one; :meth:`feed` and :meth:`close` return ids as they are certain."""

    def __init__(self, path: str):
        self.v, self.trie = vocabulary(path), trie(path)
        self.scores = self.v.scores.tolist()
        self.chars: list[str] = []  # since the last commit
        self.score: list[float] = [0.0]  # of the boundaries since the last commit
        self.back: list[int] = [0]  # length of the piece that ends at a boundary
        self.walks: list[tuple[int, int]] = []  # boundaries from which a piece may go on, and the nodes reached
        self.look = STEP
        self.most = 0  # most characters ever held

    def feed(self, char: str) -> list[int]:
        self.chars.append(char)
        n, point, step, piece = len(self.chars), ord(char), self.trie.step, self.trie.piece
        self.most = max(self.most, n)
        best, back, walks = -np.inf, 0, []
        for at, node in (*self.walks, (n - 1, 0)):
            after = step.get(node << 21 | point)
            i = -1
            if after is not None:
                walks.append((at, after))
                i = piece[after]
            if i >= 0:
                total = self.score[at] + self.scores[i]
            elif at == n - 1:
                total = self.score[at] + self.v.unknown
            else:
                continue
            if total > best:
                best, back = total, n - at
        self.walks = walks
        self.score.append(best)
        self.back.append(back)
        if n < self.look:
            return []
        live = {at for at, _ in walks} | {n}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(top - self.back[top] if top else 0)
        ids = self._commit(live.pop())
        self.look = max(STEP, 2 * len(self.chars))
        return ids

    def close(self) -> list[int]:
        return self._commit(len(self.chars))

    def _commit(self, boundary: int) -> list[int]:
        ids: list[int] = []
        at = boundary
        while at > 0:
            piece = "".join(self.chars[at - self.back[at] : at])
            i = self.v.ids.get(piece)
            ids += [i] if i is not None else self.v.byte_ids[list(piece.encode())[::-1]].tolist()
            at -= self.back[at]
        if boundary:
            base = self.score[boundary]
            self.chars, self.back = self.chars[boundary:], [0, *self.back[boundary + 1 :]]
            self.score = [s - base for s in self.score[boundary:]]
            self.walks = [(at - boundary, node) for at, node in self.walks if at >= boundary]
        return ids[::-1]


def encode_stream(text: str, path: str) -> list[int]:
    """Ids of one text, streamed."""
    stream, ids = Stream(path), []
    for c in (MARK + text.replace(" ", MARK)) if text else "":
        ids += stream.feed(c)
    return ids + stream.close()


def _lanes(points: np.ndarray, start: np.ndarray, size: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of chunks (ranges of code points), one after the other, and how many each has."""
    v, pieces, most = vocabulary(path), trie(path), int(size.max())
    # Edges: pieces (id, -1: unknown character) by the point at which they begin.
    live = _ragged(start, size)
    lane_of = np.repeat(np.arange(len(size)), size)
    step_of, stop = live - start[lane_of], (start + size)[lane_of]
    base = np.cumsum(size + 1) - size - 1  # a lane's boundary 0
    from_ = base[lane_of] + step_of
    known, node = np.arange(len(live)), np.zeros(len(live), np.int64)
    edges = []
    for k in range(1, v.longest + 1):
        inside = live[known] + k <= stop[known]
        known, node = known[inside], node[inside]
        node = pieces.follow(node, points[live[known] + k - 1])
        known, node = known[node >= 0], node[node >= 0]
        place = pieces.pieces[node]
        ok = place >= 0
        edges.append((known[ok], place[ok], np.full(int(ok.sum()), k, np.int8)))
        if k == 1:
            lost = np.ones(len(live), bool)
            lost[edges[0][0]] = False
            lost = np.flatnonzero(lost)
            edges.append((lost, np.full(len(lost), -1), np.ones(len(lost), np.int8)))
        if not len(known):
            break
    edge, place, width = (np.concatenate(x) for x in zip(*edges, strict=True))
    step = step_of[edge].astype(np.int16)
    sort = np.argsort(step, kind="stable")
    edge, place, width = edge[sort], place[sort], width[sort]
    gain = np.where(place >= 0, v.scores[place], v.unknown)
    source = from_[edge]
    target = source + width
    first = np.searchsorted(step[sort], np.arange(most + 1))
    score = np.full(int((size + 1).sum()), -np.inf)
    score[base] = 0
    by = np.zeros(len(score), np.int64)  # the edge
    for i in range(most):  # edges of one step and lane end at different boundaries
        a, b = first[i], first[i + 1]
        cand, to = score[source[a:b]] + gain[a:b], target[a:b]
        better = np.flatnonzero(cand > score[to])
        to = to[better]
        score[to], by[to] = cand[better], better + a
    back, by = width[by], place[by]
    order = np.arange(len(size))
    # Walk back from each lane's end; step t holds the t-th last piece.
    at, left = base + size, size.copy()
    live = np.arange(len(size))
    found_lane, found_id, found_step, found_at = [], [], [], []
    step = 0
    while len(live):
        pos = at[live]
        found_lane.append(live)
        found_id.append(by[pos])
        found_at.append(start[live] + left[live] - back[pos])
        found_step.append(np.full(len(live), step))
        at[live] -= back[pos]
        left[live] -= back[pos]
        live = live[left[live] > 0]
        step += 1
    lane, token, when, where = (np.concatenate(x) for x in (found_lane, found_id, found_step, found_at))
    sort = np.lexsort((-when, order[lane]))
    lane, token, where = order[lane[sort]], token[sort], where[sort]
    if (token < 0).any():  # unknown characters become bytes
        cp = points[where]
        width = np.where(token >= 0, 1, 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))
        lane_, token_ = np.repeat(lane, width), np.repeat(token, width)
        lost = np.flatnonzero(token < 0)
        raw = np.frombuffer("".join(map(chr, cp[lost].tolist())).encode(), np.uint8)
        token_[token_ < 0] = v.byte_ids[raw]
        lane, token = lane_, token_
    return token, np.bincount(lane, minlength=len(order))


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices of consecutive ranges, one after the other."""
    total = int(count.sum())
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)


class _Seen:
    """Ids of chunks that a worker has met more than once in a block; emptied when CACHE of them are held."""

    def __init__(self):
        self.table, self.ids = ChunkTable(2), np.zeros(0, np.int32)  # values: where, count

    def add(self, chunks: Chunks, rows: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """ids: those of all chunks, one after the other."""
        if len(self.table.key) + len(rows) > CACHE:
            self.__init__()
        self.table.add(chunks, rows, np.stack([np.cumsum(count) - count + len(self.ids), count], axis=1))
        self.ids = np.concatenate([self.ids, ids])


_seen: dict[str, _Seen] = {}


def _encode_chunks(data: np.ndarray, begin: np.ndarray, size: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct chunks, given without their first mark, one after the other, and how many each has."""
    raw = data[_ragged(begin, size)]
    lead = np.cumsum(np.concatenate([[0], (raw & 0xC0) != 0x80]))
    ends = np.cumsum(size)
    chars = lead[ends] - lead[ends - size] + 1
    points = np.empty(int(chars.sum()), np.uint32)
    start = np.cumsum(chars) - chars
    inner = np.ones(len(points), bool)
    inner[start] = False
    points[start] = ord(MARK)
    points[inner] = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    points[points == 0x20] = ord(MARK)
    count, where = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    short = np.flatnonzero(chars <= LANE)
    parts = []
    if len(short):
        ids, got = _lanes(points, start[short], chars[short], path)
        parts.append(ids)
        count[short] = got
        where[short] = np.cumsum(got) - got
    long = np.flatnonzero(chars > LANE)
    if not len(long):
        return parts[0].astype(np.int32), count
    done = len(parts[0]) if parts else 0
    for i in long:
        stream, ids = Stream(path), []
        for c in map(chr, points[start[i] : start[i] + chars[i]].tolist()):
            ids += stream.feed(c)
        ids += stream.close()
        parts.append(np.array(ids, np.int32))
        where[i], count[i] = done, len(ids)
        done += len(ids)
    return np.concatenate(parts)[_ragged(where, count)].astype(np.int32), count


def encode_block(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block of documents, one after the other, and their ranges."""
    chunks = chunk_bounds(*marks_as_spaces(data, offsets))
    if not len(chunks.key):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    seen = worker_cache("viterbi", _seen).setdefault(path, _Seen())
    at, known = seen.table.find(chunks, np.arange(len(chunks.key)))
    where, count = np.zeros((2, len(chunks.key)), np.int64)
    where[known], count[known] = seen.table.values[at[known]].T
    flat = seen.ids
    if len(miss := np.flatnonzero(~known)):
        one, back, often, odd = distinct(chunks, miss)
        rows = np.concatenate([one, odd])
        ids, each = _encode_chunks(chunks.data, chunks.begin[rows], chunks.end[rows] - chunks.begin[rows], path)
        place = np.cumsum(each) - each
        where[miss], count[miss] = place[back] + len(flat), each[back]
        where[odd], count[odd] = place[len(one) :] + len(flat), each[len(one) :]
        flat = np.concatenate([flat, ids])
        again = np.flatnonzero(often > 1)
        seen.add(chunks, one[again], each[again], ids[_ragged(place[again], each[again])])
    sums = np.concatenate([[0], np.cumsum(count)])
    return flat[_ragged(where, count)], sums[chunks.first]


@lru_cache(4)
def _spelling(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces one after the other, where each begins, and its length."""
    text = vocabulary(path).text
    size = np.array([len(t) for t in text])
    return np.frombuffer(b"".join(text), np.uint8), np.cumsum(size) - size, size


def decode_block(ids: np.ndarray, first: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of documents from their ids, and their ranges; the space before a text is taken off."""
    raw, begin, size = _spelling(path)
    each = size[ids]
    at = np.concatenate([[0], np.cumsum(each)])[first]
    out = raw[_ragged(begin[ids], each)]
    full = at[1:] > at[:-1]
    lead = at[:-1][full]
    lead = lead[out[lead] == 0x20]
    dropped = np.zeros(len(out) + 1, np.int64)
    dropped[lead + 1] = 1
    keep = np.ones(len(out), bool)
    keep[lead] = False
    return out[keep], at - np.cumsum(dropped)[at]


_COLUMNS = {"ids": types.ArrayType(types.IntegerType()), "n_ids": types.LongType(), "ids_crc32": types.LongType(), "round_trip": types.BooleanType()}


def encode(df: DataFrame, path: str, text: str = "text", columns: tuple[str, ...] = ("ids", "n_ids")) -> DataFrame:
    """``df`` without ``text``, with some of: ids; n_ids; ids_crc32, of the ids as little-endian 32-bit numbers;
    round_trip, whether decoding gives the text (U+2581 counting as the space it is encoded as).

    A null text counts as empty and has no ids. Columns of ``df`` of the new names are replaced.
    """
    df = df.drop(*columns)
    names = [c for c in df.columns if c != text]
    kept = df.select(*[F.col(f"`{n}`") for n in names])
    vocabulary(path)

    def run(batches):
        for batch in batches:
            texts, n = batch.column(batch.num_columns - 1), 0
            for i, j, data, offsets in blocks(texts):
                ids, first = encode_block(data, offsets, path)
                made = []
                for c in columns:
                    if c == "ids":
                        made.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())))
                    elif c == "n_ids":
                        made.append(pa.array(np.diff(first)))
                    elif c == "ids_crc32":
                        made.append(pa.array([zlib.crc32(ids[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.int64()))
                    else:
                        plain, at = marks_as_spaces(data, offsets)
                        out, to = decode_block(ids, first, path)
                        whole = len(out) == len(plain) and (to == at).all() and (out == plain).all()
                        made.append(pa.array([True] * (j - i) if whole else [bool(b - a == d - c_ and (out[a:b] == plain[c_:d]).all()) for a, b, c_, d in zip(to[:-1], to[1:], at[:-1], at[1:], strict=True)]))
                yield pa.RecordBatch.from_arrays([*[x.slice(i, j - i) for x in batch.columns[:-1]], *made], names=[*batch.schema.names[:-1], *columns])
                n = j

    schema = kept.schema
    for c in columns:
        schema = schema.add(c, _COLUMNS[c])
    return in_batches(df.select(*[F.col(f"`{n}`") for n in names], F.col(text).cast("string").alias("__text")), run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` without ``ids``, with the text they stand for; null for null, which is kept apart from no ids.

    Bytes that are no UTF-8 become U+FFFD, as the library does; ids that are null or outside of the vocabulary raise an
    error. A column of ``df`` called as ``text`` is replaced.
    """
    df = df.drop(text)
    names = [c for c in df.columns if c != ids]
    kept = df.select(*[F.col(f"`{n}`") for n in names])

    def texts(column: pa.Array) -> pa.Array:
        missing = column.is_null().to_numpy(zero_copy_only=False)
        own = column.flatten()
        if own.null_count:
            raise ValueError("an id is null")
        own = own.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(own) and not 0 <= own.min() <= own.max() < len(vocabulary(path).text):
            raise ValueError("an id is outside of the vocabulary")
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        raw, to = decode_block(own, np.concatenate([[0], np.cumsum(size)]), path)
        whole = raw.tobytes()
        begins = raw[to[:-1][to[:-1] < len(raw)]]
        try:
            whole.decode()
            good = not ((begins & 0xC0) == 0x80).any()  # no text begins within a character
        except UnicodeDecodeError:
            good = False
        if not good:
            return pa.array([None if m else whole[a:b].decode("utf-8", "replace") for m, a, b in zip(missing, to[:-1], to[1:], strict=True)], pa.string())
        valid = pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.large_string(), len(column), [valid, pa.py_buffer(to.astype(np.int64).tobytes()), pa.py_buffer(whole)]).cast(pa.string())

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts(batch.column(batch.num_columns - 1))], names=[*batch.schema.names[:-1], text])

    return in_batches(df.select(*[F.col(f"`{n}`") for n in names], F.col(ids).cast("array<int>").alias("__ids")), run, kept.schema.add(text, "string"))
