"""Token counts of a SentencePiece model, without a shuffle of pre-tokens.

A pre-token is a chunk of the text that no piece crosses (see :mod:`._pieces`). Two tiers, both at the map side:

1. A compact table (pre-token, number of tokens) of the corpus's most frequent pre-tokens is broadcast; ``HEAD`` of them at
   most, none longer than 64 bytes. It comes from a pass over all texts, in which each task keeps a bounded list of its frequent pre-tokens.
2. Misses are encoded by the library, each distinct one once, and kept in a cache of the Python worker, also bounded.

Neither tier changes a count: both hold what the library gives, and a pre-token that is found by its hash counts only if
its bytes are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._pieces import Chunks, ChunkTable, chunk_bounds, distinct, encode_chunks, marks_as_spaces, vocabulary
from ._shared import in_batches
from ._text import blocks, eights, worker_cache

#: Entries of the broadcast table, of a task's list, and of a worker's cache.
HEAD, TASK_HEAD, CACHE = 1 << 16, 1 << 12, 1 << 20
_cache: dict[str, ChunkTable] = {}


def frequent(df: DataFrame, path: str, text: str = "text", size: int = HEAD) -> ChunkTable:
    """Token counts of frequent pre-tokens of all texts; at most ``size``."""

    def run(batches):
        seen: dict[int, list] = {}
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                chunks = chunk_bounds(*marks_as_spaces(data, offsets))
                keys, one, count = np.unique(chunks.key, return_index=True, return_counts=True)
                often = (count >= 4) & (chunks.end[one] - chunks.begin[one] <= 64)  # a word that matters occurs so often in some block
                keys, one, count = keys[often], one[often], count[often]
                for k, n, t in zip(keys.tolist(), count.tolist(), chunks.texts(one), strict=True):
                    if k in seen:
                        seen[k][0] += n
                    else:
                        seen[k] = [n, t]
                if len(seen) > 16 * TASK_HEAD:
                    seen = dict(sorted(seen.items(), key=lambda x: -x[1][0])[: 4 * TASK_HEAD])
        top = sorted(seen.items(), key=lambda x: (-x[1][0], x[0]))[:TASK_HEAD]
        if top:
            texts = [t for _, (_, t) in top]
            lengths = [len(x) for x in encode_chunks(path, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([k for k, _ in top], np.uint64).view(np.int64)), pa.array([n for _, (n, _) in top], pa.int64()), pa.array(lengths, pa.int32()), pa.array(texts, pa.string())], names=["h", "n", "tokens", "chunk"])

    rows = in_batches(df.select(F.col(text).cast("string")), run, "h long, n long, tokens int, chunk string")
    ranked = rows.groupBy("h").agg(F.sum("n").alias("n"), F.min(F.struct("chunk", "tokens")).alias("t")).orderBy(F.desc("n"), "h").limit(size)
    top = ranked.select("h", "t.tokens", "t.chunk").toArrow()
    table = ChunkTable()
    if top.num_rows:
        raw = [t.encode() for t in top["chunk"].to_pylist()]
        ends = np.cumsum([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        chunks = Chunks(top["h"].to_numpy().view(np.uint64), np.concatenate([[0], ends[:-1]]), ends, np.zeros(0, np.int64), data, eights(data))
        table.add(chunks, np.arange(len(raw)), top["tokens"].to_numpy().astype(np.int64))
    return table


def count_tokens(df: DataFrame, path: str, text: str = "text", head: ChunkTable | None = None) -> DataFrame:
    """``df`` without ``text``, with n_bytes and n_tokens (long); a null text counts as empty, with 0 of both.

    ``path``: a model file that every machine has. Columns of ``df`` of the new names are replaced. Very long texts are
    whole blocks of their own; rows that repeat give rows that repeat.
    """
    made = ["n_bytes", "n_tokens"]
    df = df.drop(*made)
    names = [c for c in df.columns if c != text]
    vocabulary(path)  # checks that the model can be applied by chunk
    sent = df.sparkSession.sparkContext.broadcast(frequent(df, path, text) if head is None else head)

    def lengths(texts: list[str]) -> np.ndarray:
        return np.array([len(x) for x in encode_chunks(path, texts)], np.int64)

    def run(batches):
        table = sent.value
        for batch in batches:
            sizes, totals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in blocks(batch.column(batch.num_columns - 1)):
                sizes.append(np.diff(offsets))
                chunks = chunk_bounds(*marks_as_spaces(data, offsets))
                at, known = table.find(chunks, np.arange(len(chunks.key)))
                length = np.zeros(len(chunks.key), np.int64)
                length[known] = table.values[at[known], 0]
                if len(miss := np.flatnonzero(~known)):
                    one, back, _, odd = distinct(chunks, miss)
                    cache = worker_cache("tokens", _cache).get(path)
                    if cache is None or len(cache.key) > CACHE:
                        cache = _cache[path] = ChunkTable()
                    at, cached = cache.find(chunks, one)
                    got = np.zeros(len(one), np.int64)
                    got[cached] = cache.values[at[cached], 0]
                    if len(new := np.flatnonzero(~cached)):
                        got[new] = lengths(chunks.texts(one[new]))
                        cache.add(chunks, one[new], got[new])
                    length[miss] = got[back]
                    if len(odd):
                        length[odd] = lengths(chunks.texts(odd))
                sums = np.concatenate([[0], np.cumsum(length)])
                totals.append(sums[chunks.first[1:]] - sums[chunks.first[:-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(sizes)), pa.array(np.concatenate(totals))], names=[*batch.schema.names[:-1], *made])

    kept = df.select(*[F.col(f"`{n}`") for n in names])
    return in_batches(df.select(*[F.col(f"`{n}`") for n in names], F.col(text).cast("string").alias("__text")), run, kept.schema.add("n_bytes", "long").add("n_tokens", "long"))
