"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components, put in order of falling weight in the queries, are dealt to LISTS lists; a list holds the partial
inner products of its components. The phases:

1. Each task gathers, for each query, the best k entries of the first list over its own vectors, and their whole scores.
   The k-th best of all tasks' is a safe cutoff: k scores are known to reach it.
2. The cutoffs are broadcast. A task goes through the lists; what a score can still gain is bounded by the norms of the
   lists to come, and entries that can't reach the cutoff any more are dropped, so only the others are multiplied on.
3. The whole scores that are left are exact; those that reach the cutoff are collected, and the best k of each query stay.

Queries come in blocks of at most about QUERY_BLOCK vectors, so what is broadcast has a fixed size, and each block is a pass
over the vectors whose result is written. A task holds VECTOR_BLOCK vectors and multiplies PAIRS single entries at a time, and hands over k rows a query at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import in_batches, stored

SCALE, LISTS = 256, 4
QUERY_BLOCK, VECTOR_BLOCK, PAIRS = 4096, 2048, 1 << 17
_OUT = "query_id long, vec_id long, score long"


def _grid(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and floor(256 * x) of the vectors of that length that are whole; null ids are left out."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    there = ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False)
    offsets = np.asarray(vectors.offsets, np.int64)
    values = vectors.values
    bad = ~values.is_valid().to_numpy(zero_copy_only=False)
    x = values.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    bad |= ~np.isfinite(x)
    bads = np.concatenate([[0], np.cumsum(bad)])
    there &= bads[offsets[1:]] == bads[offsets[:-1]]
    size = np.diff(offsets)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {}
    with np.errstate(over="ignore"):
        for n in np.unique(size[there]):
            rows = np.flatnonzero(there & (size == n))
            out[int(n)] = number[rows], np.floor(SCALE * x[offsets[rows][:, None] + np.arange(n)])
    return out


def _dots(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of single pairs of rows."""
    return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", a[row[i : i + PAIRS]], b[col[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)]])


class Queries:
    """A block of queries of one length, their components in the order of the lists."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray):
        self.names = names
        self.order = np.argsort(-np.minimum(np.abs(vectors), 1e100).sum(0), kind="stable")
        self.vectors = np.ascontiguousarray(vectors[:, self.order])
        self.cuts = np.linspace(0, vectors.shape[1], LISTS + 1).astype(int)
        self.most = np.abs(vectors).max(initial=0)

    def lists(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The components of queries and vectors in each list."""
        vectors = vectors[:, self.order]
        return [(self.vectors[:, a:b], vectors[:, a:b]) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def exact(self, vectors: np.ndarray) -> bool:
        """Whether doubles hold every sum exactly."""
        most = max(self.most, np.abs(vectors).max(initial=0))
        return bool(most * most * max(1, vectors.shape[1]) < 2**53)


def _whole(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of all queries and vectors in whole numbers of any size, as 64-bit numbers; what is beyond them
    becomes the nearest, and an infinite component the largest that a double holds."""
    integers = lambda m: np.array([[int(v) for v in row] for row in np.clip(m, -1.7e308, 1.7e308)], object).reshape(m.shape)
    if not queries.shape[1]:
        return np.zeros((len(queries), len(vectors)), np.int64)
    scores = integers(queries) @ integers(vectors).T
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in scores.ravel()], np.int64).reshape(scores.shape)


def gather(q: Queries, vec: np.ndarray, x: np.ndarray, k: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """Queries, vectors and whole scores of the best k entries of each query's first list; and components multiplied."""
    own = q.names[:, None] == vec[None, :]
    if not q.exact(x):
        row, col = np.nonzero(~own)
        return (q.names[row], vec[col], _whole(q.vectors, x[:, q.order])[row, col]), own.size * x.shape[1]
    lists = q.lists(x)
    part = lists[0][0] @ lists[0][1].T
    part[own] = -np.inf
    m = min(k, len(vec))
    col = np.argpartition(-part, m - 1, axis=1)[:, :m].ravel()
    row = np.repeat(np.arange(len(q.names)), m)
    ok = ~own[row, col]
    row, col = row[ok], col[ok]
    score = part[row, col]
    for a, b in lists[1:]:
        score = score + _dots(a, b, row, col)
    return (q.names[row], vec[col], score.astype(np.int64)), own.size * lists[0][0].shape[1] + len(row) * sum(a.shape[1] for a, _ in lists[1:])


def resolve(q: Queries, cut: np.ndarray, vec: np.ndarray, x: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """Queries, vectors and scores of at least the cutoff, -2**63 for none; and components multiplied."""
    own = q.names[:, None] == vec[None, :]
    if not q.exact(x):
        score = _whole(q.vectors, x[:, q.order])
        row, col = np.nonzero(~own & (score >= cut[:, None]))
        return (q.names[row], vec[col], score[row, col]), own.size * x.shape[1]
    lists = q.lists(x)
    rest = [(np.sqrt(sum((a * a).sum(1) for a, _ in lists[i:])), np.sqrt(sum((b * b).sum(1) for _, b in lists[i:]))) for i in range(1, LISTS)]
    need = cut.astype(float)
    need -= np.abs(need) * 1e-9 + 1  # below the cutoff, so that rounding of norms drops nothing
    score = lists[0][0] @ lists[0][1].T
    work = score.size * lists[0][0].shape[1]
    row, col = np.nonzero((score + rest[0][0][:, None] * rest[0][1][None, :] >= need[:, None]) & ~own)
    score = score[row, col]
    for i, (a, b) in enumerate(lists[1:], 1):
        if 2 * len(row) > own.size:  # most entries are left: one product of matrices costs less than its parts
            score = score + (a @ b.T)[row, col]
            work += own.size * a.shape[1]
        else:
            score = score + _dots(a, b, row, col)
            work += len(row) * a.shape[1]
        if i < LISTS - 1:
            left = score + rest[i][0][row] * rest[i][1][col] >= need[row]
            row, col, score = row[left], col[left], score[left]
    score = score.astype(np.int64)
    ok = score >= cut[row]
    return (q.names[row[ok]], vec[col[ok]], score[ok]), work


class _Best:
    """The k best (score, then smaller id) of each query so far; rows that repeat count each."""

    def __init__(self, k: int):
        self.k, self.rows = k, (np.zeros(0, np.int64),) * 3

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        q, v, s = (np.concatenate(x) for x in zip(self.rows, (query, vec, score), strict=True))
        order = np.lexsort((v, ~s, q))  # ~s falls as s rises, for every 64-bit number
        q, v, s = q[order], v[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.rows = q[keep], v[keep], s[keep]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in self.rows], names=["query_id", "vec_id", "score"])


def _search(queries, k, phase):
    """A task: the best k of each query over its vectors, in blocks; ``phase`` gives a block's entries."""

    def run(batches):
        best = _Best(k)
        for batch in batches:
            for i in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(i, VECTOR_BLOCK)
                for n, (vec, x) in _grid(part.column(0), pa.concat_arrays([part.column(1)])).items():
                    if n in queries.value:
                        best.add(*phase(queries.value[n], vec, x)[0])
        yield best.batch()

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best inner products over all other rows, ties to the smaller id.

    Components become floor(256 * x). Vectors that are null or hold a null or non-finite component take no part, nor do
    rows without an id, and vectors of another length than the query's. Every row is a candidate: rows that repeat an id
    count each, except a query's own id. Where several query rows have one id, its best are those of all these rows
    together. Scores beyond 64 bits become the nearest 64-bit number. Other columns don't matter.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    wanted = df.where(is_query).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id is not null and v is not null")
    parts = max(1, -(-wanted.count() // QUERY_BLOCK))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for part in range(parts):
        table = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).toArrow()
        block = _grid(table["vec_id"].combine_chunks(), table["v"].combine_chunks()) if table.num_rows else {}
        queries = spark.sparkContext.broadcast({n: Queries(*x) for n, x in block.items()})
        lists = in_batches(rows, _search(queries, k, lambda q, vec, x: gather(q, vec, x, k)), _OUT).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        reached = lists.groupBy("query_id").agg(F.min("score").alias("cut"), F.count("*").alias("n")).where(F.col("n") == k)
        cutoffs = spark.sparkContext.broadcast({r["query_id"]: r["cut"] for r in reached.select("query_id", "cut").collect()})

        def collect(q: Queries, vec: np.ndarray, x: np.ndarray, cutoffs=cutoffs):
            return resolve(q, np.array([cutoffs.value.get(int(i), -(2**63)) for i in q.names], np.int64), vec, x)

        best = in_batches(rows, _search(queries, k, collect), _OUT).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        if parts > 1:
            best = stored(best, "topk")
        found = best if found is None else found.unionByName(best)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
