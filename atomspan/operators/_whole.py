"""Structures taken whole into Arrow tasks, many at a time: no call, batch or table for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row but the first differs from the one before; nulls and NaN equal themselves."""
    out = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        out |= np.diff(c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)) != 0
    return out


def starts(columns: list[pa.Array]) -> np.ndarray:
    """Where the structures of sorted rows begin, and the number of rows."""
    return np.concatenate([[0], np.flatnonzero(_changes(columns)) + 1, [len(columns[0])]])


def in_structures(dealt: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], run: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """What ``run`` gives for batches of whole structures, sorted by ``order``, and where each structure begins, and the number of
    rows. ``dealt``: rows of which a structure's are in one task, as after ``repartition(*keys)``. A batch is about as large as
    Spark makes them, or one structure."""
    n = len(keys)

    def stream(batches):
        held: list[pa.RecordBatch] = []
        whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            at = starts(batch.columns[:n])[:-1]
            if held:
                last = held[-1].slice(held[-1].num_rows - 1)
                same = not _changes([pa.concat_arrays([a, b.slice(0, 1)]) for a, b in zip(last.columns[:n], batch.columns[:n], strict=True)]).any()
                at = at[1:] if same else at
                if len(at) and (at[-1] or not same):
                    held.append(batch.slice(0, at[-1]))
                    done = whole()
                    yield from run(done, starts(done.columns[:n]))
                    held, batch = [], batch.slice(at[-1])
            elif at[-1]:
                done = batch.slice(0, at[-1])
                yield from run(done, starts(done.columns[:n]))
                batch = batch.slice(at[-1])
            held.append(batch)
        if held:
            done = whole()
            yield from run(done, starts(done.columns[:n]))

    rows = dealt.select(*keys, *[c for c in dealt.columns if c not in keys])
    return rows.sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)


def portions(cost: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """First and last + 1 of structures one after the other that cost ``most`` together, or of one that costs more."""
    total, at = np.concatenate([[0], np.cumsum(cost)]), 0
    while at < len(cost):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield at, end
        at = end
