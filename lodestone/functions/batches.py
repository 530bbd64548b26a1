"""Many small groups at once in numpy: a group is a row with an array, and groups of one size are computed together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ROWS = 50_000
CELLS = 1 << 20


def tables(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = 1 << 26) -> Iterator[pa.Table]:
    """Record batches put together to tables of `rows` rows or `size` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Starts and lengths of an array column without nulls, and all its elements."""
    column = table[name].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    ends = column.offsets.to_numpy().astype(np.int64)
    return ends[:-1] - ends[0], np.diff(ends), column.flatten()


def numbers(a: pa.Array) -> np.ndarray:
    """As doubles, nulls as NaN."""
    return a.to_numpy(zero_copy_only=False).astype(float)


def alike(*sizes: np.ndarray, cells: int = CELLS, of=lambda *s: int(np.prod(s))) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(sizes, places) of the groups that have the same sizes, at most `cells` cells (`of` the sizes) at a time."""
    shapes, member = np.unique(np.stack(sizes, 1), axis=0, return_inverse=True)
    order = np.argsort(member.ravel(), kind="stable")
    for shape, at in zip(shapes.tolist(), np.split(order, np.cumsum(np.bincount(member.ravel(), minlength=len(shapes)))[:-1])):
        step = max(1, cells // max(1, of(*shape)))
        for i in range(0, len(at), step):
            yield tuple(shape), at[i : i + step]
