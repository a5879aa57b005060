"""Sorted Arrow batches cut where a group of rows ends."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def group_numbers(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The number, from 0, of each row's group; a group's rows follow each other."""
    change = np.zeros(table.num_rows, bool)
    for c in keys:
        column = table.column(c)
        change[1:] |= pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)), True).to_numpy()
    return np.cumsum(change)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], size: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Some ``size`` rows at a time with the number of each row's group; a group's rows follow each other and stay together."""
    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            group = group_numbers(table, keys)
            whole = int(np.searchsorted(group, group[-1]))
            if whole:
                yield table.slice(0, whole), group[:whole]
            held = table.slice(whole).to_batches()
            rows = table.num_rows - whole
            size = max(size, 2 * rows)
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, group_numbers(table, keys)
