"""Helpers for kernels over sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def changes(columns: list) -> np.ndarray:
    """Where a row's key differs from that of the row before; the first row counts as one that does."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        codes = c.dictionary_encode() if isinstance(c, pa.Array) else c.combine_chunks().dictionary_encode()
        if isinstance(codes, pa.ChunkedArray):
            codes = codes.combine_chunks()
        at = codes.indices.to_numpy(zero_copy_only=False)
        out[1:] |= at[1:] != at[:-1]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables that hold every group whole; rows come sorted by the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = batch.columns[:keys]
        if held and last != tuple(c[0].as_py() for c in columns):
            yield pa.Table.from_batches(held)
            held = []
        start = int(np.nonzero(changes(columns))[0][-1])
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = [batch.slice(start)]
        else:
            held.append(batch)
        last = tuple(c[n - 1].as_py() for c in columns)
    if held:
        yield pa.Table.from_batches(held)
