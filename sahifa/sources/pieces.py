"""Arrow batches a piece at a time, so that the memory of a Python worker doesn't follow the rows or the text of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker takes about this many bytes of text, and this many rows, at a time; a single longer text is one piece.
PIECE_BYTES, PIECE_ROWS = 512 << 10, 2048


def bounds(columns: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of every piece of a batch, by the bytes of its texts."""
    rows = len(columns[0])
    size = np.zeros(rows, np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while True:
        before = ends[at - 1] if at else 0
        to = min(rows, at + PIECE_ROWS, max(at + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right"))))
        yield at, to
        at = to
        if at >= rows:
            return


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in bounds(batch.columns):
            yield batch.slice(a, b - a)


def by_row(f: Callable, to: pa.DataType) -> Callable:
    """f, which takes a row's values, as a function of an iterator UDF: its results go out a piece at a time."""

    # One column comes as it is, several as a tuple; Spark goes by these types.
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for a, b in bounds(columns):
                rows = zip(*(c.slice(a, b - a).to_pylist() for c in columns))
                yield pa.array([f(*row) for row in rows], to)

    return run
