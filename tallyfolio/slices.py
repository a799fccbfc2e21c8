"""Arrow batches cut into slices, so that few values are Python objects at a time, whatever the size of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS = 1 << 20, 1_000


def _is_long(kind: pa.DataType) -> bool:
    return any(test(kind) for test in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary))


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, about ``most`` bytes of texts and contents (or one longer row) and at most ``rows`` at a time."""
    held = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if _is_long(column.type):
            held += np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    ends, begin = np.cumsum(held), 0
    while begin < batch.num_rows:
        before = int(ends[begin - 1]) if begin else 0
        end = min(begin + rows, max(begin + 1, int(np.searchsorted(ends, before + most, side="right"))), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end
    pa.default_memory_pool().release_unused()


def all_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, most, rows)


def column_slices(batches: Iterator[tuple[pa.Array, ...]], most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[list[list]]:
    """As ``all_slices`` for the arguments of an Arrow function: the values of each argument, as Python objects."""
    for arrays in batches:
        batch = pa.RecordBatch.from_arrays(list(arrays), names=[str(i) for i in range(len(arrays))])
        for some in slices(batch, most, rows):
            yield [column.to_pylist() for column in some.columns]
