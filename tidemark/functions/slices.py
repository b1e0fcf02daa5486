"""Arrow batches handed to Python a few rows at a time: a task holds one slice as objects, however long the batch is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

ROWS = 64


def slices(batch: pa.Array | pa.RecordBatch, rows: int = ROWS) -> Iterator:
    """The batch as consecutive views of at most ``rows`` rows."""
    return (batch.slice(at, rows) for at in range(0, len(batch), rows))


def mapped(values: pa.Array, function: Callable, kind: pa.DataType, rows: int = ROWS) -> pa.Array:
    """``function`` of every value, slice by slice, as one array of the given type."""
    parts = [pa.array([function(v) for v in part.to_pylist()], kind) for part in slices(values, rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
