"""Arrow column <-> numpy helpers used inside ``mapInArrow`` functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _offsets(column) -> np.ndarray:
    return np.asarray(column.offsets)


def list_matrix(column, dtype=np.float64) -> np.ndarray:
    """List column as an (n, dim) matrix.

    ``flatten`` respects slice offsets; a NULL or ragged row would silently shift every later
    row of the reshape, and a NaN would make every comparison of its block false, so all of them are
    refused here (filter them with ``is_valid_vector`` first).
    """
    n = len(column)
    if column.null_count:
        raise ValueError("NULL vector reached a kernel; filter invalid vectors first")
    flat = column.flatten()
    if n == 0:
        return np.zeros((0, 0), dtype)
    widths = np.diff(_offsets(column))
    if widths.min() != widths.max():
        raise ValueError("vectors of different length reached a kernel; filter invalid vectors first")
    if flat.null_count:
        raise ValueError("NULL component reached a kernel; filter invalid vectors first")
    matrix = flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, -1)
    if not np.isfinite(matrix).all():
        bad = int((~np.isfinite(matrix).all(axis=1)).sum())
        raise ValueError(f"{bad} of {n} vectors with NaN or infinite components reached a kernel; filter invalid vectors first")
    return matrix


def code_matrix(column) -> np.ndarray:
    """Binary column of equally long 8-bit codes as an (n, dim) uint8 matrix, without copying."""
    n = len(column)
    if column.null_count:
        raise ValueError("NULL code reached a kernel")
    if n == 0:
        return np.zeros((0, 0), np.uint8)
    offset_type = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], offset_type)[column.offset : column.offset + n + 1]
    widths = np.diff(offsets)
    if widths.min() != widths.max():
        raise ValueError("codes of different length reached a kernel")
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(n, -1)


def matrix_list(matrix: np.ndarray, arrow_type: pa.DataType) -> pa.Array:
    """(n, dim) matrix as a list column."""
    n, dim = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32) if dim else np.zeros(n + 1, np.int32))
    values = pa.array(np.ascontiguousarray(matrix).reshape(-1), type=arrow_type)
    return pa.ListArray.from_arrays(offsets, values)


def code_binary(codes: np.ndarray) -> pa.Array:
    """(n, dim) uint8 matrix as a binary column."""
    n, dim = codes.shape
    offsets = np.arange(0, (n + 1) * dim, dim, dtype=np.int32) if dim else np.zeros(n + 1, np.int32)
    data = pa.py_buffer(np.ascontiguousarray(codes).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), data])


def int_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        raise ValueError(f"NULL in key column {name}")
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def key_groups(columns: list[np.ndarray], n: int):
    """Yield ``(key tuple, row indexes)`` for every distinct combination of the key columns."""
    if not columns:
        yield (), np.arange(n)
        return
    if n == 0:
        return
    order = np.lexsort(columns[::-1])
    changed = np.zeros(n, bool)
    changed[0] = True
    for c in columns:
        s = c[order]
        changed[1:] |= s[1:] != s[:-1]
    starts = np.flatnonzero(changed)
    for a, b in zip(starts, np.append(starts[1:], n)):
        rows = order[a:b]
        yield tuple(int(c[rows[0]]) for c in columns), rows


def combine_arrays(batches, keys: list[str], count: str | None, arrays: dict, hold_bytes: int | None = None):
    """Reduce rows with equal keys: add up ``count``, combine the DOUBLE array columns element-wise.

    ``arrays`` maps column names to numpy ufuncs (``np.add``, ``np.minimum`` ...). With ``hold_bytes``
    the state is emitted whenever it outgrows that size: right before a shuffle, where a later
    combination follows; not after it.
    """
    names = [*keys, *([count] if count else []), *arrays]
    held: dict[tuple, list] = {}

    def drain():
        columns = [pa.array([key[i] for key in held], pa.int32()) for i in range(len(keys))]
        if count:
            columns.append(pa.array([entry[0] for entry in held.values()], pa.int64()))
        for i in range(len(arrays)):
            columns.append(matrix_list(np.stack([entry[1 + i] for entry in held.values()]), pa.float64()))
        yield pa.RecordBatch.from_arrays(columns, names)
        held.clear()

    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        matrices = [list_matrix(batch.column(batch.schema.get_field_index(c))) for c in arrays]
        counts = int_column(batch, count) if count else None
        for key, rows in key_groups([int_column(batch, c) for c in keys], batch.num_rows):
            entry = held.get(key)
            parts = [op.reduce(m[rows], axis=0) for m, op in zip(matrices, arrays.values())]
            n = int(counts[rows].sum()) if count else 0
            if entry is None:
                held[key] = [n, *parts]
                size += sum(p.nbytes for p in parts)
                continue
            entry[0] += n
            for i, op in enumerate(arrays.values()):
                entry[1 + i] = op(entry[1 + i], parts[i])
        if hold_bytes is not None and size > hold_bytes:
            yield from drain()
            size = 0
    if held:
        yield from drain()
