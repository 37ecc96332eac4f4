"""Words and their 64-bit digests, for whole Arrow batches at once.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage return, with A-Z lower-cased. Its digest is a
polynomial over Z/2^64 of per-byte random values, finished by a mixing step; all words of a batch are hashed by sums over the text
buffer. Equal words have equal digests everywhere; that different words share one is neglected (64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEED = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_VALUE[~_IS_WORD] = 0
#: Bytes of text hashed at a time, unless one text is longer.
CHUNK = 1 << 18

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, CHUNK), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), bounds


def chunks(bounds: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about ``size`` bytes."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


def word_starts(raw: np.ndarray, rel: np.ndarray) -> np.ndarray:
    """Where the words of the texts raw[rel[i]:rel[i + 1]] begin."""
    word = _IS_WORD[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = rel[1:-1]
    inner = inner[inner < len(raw)]
    begins[inner] = word[inner]
    return np.flatnonzero(begins)


def start_digests(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Digests of the words that begin at ``starts``. White space has no value, so a sum may run on to the next word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(raw))
    value = _VALUE[raw]
    value *= power[: len(raw)]
    return mix(np.add.reduceat(value, starts) * inverse[starts])


def word_digests(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words of the texts, and the number of words before each text (one more than there are texts)."""
    raw, rel = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    starts = word_starts(raw, rel)
    return start_digests(raw, starts), np.searchsorted(starts, rel)


_PLACE = (_SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def shingles(words: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of runs of ``width`` words, and their number before each text.

    A text of fewer words, but at least one, has one shingle: all its words.
    """
    counts = np.diff(before)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - before[:-1], n)
    end = np.repeat(before[1:], n)
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total += np.where(at + k < end, padded[at + k], np.uint64(0)) * _PLACE[k]
    return mix(total + np.uint64(width)), offsets


def binary(rows: list[bytes] | np.ndarray) -> pa.Array:
    return pa.array(rows, pa.binary())


def packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Runs of ``values`` as a binary column; ``offsets`` count values."""
    ends = (np.asarray(offsets, np.int64) * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]
    ).cast(pa.binary())


def unpacked(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Undo :func:`packed`: values and offsets, counted in values."""
    data, bounds = text_buffer(column)
    size = np.dtype(dtype).itemsize
    raw = data[bounds[0] : bounds[-1]]
    return np.frombuffer(raw.tobytes(), dtype), (bounds - bounds[0]) // size


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` (an integer column) as tables that hold every group whole."""
    pending: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        tail = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
        if tail == 0:  # one key throughout
            if pending and last != keys[-1]:
                yield pa.concat_tables(pending).combine_chunks()
                pending = []
            pending.append(table)
        else:
            yield pa.concat_tables([*pending, table.slice(0, tail)]).combine_chunks()
            pending = [table.slice(tail)]
        last = keys[-1]
    if pending:
        yield pa.concat_tables(pending).combine_chunks()


def runs(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys: starts, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
