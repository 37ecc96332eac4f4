from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from conftest import brute_topk
from hypothesis import given, settings
from hypothesis import strategies as st

from vectorloom.functions.arrow import code_binary, code_matrix, combine_arrays, key_groups, list_matrix, matrix_list
from vectorloom.functions.kernels import (
    NO_ID,
    QueryBlock,
    block_topk,
    l2_as_product,
    merge_topk,
    sq8_decode,
    sq8_encode,
    with_constant,
)


@settings(max_examples=60, deadline=None)
@given(
    n=st.integers(1, 60), q=st.integers(1, 6), dim=st.integers(1, 8), k=st.integers(1, 9),
    seed=st.integers(0, 10_000), levels=st.integers(1, 4),
)
def test_block_topk_matches_brute_force_with_many_ties(n, q, dim, k, seed, levels):
    rng = np.random.default_rng(seed)
    items = rng.integers(-levels, levels + 1, (n, dim)).astype(float)
    queries = rng.integers(-levels, levels + 1, (q, dim)).astype(float)
    ids = rng.permutation(1000)[:n].astype(np.int64)
    _, found = block_topk(QueryBlock(queries), items, ids, k)
    got = [[int(i) for i in row if i != NO_ID] for row in found]
    assert got == brute_topk(queries, items, ids, k)


def test_block_topk_in_parts_equals_whole():
    rng = np.random.default_rng(1)
    items, queries = rng.normal(size=(3000, 16)), rng.normal(size=(700, 16))
    ids = np.arange(3000)
    block = QueryBlock(queries)
    whole = block_topk(block, items, ids, 7)
    part = block_topk(block, items[:1000], ids[:1000], 7)
    for a in (1000, 2000):
        more = block_topk(block, items[a : a + 1000], ids[a : a + 1000], 7, floor=part[0][:, -1])
        part = merge_topk(*part, *more)
    assert np.array_equal(whole[1], part[1])
    assert np.array_equal(whole[0], part[0])


def test_equal_vectors_tie_to_the_lower_id_wherever_they_lie():
    rng = np.random.default_rng(2)
    items = np.repeat(rng.normal(size=(1, 33)), 2500, axis=0)  # a hot group of copies
    ids = rng.permutation(2500)
    scores, found = block_topk(QueryBlock(rng.normal(size=(40, 33))), items, ids, 3)
    assert (found == [0, 1, 2]).all()
    assert (scores[:, 0] == scores[:, 2]).all()


def test_l2_as_product_finds_the_nearest():
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(200, 5)), rng.normal(size=(9, 5))
    _, found = block_topk(QueryBlock(with_constant(x)), l2_as_product(c), np.arange(9), 1)
    want = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.array_equal(found[:, 0], want)


def test_sq8_clips_and_handles_constant_dimensions():
    vmin, vdiff = np.array([0.0, 5.0]), np.array([1.0, 0.0])
    codes = sq8_encode(np.array([[-1.0, 5.0], [0.5, 9.0], [2.0, 5.0]]), vmin, vdiff)
    assert codes.tolist() == [[0, 0], [127, 0], [255, 0]]
    decoded = sq8_decode(codes, vmin, vdiff)
    assert decoded[:, 1].tolist() == [5.0, 5.0, 5.0]
    assert abs(decoded[1, 0] - 0.5) <= 0.5 / 255


def test_arrow_round_trips_respect_slices():
    matrix = np.arange(12.0).reshape(4, 3)
    column = matrix_list(matrix, pa.float64()).slice(1, 2)
    assert np.array_equal(list_matrix(column), matrix[1:3])
    codes = np.arange(12, dtype=np.uint8).reshape(4, 3)
    assert np.array_equal(code_matrix(code_binary(codes).slice(1, 2)), codes[1:3])


@pytest.mark.parametrize(
    "column",
    [
        pa.array([[1.0, 2.0], None], pa.list_(pa.float32())),
        pa.array([[1.0, 2.0], [1.0]], pa.list_(pa.float32())),
        pa.array([[1.0, None]], pa.list_(pa.float32())),
    ],
)
def test_invalid_vectors_are_refused(column):
    with pytest.raises(ValueError):
        list_matrix(column)


def test_key_groups_covers_every_row_once():
    a, b = np.array([2, 1, 2, 1]), np.array([0, 0, 0, 5])
    got = {key: sorted(rows) for key, rows in key_groups([a, b], 4)}
    assert got == {(1, 0): [1], (1, 5): [3], (2, 0): [0, 2]}


def test_combine_arrays_with_and_without_early_emission():
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 1], pa.int32()), pa.array([1, 1, 1], pa.int64()), matrix_list(np.array([[1.0], [5.0], [2.0]]), pa.float64())],
        ["key", "n", "sums"],
    )
    for hold, batches in ((None, 1), (0, 2)):
        out = list(combine_arrays([batch, batch], ["key"], "n", {"sums": np.add}, hold))
        assert len(out) == batches
        total: dict = {}
        for made in out:
            for key, n, sums in zip(*[made.column(i).to_pylist() for i in range(3)]):
                old = total.get(key, (0, 0.0))
                total[key] = (old[0] + n, old[1] + sums[0])
        assert total == {1: (4, 6.0), 2: (2, 10.0)}
