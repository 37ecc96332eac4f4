"""Numpy kernels: block scoring with exact ties, nearest item, 8-bit scalar codes."""

from __future__ import annotations

import numpy as np

NO_ID = np.iinfo(np.int64).max
_QUERY_CHUNK = 512
_PAIR_BYTES = 64 << 20
_TIES = 64  # candidates per wanted hit that suggest copies in the block
_UNIT = 2.0**-24  # float32 unit roundoff


def _power_of_two(largest: np.ndarray) -> np.ndarray:
    """Power of two near ``largest``; dividing by it is exact and leaves values of at most 1. 1 for zero."""
    return np.where(largest > 0, np.exp2(np.ceil(np.log2(np.where(largest > 0, largest, 1.0))).clip(-1000, 1000)), 1.0)


class QueryBlock:
    """Query vectors with a float32 copy, scaled row by row, and its norms, prepared once per task."""

    def __init__(self, vectors: np.ndarray):
        self.f64 = np.ascontiguousarray(vectors, dtype=np.float64)
        self.scale = _power_of_two(np.abs(self.f64).max(axis=1, initial=0.0))
        unit = self.f64 / self.scale[:, None]
        self.f32 = unit.astype(np.float32)
        self.norm = np.sqrt((unit**2).sum(axis=1))

    def __len__(self) -> int:
        return len(self.f64)

    def take(self, rows: np.ndarray | None) -> QueryBlock:
        if rows is None:
            return self
        part = object.__new__(QueryBlock)
        part.f64, part.f32, part.norm, part.scale = self.f64[rows], self.f32[rows], self.norm[rows], self.scale[rows]
        return part


def _pair_scores(q: np.ndarray, c: np.ndarray, qi: np.ndarray, cj: np.ndarray) -> np.ndarray:
    """DOUBLE inner products of selected pairs.

    Each pair is summed on its own, so the result does not depend on where the pair lies in
    a block: equal vectors get bit-equal scores and ties are real ties.
    """
    out = np.empty(len(qi))
    step = max(1, _PAIR_BYTES // (8 * max(1, q.shape[1])))
    for a in range(0, len(qi), step):
        out[a : a + step] = (q[qi[a : a + step]] * c[cj[a : a + step]]).sum(axis=1)
    return out


def _at_least(approx: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Flat indexes of the entries that are not below their row's bound (rounded down to float32)."""
    bound = np.nextafter(low.astype(np.float32), np.float32(-np.inf))
    return np.flatnonzero(approx >= bound[:, None])


def _distinct_enough(items: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the best ``k``: of equal vectors only the k lowest ids."""
    raw = items.view(np.dtype((np.void, items.dtype.itemsize * items.shape[1]))).ravel()
    _, group = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, group))
    first = np.searchsorted(group[order], np.arange(group.max() + 1))
    return np.sort(order[np.arange(len(ids)) - first[group[order]] < k])


def block_topk(queries: QueryBlock, items: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
    """Best ``k`` items per query by inner product, ties to the lower id.

    A float32 product of both sides, scaled to components of at most 1, finds the candidates: every item
    whose score can reach the k-th best once the rounding error bound is allowed for. Those are scored
    again in DOUBLE. ``floor`` is a score per query below which items are of no interest (the k-th best so
    far). Vectors so large that their product leaves DOUBLE are refused.
    Returns ``(scores, ids)`` of shape (queries, k), padded with -inf / NO_ID.
    """
    nq, n, dim = len(queries), len(ids), items.shape[1]
    scores = np.full((nq, k), -np.inf)
    found = np.full((nq, k), NO_ID, dtype=np.int64)
    if n == 0 or nq == 0:
        return scores, found
    if dim != queries.f64.shape[1]:
        raise ValueError("vectors of different length reached a kernel; filter invalid vectors first")
    items64 = np.ascontiguousarray(items, dtype=np.float64)
    largest = np.abs(items64).max(initial=0.0)
    if largest * np.abs(queries.f64).max(initial=0.0) * dim > 1e300:
        raise ValueError("inner products of these vectors leave the range of DOUBLE")
    scale = float(_power_of_two(np.asarray(largest)))
    unit = items64 / scale
    items32 = unit.astype(np.float32)
    longest = np.sqrt((unit**2).sum(axis=1)).max()
    kk = min(k, n)
    for a in range(0, nq, _QUERY_CHUNK):
        b = min(a + _QUERY_CHUNK, nq)
        approx = queries.f32[a:b] @ items32.T
        # input rounding of both sides plus the summation, for the k-th best and the item itself
        margin = (2.0 * (dim + 3) * _UNIT * longest) * queries.norm[a:b] + 1e-30
        low = np.full(b - a, -np.inf) if floor is None else floor[a:b] / queries.scale[a:b] / scale
        at = None if floor is None else _at_least(approx, low - margin)
        if at is None or len(at) > 4 * kk * (b - a):
            if n > kk:
                kth = approx.max(axis=1) if kk == 1 else np.partition(approx, n - kk, axis=1)[:, n - kk]
                low = np.maximum(low, kth.astype(np.float64))
            at = _at_least(approx, low - margin)
            if len(at) > _TIES * kk * (b - a) and n > kk:
                # masses of (nearly) equal scores: without the surplus copies the rest is a smaller block
                rows = _distinct_enough(items64, ids, k)
                if len(rows) < n // 2:
                    return block_topk(queries, items64[rows], ids[rows], k, floor)
        if len(at) == 0:
            continue
        qi, cj = np.divmod(at, n)
        exact = _pair_scores(queries.f64[a:b], items64, qi, cj)
        order = np.lexsort((ids[cj], -exact, qi))
        qi, cj, exact = qi[order], cj[order], exact[order]
        first = np.searchsorted(qi, np.arange(b - a))
        rank = np.arange(len(qi)) - first[qi]
        keep = rank < k
        scores[a + qi[keep], rank[keep]] = exact[keep]
        found[a + qi[keep], rank[keep]] = ids[cj[keep]]
    return scores, found


def merge_topk(s1: np.ndarray, i1: np.ndarray, s2: np.ndarray, i2: np.ndarray):
    """Merge two padded (queries, k) results; same order as :func:`block_topk`."""
    k = s1.shape[1]
    s, i = np.concatenate([s1, s2], axis=1), np.concatenate([i1, i2], axis=1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)


def with_constant(vectors: np.ndarray) -> np.ndarray:
    """Append 1.0 to every vector; see :func:`l2_as_product`."""
    return np.concatenate([vectors, np.ones((len(vectors), 1))], axis=1)


def l2_as_product(centroids: np.ndarray) -> np.ndarray:
    """Append -|c|^2/2: the largest product of (x, 1) with (c, -|c|^2/2) is the smallest |x-c|."""
    half = -0.5 * (centroids**2).sum(axis=1, keepdims=True)
    return np.concatenate([centroids, half], axis=1)


def sq8_encode(vectors: np.ndarray, vmin: np.ndarray, vdiff: np.ndarray) -> np.ndarray:
    """8-bit code per dimension, clipped to the trained range; a constant dimension codes to 0."""
    x = np.asarray(vectors, dtype=np.float64)
    scaled = np.zeros_like(x)
    np.divide(255.0 * (x - vmin), vdiff, out=scaled, where=np.broadcast_to(vdiff > 0, x.shape))
    return np.clip(np.floor(scaled), 0, 255).astype(np.uint8)


def sq8_decode(codes: np.ndarray, vmin: np.ndarray, vdiff: np.ndarray) -> np.ndarray:
    """Middle of the code's cell; a constant dimension (vdiff 0) decodes to vmin."""
    return vmin + (codes.astype(np.float64) + 0.5) / 255.0 * vdiff
