"""Exact top-k search without random access.

Vectors become integers. Candidates are dealt to blocks, and a block holds for every dimension a list of its candidates
sorted by component. For a query the lists are read in step from the end that its weight prefers; every candidate seen so far
has a lower and an upper bound of its score, and all others share one upper bound. Reading stops when no outsider can qualify and few
candidates are left, whose scores are then resolved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm import words
from vectorloom.operators.sizing import checkpointed

#: Candidates and queries that meet in one group, and queries whose bounds are computed at once.
ITEM_BLOCK, QUERY_BLOCK, QUERIES_AT_ONCE = 4096, 1024, 256
#: Shares of the lists that are read between two looks at the bounds.
DEPTHS = (0.25, 0.5, 0.7, 0.85, 1.0)
#: Scores beyond this need more than 64 bits and are an error.
_LIMIT = float(1 << 62)


def usable(vector: Column) -> Column:
    """Vectors that take part: neither null nor with a null, NaN or infinite component."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)
    )


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones are filled up with zeros."""
    length = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(length), width), np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(length)), length)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


class Lists:
    """A block of candidates, sorted by each component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.values = vectors.astype(float)
        self.least, self.most = self.values.min(axis=0), self.values.max(axis=0)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, depths: tuple[float, ...] = DEPTHS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of the k best of this block other than ``own``, ties to smaller ids.

        All queries read the lists to the same depth, from the top where their weight is positive, from the bottom where it is negative. A
        query is resolved as soon as few candidates have an upper bound that reaches its k-th best lower bound.
        """
        n, d = self.vectors.shape
        size = np.abs(queries).astype(float) @ np.maximum(np.abs(self.least), np.abs(self.most))
        if (size > _LIMIT).any():
            raise ValueError("an inner product of the quantised vectors may pass 64 bits")
        # sums of integers below 2^53 are exact in DOUBLE
        slack = np.where(size < float(1 << 52), 0.0, size * 2.0**-40)
        weights = np.concatenate((np.maximum(queries, 0), np.minimum(queries, 0)), axis=1).astype(float)
        # least contribution of each list: what an unread entry is worth at worst
        worst = np.concatenate((self.least, self.most))
        read, unread = np.zeros((n, 2 * d)), np.ones((n, 2 * d))
        out: list = [None] * len(queries)
        waiting, done = np.arange(len(queries)), 0
        for depth in depths:
            upto = min(n, max(k, int(np.ceil(depth * n))))
            columns = np.arange(d)
            for rows, side in ((self.order[n - upto : n - done], columns + 0), (self.order[done:upto], columns + d)):
                read[rows, side] = self.values[rows, columns]
                unread[rows, side] = 0
            done = upto
            frontier = np.concatenate((self.values[self.order[n - upto], columns], self.values[self.order[upto - 1], columns]))
            left = []
            for at in range(0, len(waiting), QUERIES_AT_ONCE):
                some = waiting[at : at + QUERIES_AT_ONCE]
                w = weights[some].T
                partial = read @ w
                lower = partial + unread @ (w * worst[:, None])
                lower[self.ids[:, None] == own[some]] = -np.inf
                place = max(0, n - k)
                floor = np.partition(lower, place, axis=0)[place] - 2 * slack[some]
                upper = partial + unread @ (w * frontier[:, None])
                rivals = upper >= floor
                rivals &= lower > -np.inf
                few = (rivals.sum(axis=0) <= max(4 * k, n // 32)) | (upto == n)
                for column in np.flatnonzero(few):
                    rows = np.flatnonzero(rivals[:, column])
                    scores = self.vectors[rows] @ queries[some[column]]
                    best = np.lexsort((self.ids[rows], -scores))[:k]
                    out[some[column]] = self.ids[rows][best], scores[best]
                left.append(some[~few])
            waiting = np.concatenate(left) if left else waiting[:0]
            if not len(waiting):
                break
        return out


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in words.whole_groups(batches, "g"):
            bounds = words.runs(table.column("g").to_numpy())
            for a, b in zip(bounds[:-1], bounds[1:]):
                part = table.slice(a, b - a).combine_chunks()
                side = part.column("side").to_numpy()
                split = int(np.searchsorted(side, 1))
                if split in (0, len(side)):
                    continue
                column = part.column("v").combine_chunks()
                width = int(np.diff(column.offsets.to_numpy()).max(initial=0))
                matrix, ids = _matrix(column, width), part.column("vec_id").to_numpy()
                lists = Lists(ids[:split], matrix[:split])
                found = lists.top(matrix[split:], ids[split:], k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids[split:], [len(f[0]) for f in found])),
                        pa.array(np.concatenate([f[0] for f in found])),
                        pa.array(np.concatenate([f[1] for f in found])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    return search


def exact_topk(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256
) -> DataFrame:
    """The ``k`` best candidates of every query: ``(query_id, rank, vec_id, score)``.

    Components become ``floor(scale * x)``; the score is their integer inner product. Queries are the rows whose id is divisible by
    ``every``, candidates all rows but those with the query's own id. Ties go to smaller ids; a query with fewer candidates has fewer rows. Vectors
    that are null or hold a null or non-finite component take no part, nor do rows without an id; a missing component of a shorter
    vector counts as zero. Rows repeated with one id are candidates each, and as a query the smallest of their vectors counts.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v")
    )
    is_query = F.col("vec_id") % every == 0
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(is_query.cast("bigint")), F.lit(0)).alias("q")).head()
    item_blocks, query_blocks = max(1, -(-sizes.n // ITEM_BLOCK)), max(1, -(-sizes.q // QUERY_BLOCK))
    # every pair of a candidate block and a query block is a group; the row number deals repeated rows over blocks, too
    items = rows.select(
        F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(item_blocks)).alias("b"), "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("o")
    ).select((F.col("b") * query_blocks + F.col("o")).alias("g"), F.lit(0).alias("side"), "vec_id", "v")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = queries.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("b"), "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))).alias("o")
    ).select((F.col("o") * query_blocks + F.col("b")).cast("bigint").alias("g"), F.lit(1).alias("side"), "vec_id", "v")
    met = items.withColumn("g", F.col("g").cast("bigint")).unionByName(asked).repartition("g").sortWithinPartitions("g", "side")
    found = checkpointed(met.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
