"""Lloyd iterations as DataFrame jobs, for one clustering or for all parts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.arrow import combine_arrays, list_matrix, matrix_list
from vectorloom.operators.match import centroid_groups, nearest_centroid, nearest_in_batch
from vectorloom.operators.positions import with_positions
from vectorloom.operators.sizing import BROADCAST_LIMIT_BYTES, checkpointed, collect_within, vector_dim, written

_HELD_BYTES = 256 << 20  # partial sums a task holds before it emits them
_SUMS = "part_id int, list_id int, n bigint, sums array<double>"


def _combine(partial: DataFrame) -> DataFrame:
    """Add up partial sums per centroid: one shuffle of what the tasks have already combined."""
    keys, arrays = ["part_id", "list_id"], {"sums": np.add}
    return partial.repartition(*keys).mapInArrow(lambda it: combine_arrays(it, keys, "n", arrays), _SUMS)


def _assigned_sums(vectors: DataFrame, table: pa.Table, dim: int) -> DataFrame:
    """Assign and add up inside the task: vectors never leave it, only sums per centroid do."""
    groups = centroid_groups(table, ["part_id"], "l2", dim)
    payload = vectors.sparkSession.sparkContext.broadcast(groups)

    def assigned(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            best = nearest_in_batch(batch, payload.value, ["part_id"], "l2")
            vectors = list_matrix(batch.column(batch.schema.get_field_index("embedding")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("part_id")),
                    pa.array(best, pa.int32()),
                    pa.array(np.ones(len(best), np.int64)),
                    matrix_list(vectors, pa.float64()),
                ],
                ["part_id", "list_id", "n", "sums"],
            )

    def scan(batches):
        yield from combine_arrays(assigned(batches), ["part_id", "list_id"], "n", {"sums": np.add}, _HELD_BYTES)

    return vectors.select("part_id", "embedding").mapInArrow(scan, _SUMS)


def _joined_sums(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """The same sums when the centroids do not fit a broadcast."""
    assigned = nearest_centroid(vectors, centroids, on=["part_id"], strategy="packed")
    ones = assigned.select(
        "part_id",
        "list_id",
        F.lit(1).cast("bigint").alias("n"),
        F.transform("embedding", lambda x: x.cast("double")).alias("sums"),
    )
    keys, arrays = ["part_id", "list_id"], {"sums": np.add}
    return ones.mapInArrow(lambda it: combine_arrays(it, keys, "n", arrays, _HELD_BYTES), _SUMS)


_NUDGE = 1 / 1024  # by which the halves of a split cluster are moved apart


def _apart(centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A centroid as two that lie on either side of it."""
    nudge = np.where(np.arange(len(centroid)) % 2 == 0, 1 + _NUDGE, 1 - _NUDGE)
    return centroid * nudge, centroid * (2 - nudge)


def _moved(table: pa.Table, sums: pa.Table, dim: int, repair: bool = False) -> pa.Table:
    """Collected centroids after a step; one without rows stays where it is, or takes half of its part's largest cluster with ``repair``."""
    keys = list(zip(table.column("part_id").to_pylist(), table.column("list_id").to_pylist()))
    at = {key: i for i, key in enumerate(keys)}
    centroids = np.concatenate([list_matrix(c) for c in table.column("centroid").chunks if len(c)])
    sizes = np.zeros(len(keys), np.int64)
    for batch in sums.to_batches():
        matrix = list_matrix(batch.column("sums"))
        rows = zip(batch.column("part_id").to_pylist(), batch.column("list_id").to_pylist())
        n = batch.column("n").to_numpy()
        rows = [at[key] for key in rows]
        centroids[rows] = matrix / n[:, None]
        sizes[rows] = n
    parts = np.array([key[0] for key in keys])
    for empty in np.flatnonzero(sizes == 0) if repair else ():
        largest = int(np.argmax(np.where(parts == parts[empty], sizes, -1)))
        if sizes[largest] > 1:
            centroids[empty], centroids[largest] = _apart(centroids[largest])
            sizes[empty] = sizes[largest] // 2
            sizes[largest] -= sizes[empty]
    return pa.table(
        {"part_id": table.column("part_id"), "list_id": table.column("list_id"), "centroid": matrix_list(centroids, pa.float64())}
    )


def lloyd(
    vectors: DataFrame,
    start: DataFrame,
    niter: int,
    *,
    n_centroids: int | None = None,
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
    repair: bool = False,
) -> DataFrame:
    """``niter`` Lloyd steps (Euclidean) of every part at once.

    ``vectors(part_id, embedding, vec_id)``, ``start(part_id, list_id, centroid)``. One job per
    step over all parts; ties go to the lower id. A centroid without rows stays where it is; with ``repair`` it takes half of the largest
    cluster of its part, the next one half of the largest that is left, and so on.
    Centroids within the limit are collected and broadcast, and a step returns only its sums. Larger
    sets are joined block-wise and every step starts from a written table.
    """
    start = start.select("part_id", "list_id", "centroid")
    if n_centroids is None:
        start = checkpointed(start)
        n_centroids = start.count()
    dim = vector_dim(vectors, "embedding")
    table = collect_within(start, limit_bytes // max(1, 8 * dim), n_centroids)
    if table is not None:
        for _ in range(niter):
            table = _moved(table, _combine(_assigned_sums(vectors, table, dim)).toArrow(), dim, repair)
        return vectors.sparkSession.createDataFrame(table, start.schema)
    current = written(start)
    for _ in range(niter):
        sums = _combine(_joined_sums(vectors, current))
        moved = sums.select("part_id", "list_id", "n", F.transform("sums", lambda x: x / F.col("n")).alias("moved"))
        updated = current.join(moved, ["part_id", "list_id"], "left")
        updated = updated.select("part_id", "list_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("moved", "centroid").alias("centroid"))
        current = written(_split_largest(written(updated)) if repair else updated.drop("n"))
    return current


def _split_largest(updated: DataFrame) -> DataFrame:
    """The n-th empty cluster of a part takes half of its n-th largest one, for ``updated(part_id, list_id, n, centroid)``."""
    empty = updated.where("n = 0").withColumn("place", F.row_number().over(Window.partitionBy("part_id").orderBy("list_id")))
    largest = updated.where("n > 1").withColumn("place", F.row_number().over(Window.partitionBy("part_id").orderBy(F.desc("n"), "list_id")))
    donors = largest.join(empty.select("part_id", "place", F.col("list_id").alias("to")), ["part_id", "place"]).select("part_id", "list_id", "to", "centroid")

    def nudged(sign: int):
        return F.transform("centroid", lambda x, d: x * F.when(d % 2 == 0, 1 + sign * _NUDGE).otherwise(1 - sign * _NUDGE))

    split = donors.select("part_id", F.col("to").alias("list_id"), nudged(1).alias("other")).union(donors.select("part_id", "list_id", nudged(-1).alias("other")))
    return updated.join(split, ["part_id", "list_id"], "left").select("part_id", "list_id", F.coalesce("other", "centroid").alias("centroid"))


def spaced_start(placed: DataFrame, counts: DataFrame) -> DataFrame:
    """Start centroids: per part the rows at positions floor(j * n / nlist).

    ``placed(part_id, pos, embedding)``, ``counts(part_id, nlist, n)`` with n rows placed.
    """
    wanted = counts.select(
        "part_id",
        F.explode(F.sequence(F.lit(0), F.col("nlist") - 1)).alias("list_id"),
        "nlist",
        "n",
    ).select(
        "part_id", "list_id", F.expr("CAST(list_id AS BIGINT) * n DIV nlist").alias("pos")
    )
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    return wanted.join(placed.select("part_id", "pos", doubles.alias("centroid")), ["part_id", "pos"]).drop("pos")


def oversampled_start(vectors: DataFrame, k: int, *, rounds: int = 4, factor: int = 2, seed: int = 0) -> DataFrame:
    """Start centroids ``(part_id, list_id, centroid)`` of part 0, spread over the data by distance.

    Each round draws ``factor * k`` rows, with chances in proportion to their squared distance from what was drawn before (the smallest of
    exponential keys, which come from hashes, so reruns agree), in one pass that returns just these rows. The candidates, weighted by the rows nearest to
    them, are then clustered to ``k`` on the driver: at most ``1 + rounds * factor * k`` vectors of the size of centroids. Identical
    vectors are drawn once; if there are fewer different ones than ``k``, some centroids are equal.
    """
    rng = np.random.default_rng(seed)

    def drawn(df: DataFrame, n: int, turn: int, weight) -> np.ndarray:
        unit = (F.pmod(F.xxhash64("vec_id", "embedding", F.lit(seed * 1009 + turn)), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
        keyed = df.where(weight > 0).select("embedding", (-F.log(unit) / weight).alias("_key"), "vec_id")
        found = keyed.orderBy("_key", "vec_id").limit(n).select("embedding").toArrow()
        chunks = [list_matrix(c) for c in found.column("embedding").chunks if len(c)]
        return np.concatenate(chunks) if chunks else np.zeros((0, 0))

    centres = drawn(vectors, 1, 0, F.lit(1.0))
    for turn in range(1, rounds + 1):
        more = drawn(_distances(vectors, centres), factor * k, turn, F.col("_d2"))
        if not len(more):
            break
        centres = np.unique(np.concatenate((centres, more)), axis=0)
    counts = _distances(vectors, centres).groupBy("_nearest").agg(F.count(F.lit(1)).alias("n")).collect()
    weight = np.zeros(len(centres))
    weight[[r["_nearest"] for r in counts]] = [r.n for r in counts]
    chosen = _weighted_clusters(centres, weight, k, rng)
    table = pa.table({"part_id": pa.array(np.zeros(k), pa.int32()), "list_id": pa.array(np.arange(k), pa.int32()), "centroid": matrix_list(chosen, pa.float64())})
    return vectors.sparkSession.createDataFrame(table, "part_id int, list_id int, centroid array<double>")


_ROWS_AT_ONCE = 1024


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances; exactly 0 for equal vectors."""
    rough = np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)
    best = rough.argmin(1)
    rough[np.arange(len(x)), best] = ((x - centres[best]) ** 2).sum(1)
    return rough


def _distances(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add ``_nearest``, the number of the nearest centre, and ``_d2``, the squared distance from it."""
    payload = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            x = list_matrix(batch.column(batch.schema.get_field_index("embedding")))
            near, far = np.zeros(len(x), np.int64), np.zeros(len(x))
            for a in range(0, len(x), _ROWS_AT_ONCE):
                squares = _squares(x[a : a + _ROWS_AT_ONCE], payload.value)
                near[a : a + _ROWS_AT_ONCE] = squares.argmin(1)
                far[a : a + _ROWS_AT_ONCE] = squares.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(far)], [*batch.schema.names, "_nearest", "_d2"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{fields}, _nearest bigint, _d2 double")


def _weighted_clusters(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator, steps: int = 20) -> np.ndarray:
    """``k`` centroids of weighted points: drawn by weight and distance, then moved by Lloyd steps."""
    at = [int(np.argmax(weight))]
    for _ in range(1, k):
        share = weight * _squares(points, points[at]).min(1)
        at.append(int(rng.choice(len(points), p=share / share.sum())) if share.sum() > 0 else at[-1])
    centroids = points[at].astype(float)
    for _ in range(steps):
        nearest = _squares(points, centroids).argmin(1)
        mass = np.bincount(nearest, weight, k)
        sums = np.stack([np.bincount(nearest, weight * points[:, d], k) for d in range(points.shape[1])], axis=1)
        centroids[mass > 0] = sums[mass > 0] / mass[mass > 0, None]
    return centroids


def kmeans_cost(vectors: DataFrame, centroids: DataFrame) -> float:
    """Sum of the squared distances of ``vectors(embedding)`` from their nearest one of ``centroids(centroid)``, which are collected."""
    table = centroids.select("centroid").toArrow()
    matrix = np.concatenate([list_matrix(c) for c in table.column("centroid").chunks if len(c)])
    return _distances(vectors.select("embedding"), matrix).agg(F.coalesce(F.sum("_d2"), F.lit(0.0)).alias("c")).head().c


def kmeans_fit(corpus: DataFrame, k: int, niter: int = 20, seeding: str = "spaced", **options) -> DataFrame:
    """``(cluster_id, centroid)`` from ``niter`` Lloyd steps over start vectors that are evenly ``spaced`` in id order, or ``oversampled``
    by distance (:func:`oversampled_start`).

    Every step reads all rows; the executors keep them, in memory or on disk, until the fit is done. ``repair=True`` splits large clusters when
    others are left without rows.
    """
    if seeding not in ("spaced", "oversampled"):
        raise ValueError(f"unknown seeding {seeding!r}")
    vectors = corpus.select(F.lit(0).alias("part_id"), "vec_id", "embedding").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(vectors, k, niter, seeding, **options)
    finally:
        vectors.unpersist()


def _fit(vectors: DataFrame, k: int, niter: int, seeding: str, **options) -> DataFrame:
    n = vectors.count()
    if n < k:
        raise ValueError(f"{k} clusters need at least {k} vectors, got {n}")
    if seeding == "oversampled":
        start = oversampled_start(vectors, k)
    else:
        counts = vectors.sparkSession.range(1).select(
            F.lit(0).alias("part_id"), F.lit(k).alias("nlist"), F.lit(n).cast("bigint").alias("n")
        )
        start = spaced_start(with_positions(vectors, "vec_id"), counts)
    return lloyd(vectors, start, niter, n_centroids=k, **options).select(F.col("list_id").alias("cluster_id"), "centroid")
