"""Corpus partitions: contiguous splits, clusters, their sizes and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.operators.match import nearest_centroid
from vectorloom.operators.positions import with_positions
from vectorloom.operators.sizing import checkpointed, join_small


def single_partition(corpus: DataFrame) -> DataFrame:
    """The whole corpus as part 0."""
    return corpus.withColumn("part_id", F.lit(0))


def split_partition(corpus: DataFrame, num: int) -> DataFrame:
    """``num`` contiguous ranges of equal size as ``part_id`` with the position ``local_pos``.

    The rows left over by the division stay in the last split.
    """
    if num < 1:
        raise ValueError("num must be at least 1")
    size = max(1, corpus.count() // num)
    placed = with_positions(corpus, "vec_id")
    part = F.least(F.floor(F.col("pos") / size), F.lit(num - 1)).cast("int")
    return (
        placed.withColumn("part_id", part)
        .withColumn("local_pos", F.col("pos") - F.col("part_id").cast("bigint") * size)
        .drop("pos")
    )


def local_to_global(hits: DataFrame, splits: DataFrame) -> DataFrame:
    """Add ``global_id``: the document at a position inside a split, whatever gaps the ids have.

    ``hits(part_id, local_pos, ...)``, ``splits(part_id, local_pos, vec_id, ...)`` from :func:`split_partition`. A position that
    the split lacks has no document (NULL).
    """
    places = splits.select("part_id", "local_pos", F.col("vec_id").alias("global_id"))
    return hits.join(places, ["part_id", "local_pos"], "left")


def cluster_assign(corpus: DataFrame, centroids: DataFrame, **match) -> DataFrame:
    """Add ``part_id``: the nearest centroid by Euclidean distance, ties to the lower id."""
    items = centroids.select(F.col("cluster_id").alias("list_id"), "centroid")
    return nearest_centroid(corpus, items, metric="l2", **match).withColumnRenamed("list_id", "part_id")


def cluster_membership(clustered: DataFrame) -> DataFrame:
    """``(part_id, local_pos, vec_id)``: the ordered ids of every cluster, in long form."""
    placed = with_positions(clustered.select("part_id", "vec_id"), "vec_id", by=["part_id"])
    return placed.select("part_id", F.col("pos").alias("local_pos"), "vec_id")


def cluster_sizes(clustered: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Rows per cluster; with ``clusters(part_id)`` the empty ones appear with 0."""
    counts = clustered.groupBy("part_id").agg(F.count(F.lit(1)).alias("n_rows"))
    if clusters is None:
        return counts
    return clusters.select("part_id").join(counts, "part_id", "left").select(
        "part_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def train_sizes(partitioned: DataFrame) -> DataFrame:
    """``(part_id, n_rows, nlist, n_train)``: floor(sqrt(n)) lists, trained on the first tenth.

    A tenth of a small part can be less than its number of lists; training then takes as many
    rows as lists.
    """
    counts = partitioned.groupBy("part_id").agg(F.count(F.lit(1)).alias("n_rows"))
    nlist = F.floor(F.sqrt(F.col("n_rows"))).cast("int")
    tenth = F.floor(F.col("n_rows") / 10)
    n_train = F.least(F.col("n_rows"), F.greatest(nlist.cast("bigint"), tenth))
    return counts.withColumn("nlist", nlist).withColumn("n_train", n_train)


def train_sample(partitioned: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The training rows of every part (lowest ids first) with their position ``pos`` in the part."""
    sizes = train_sizes(partitioned) if sizes is None else sizes
    limits = sizes.select("part_id", F.col("n_train").alias("n_keep"))
    return with_positions(partitioned, "vec_id", by=["part_id"], limits=limits)


def train_sample_hashed(partitioned: DataFrame, sizes: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Like :func:`train_sample`, but the rows of every part with the smallest hashes of their ids, with their place in that order as ``pos``.

    As many rows as the first tenth has, but spread over all ids, whatever order the corpus was written in, and the same ones for every
    partitioning. One pass counts the rows of each part per bucket of hashes (a sketch of at most 65,536 counts a part, added up in
    the tasks); it tells the bucket in which the sample ends, so only rows of the sample are exchanged and put in order, bucket by bucket. Null
    ids share a hash, null parts are a part; rows with equal ids go by a digest of their other columns.
    """
    sizes = train_sizes(partitioned) if sizes is None else sizes
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"))
    hashed = partitioned.withColumn("_hash", digest).withColumn("_bucket", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"))
    counts = hashed.groupBy("part_id", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("part_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    keep = sizes.select(F.col("part_id").alias("_part"), "n_train")
    placed = placed.join(keep, F.col("part_id").eqNullSafe(F.col("_part"))).where(F.col("_before") < F.col("n_train")).drop("_part")
    others = F.xxhash64(*[c for c in partitioned.columns if c not in ("vec_id", "part_id")]) if len(partitioned.columns) > 2 else F.lit(0)
    taken = join_small(hashed, checkpointed(placed), ["part_id", "_bucket"], "_hash", null_safe=True)
    inside = Window.partitionBy("part_id", "_bucket").orderBy("_hash", "vec_id", others)
    ranked = taken.withColumn("pos", F.col("_before") + F.row_number().over(inside) - 1)
    return ranked.where(F.col("pos") < F.col("n_train")).select(*partitioned.columns, "pos")
