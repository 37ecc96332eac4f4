from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import kmeans, partition


@pytest.fixture(scope="module")
def skewed():
    """A large blob first, small distant ones last: evenly spaced starts fall into the large one."""
    rng = np.random.default_rng(0)
    far = [rng.normal(size=(6, 3)) * 0.05 + c for c in rng.normal(size=(9, 3)) * 40]
    return np.concatenate([rng.normal(size=(900, 3)), *far])


def _sizes(corpus, centroids):
    found = partition.cluster_assign(corpus.drop("part_id"), centroids).groupBy("part_id").count().collect()
    return {r.part_id: r["count"] for r in found}


def test_starts_by_distance_cost_less_on_skewed_data(make_vectors, skewed):
    corpus = make_vectors(skewed).cache()
    spaced = kmeans.kmeans_fit(corpus, 10, 20)
    seeded = kmeans.kmeans_fit(corpus, 10, 20, seeding="oversampled", repair=True)
    assert kmeans.kmeans_cost(corpus, seeded) < 0.5 * kmeans.kmeans_cost(corpus, spaced)
    assert len(_sizes(corpus, seeded)) == 10
    again = kmeans.oversampled_start(make_vectors(skewed, partitions=7), 10).collect()
    first = kmeans.oversampled_start(corpus, 10).collect()
    assert [r.list_id for r in first] == list(range(10))
    assert np.allclose([r.centroid for r in first], [r.centroid for r in again])


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_empty_clusters_take_half_of_large_ones(spark, make_vectors, skewed, limit):
    corpus = make_vectors(skewed).cache()
    start = spark.createDataFrame([(0, i, [1000.0 + i, 0.0, 0.0] if i else [0.1, 0.1, 0.1]) for i in range(6)], "part_id int, list_id int, centroid array<double>")
    for repair, clusters in ((False, 1), (True, 6)):
        got = kmeans.lloyd(corpus, start, 8, limit_bytes=limit, repair=repair).withColumnRenamed("list_id", "cluster_id")
        assert len(_sizes(corpus, got)) == clusters


def test_fewer_different_vectors_than_clusters(make_vectors):
    corpus = make_vectors(np.repeat(np.eye(3), 5, axis=0))
    start = kmeans.oversampled_start(corpus, 5).collect()
    assert len(start) == 5 and {tuple(r.centroid) for r in start} == {(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)}
    assert kmeans.kmeans_cost(corpus, kmeans.kmeans_fit(corpus, 5, 3, seeding="oversampled")) == 0
    with pytest.raises(ValueError, match="seeding"):
        kmeans.kmeans_fit(corpus, 2, seeding="other")


def test_hashed_sample_is_the_smallest_hashes_of_each_part(spark):
    rows = [(i, None if i % 5 == 0 else i % 3) for i in range(3000)] + [(None, 1)] * 3 + [(7, 1), (7, 1)]
    name = lambda i: hashlib.md5(f"0:{'' if i is None else i}".encode()).hexdigest()
    found = []
    for partitions in (1, 6):
        df = spark.createDataFrame(rows, "vec_id bigint, part_id int").withColumn("x", F.lit("x")).repartition(partitions)
        found.append(sorted(map(tuple, partition.train_sample_hashed(df).collect()), key=str))
    assert found[0] == found[1]
    for part in (None, 0, 1, 2):
        mine = [i for i, p in rows if p == part]
        n = max(int(len(mine) ** 0.5), len(mine) // 10)
        got = sorted((r for r in found[0] if r[1] == part), key=lambda r: r[3])
        assert [r[3] for r in got] == list(range(n))
        assert [name(r[0]) for r in got] == sorted(map(name, mine))[:n]
    none = spark.createDataFrame([], "vec_id bigint, part_id int")
    assert partition.train_sample_hashed(none).collect() == []
