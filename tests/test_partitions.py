from __future__ import annotations

import numpy as np
import pytest
from conftest import VECTORS
from pyspark.sql import functions as F

from vectorloom.operators import partition
from vectorloom.operators.positions import with_positions


@pytest.mark.parametrize("bucket_rows", [7, 1_000_000])
def test_positions_of_ids_with_gaps(spark, bucket_rows):
    ids = sorted({int(x) for x in np.random.default_rng(0).integers(-500, 10**12, 100)} | set(range(30)))
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(5)
    rows = with_positions(df, "id", bucket_rows=bucket_rows).collect()
    assert sorted((r.pos, r.id) for r in rows) == list(enumerate(ids))
    head = with_positions(df, "id", below=11, bucket_rows=bucket_rows).collect()
    assert sorted((r.pos, r.id) for r in head) == list(enumerate(ids))[:11]


@pytest.mark.parametrize("bucket_rows", [7, 1_000_000])
def test_positions_per_group_with_limits(spark, bucket_rows):
    rows = [(i * 3, 0 if i % 3 else 1) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, g int").repartition(4)
    limits = spark.createDataFrame([(0, 20), (1, 100)], "g int, n_keep bigint")
    got = with_positions(df, "id", by=["g"], limits=limits, bucket_rows=bucket_rows).collect()
    for g, keep in ((0, 20), (1, 100)):
        want = list(enumerate(sorted(i for i, x in rows if x == g)))[:keep]
        assert sorted((r.pos, r.id) for r in got if r.g == g) == want


def test_dense_prefix_is_a_pushed_filter(spark, tmp_path):
    spark.range(1000).withColumn("x", F.rand()).write.parquet(str(tmp_path / "t"))
    plan = with_positions(spark.read.parquet(str(tmp_path / "t")), "id", below=10)._jdf.queryExecution().toString()
    assert "LessThan(id,10)" in plan and "Window" not in plan


@pytest.mark.parametrize("n, num", [(103, 10), (10, 10), (5, 1), (3, 10)])
def test_splits_keep_the_remainder(spark, n, num):
    ids = [i * 2 for i in range(n)]
    df = spark.createDataFrame([(i,) for i in ids], "vec_id bigint").repartition(3)
    rows = sorted((r.vec_id, r.part_id, r.local_pos) for r in partition.split_partition(df, num).collect())
    size = max(1, n // num)
    want = [(i, min(p // size, num - 1), p - min(p // size, num - 1) * size) for p, i in enumerate(ids)]
    assert rows == want


def test_membership_and_sizes_with_an_empty_cluster(spark):
    df = spark.createDataFrame([(9, 0), (4, 0), (7, 2)], "vec_id bigint, part_id int")
    members = {(r.part_id, r.local_pos): r.vec_id for r in partition.cluster_membership(df).collect()}
    assert members == {(0, 0): 4, (0, 1): 9, (2, 0): 7}
    clusters = spark.createDataFrame([(0,), (1,), (2,)], "part_id int")
    assert {r.part_id: r.n_rows for r in partition.cluster_sizes(df, clusters).collect()} == {0: 2, 1: 0, 2: 1}


def test_train_sizes_of_small_and_large_parts(spark):
    rows = [(i, 0) for i in range(1)] + [(i, 1) for i in range(100, 150)] + [(i, 2) for i in range(1000, 1900)]
    df = spark.createDataFrame(rows, "vec_id bigint, part_id int")
    got = {r.part_id: (r.n_rows, r.nlist, r.n_train) for r in partition.train_sizes(df).collect()}
    assert got == {0: (1, 1, 1), 1: (50, 7, 7), 2: (900, 30, 90)}
    sample = partition.train_sample(df).groupBy("part_id").agg(F.count("*").alias("n"), F.max("vec_id").alias("hi"))
    assert {r.part_id: (r.n, r.hi) for r in sample.collect()} == {0: (1, 0), 1: (7, 106), 2: (90, 1089)}


def test_cluster_assign_takes_the_nearest(spark):
    corpus = spark.createDataFrame([(0, 0, [0.0, 0.1]), (1, 0, [9.0, 9.0])], VECTORS).drop("part_id")
    centroids = spark.createDataFrame([(3, [0.0, 0.0]), (5, [10.0, 10.0])], "cluster_id int, centroid array<double>")
    assert {r.vec_id: r.part_id for r in partition.cluster_assign(corpus, centroids).collect()} == {0: 3, 1: 5}


def test_repeated_ids_get_positions_of_their_own(spark):
    ids = spark.createDataFrame([(0,), (0,), (2,)], "id bigint")  # as many as 0..2 would be
    assert sorted(r.pos for r in with_positions(ids, "id").collect()) == [0, 1, 2]


def test_many_buckets(spark):
    ids = spark.range(3000).selectExpr("id * 3 AS id")
    got = with_positions(ids, "id", bucket_rows=2).collect()
    assert all(r.pos == r.id // 3 for r in got) and len(got) == 3000


@pytest.mark.parametrize("bucket_rows", [2, 7, 1_000_000])
def test_positions_lose_no_row(spark, bucket_rows):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        g = None if i % 3 == 0 else float("nan") if i % 7 == 0 else float(i % 2)
        rows.append((None if i % 11 == 0 else int(rng.integers(0, 9)), g, f"x{i % 40}", {"a": i}))
    rows += [(4, None, "same", {"a": 0})] * 30  # one row repeated
    df = spark.createDataFrame(rows, "id bigint, g double, x string, m map<string,int>").repartition(4)
    name = lambda g: "null" if g is None else str(g)
    whole = with_positions(df, "id", bucket_rows=bucket_rows).collect()
    assert sorted(r.pos for r in whole) == list(range(150))
    in_order = [r.id for r in sorted(whole, key=lambda r: r.pos)]
    assert in_order == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    got = with_positions(df, "id", by=["g"], bucket_rows=bucket_rows).collect()
    assert sorted((r.id is not None, r.id or 0, name(r.g), r.x) for r in got) == sorted((r[0] is not None, r[0] or 0, name(r[1]), r[2]) for r in rows)
    for g in {name(r[1]) for r in rows}:
        mine = sorted(((r.pos, r.id) for r in got if name(r.g) == g), key=lambda r: r[0])
        want = sorted((r[0] for r in rows if name(r[1]) == g), key=lambda i: (i is not None, i or 0))
        assert mine == list(enumerate(want))
    limits = spark.createDataFrame([(None, 5), (float("nan"), 2), (1.0, 10**6)], "g double, n_keep bigint")
    kept = with_positions(df, "id", by=["g"], limits=limits, bucket_rows=bucket_rows).collect()
    counts = {name(r[1]): 0 for r in rows}
    for r in kept:
        counts[name(r.g)] += 1
    assert counts["null"] == 5 and counts["nan"] == 2 and counts["0.0"] == 0
    assert counts["1.0"] == sum(name(r[1]) == "1.0" for r in rows)


def test_positions_are_the_same_for_every_bucket_size(spark):
    rows = [(i % 5 if i % 6 else None, i % 2, f"x{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, g int, x string").repartition(3)
    results = [sorted(map(tuple, with_positions(df, "id", by=["g"], bucket_rows=b).collect()), key=str) for b in (2, 13, 10**6)]
    assert results[0] == results[1] == results[2]
    assert with_positions(df.where("g > 5"), "id", by=["g"]).count() == 0


def test_splits_and_membership_keep_null_ids_and_parts(spark):
    rows = [(None if i % 4 == 0 else i, None if i % 3 == 0 else i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, part_id int")
    assert partition.split_partition(df.drop("part_id"), 7).count() == 50
    members = partition.cluster_membership(df).collect()
    assert sorted((r.part_id is None, r.local_pos) for r in members if r.part_id is None) == [(True, i) for i in range(17)]
    assert len(members) == 50
