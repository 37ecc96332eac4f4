from __future__ import annotations

import numpy as np
import pytest
from conftest import brute_topk, grouped
from pyspark.sql import functions as F

import vectorloom.operators.match as match
from vectorloom.operators.match import nearest_centroid, topk_join

FORMS = ["queries", "items", "packed"]


def _sides(make_vectors, items, queries, parts=None, ids=None):
    corpus = make_vectors(items, parts, ids)
    asked = make_vectors(queries).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return asked, corpus.select(F.col("vec_id").alias("item_id"), "part_id", F.col("embedding").alias("vec"))


@pytest.mark.parametrize("form", FORMS)
def test_topk_without_keys(make_vectors, form):
    rng = np.random.default_rng(0)
    items, queries = rng.normal(size=(300, 6)), rng.normal(size=(21, 6))
    items[100:200] = items[7]  # a third of the rows are copies
    asked, corpus = _sides(make_vectors, items, queries)
    rows = topk_join(asked, corpus, 4, strategy=form).collect()
    got = grouped(rows, ["qid"], "item_id", "rk")
    assert [got[i] for i in range(21)] == brute_topk(queries, items, np.arange(300), 4)


@pytest.mark.parametrize("form", FORMS)
def test_topk_per_part_with_a_part_smaller_than_k(make_vectors, form):
    rng = np.random.default_rng(1)
    items, queries = rng.normal(size=(120, 4)), rng.normal(size=(9, 4))
    parts = np.where(np.arange(120) < 80, 0, np.where(np.arange(120) < 118, 1, 2))
    asked, corpus = _sides(make_vectors, items, queries, parts)
    rows = topk_join(asked, corpus, 5, per=["part_id"], strategy=form).collect()
    got = grouped(rows, ["qid", "part_id"], "item_id", "rk")
    for part in (0, 1, 2):
        at = np.flatnonzero(parts == part)
        want = brute_topk(queries, items[at], at, 5)
        assert [got[(q, part)] for q in range(9)] == want
        assert len(want[0]) == min(5, len(at))


@pytest.mark.parametrize("form", ["queries", "packed"])
@pytest.mark.parametrize("per", [(), ("part_id",)])
def test_topk_with_probes_and_a_hot_key(spark, make_vectors, form, per, monkeypatch):
    monkeypatch.setattr(match, "_PACK_ROWS", 7)  # many blocks and stripes per key
    monkeypatch.setattr(match, "_STRIPE_PACKS", 2)
    rng = np.random.default_rng(2)
    items, queries = rng.normal(size=(200, 4)), rng.normal(size=(30, 4))
    parts = np.where(np.arange(200) < 140, 0, np.arange(200) % 5)
    asked, corpus = _sides(make_vectors, items, queries, parts)
    pairs = [(q, p) for q in range(30) for p in range(6) if p == 0 or (q + p) % 3 == 0]  # part 5 does not exist
    probes = spark.createDataFrame(pairs, "qid bigint, part_id int")
    rows = topk_join(asked, corpus, 3, on=["part_id"], per=per, probes=probes, strategy=form).collect()
    got = grouped(rows, ["qid", *per], "item_id", "rk")
    want = {}
    for q in range(30):
        groups = [{p for qq, p in pairs if qq == q}] if not per else [{p} for qq, p in pairs if qq == q]
        for group in groups:
            at = np.flatnonzero(np.isin(parts, list(group)))
            if len(at):
                key = (q, *group) if per else q
                want[key] = brute_topk(queries[q : q + 1], items[at], at, 3)[0]
    assert got == want


@pytest.mark.parametrize("form", FORMS)
def test_no_items(make_vectors, form):
    rng = np.random.default_rng(3)
    asked, corpus = _sides(make_vectors, rng.normal(size=(10, 4)), rng.normal(size=(3, 4)))
    assert topk_join(asked, corpus.where("item_id < 0"), 4, strategy=form).count() == 0


def test_auto_picks_the_side_that_fits(make_vectors):
    rng = np.random.default_rng(4)
    items, queries = rng.normal(size=(50, 4)), rng.normal(size=(20, 4))
    asked, corpus = _sides(make_vectors, items, queries)
    want = brute_topk(queries, items, np.arange(50), 2)
    for limit in (0, 20 * 32, 1 << 20):  # neither side, the queries only, both
        got = grouped(topk_join(asked, corpus, 2, limit_bytes=limit).collect(), ["qid"], "item_id", "rk")
        assert [got[i] for i in range(20)] == want


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_nearest_centroid(spark, make_vectors, metric, limit):
    rng = np.random.default_rng(5)
    items, centroids = rng.normal(size=(90, 3)).astype(np.float32).astype(float), rng.normal(size=(8, 3))
    parts = np.arange(90) % 3
    rows = [(int(i % 2), int(i), [float(x) for x in c]) for i, c in enumerate(centroids)]  # part 2 has none
    table = spark.createDataFrame(rows, "part_id int, list_id int, centroid array<double>")
    every = make_vectors(items, parts)
    with pytest.raises(Exception, match="has no centroid"):
        nearest_centroid(every, table, on=["part_id"], metric=metric, limit_bytes=limit).collect()
    found = nearest_centroid(every.where("part_id < 2"), table, on=["part_id"], metric=metric, limit_bytes=limit)
    got = {r.vec_id: r.list_id for r in found.collect()}
    want = {}
    for i in np.flatnonzero(parts < 2):
        at = np.flatnonzero(np.arange(8) % 2 == parts[i])
        score = centroids[at] @ items[i] if metric == "ip" else -((centroids[at] - items[i]) ** 2).sum(axis=1)
        want[int(i)] = int(at[np.lexsort((at, -score))[0]])
    assert got == want


def test_result_does_not_depend_on_partitioning(spark, make_vectors):
    rng = np.random.default_rng(6)
    items, queries = np.round(rng.normal(size=(200, 3)), 1), np.round(rng.normal(size=(10, 3)), 1)
    seen = set()
    for partitions in (1, 7):
        asked = make_vectors(queries, partitions=partitions).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
        corpus = make_vectors(items, partitions=partitions).select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
        for form in FORMS:
            rows = topk_join(asked, corpus, 6, strategy=form).orderBy("qid", "rk").collect()
            seen.add(tuple((r.qid, r.rk, r.item_id, r.score) for r in rows))
    assert len(seen) == 1


def test_repeated_ids_keep_their_rows(spark, make_vectors):
    items = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.1]])
    table = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])], "part_id int, list_id int, centroid array<double>")
    rows = make_vectors(items, ids=[7, 7, 8])
    for limit in (0, 1 << 20):
        found = nearest_centroid(rows, table, on=["part_id"], limit_bytes=limit).collect()
        assert sorted((r.vec_id, r.list_id) for r in found) == [(7, 0), (7, 1), (8, 0)]


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("bad", [[float("nan"), 1.0], [float("inf"), 1.0], [1.0], None])
def test_a_bad_vector_is_an_error_in_every_form(spark, make_vectors, form, bad):
    asked = make_vectors(np.eye(2)).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    corpus = make_vectors(np.eye(2)).select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    dirty = corpus.union(spark.createDataFrame([(9, bad)], "item_id bigint, vec array<float>"))
    with pytest.raises(Exception, match="reached a kernel"):
        topk_join(asked, dirty, 1, strategy=form).collect()


@pytest.mark.parametrize("form", FORMS)
def test_components_beyond_float32(make_vectors, form):
    rng = np.random.default_rng(8)
    scale = 10.0 ** rng.integers(-30, 30, size=(120, 1)).astype(float)
    items = (rng.normal(size=(120, 5)) * scale).astype(np.float32).astype(float)
    queries = (rng.normal(size=(15, 5)) * 10.0 ** rng.integers(-25, 25, size=(15, 1)).astype(float)).astype(np.float32).astype(float)
    asked, corpus = _sides(make_vectors, items, queries)
    got = grouped(topk_join(asked, corpus, 4, strategy=form).collect(), ["qid"], "item_id", "rk")
    want = brute_topk(queries, items, np.arange(120), 4)
    assert [got[i] for i in range(15)] == want


def test_a_large_query_side_is_cut_to_the_state(make_vectors, monkeypatch):
    from vectorloom.operators import match

    rng = np.random.default_rng(9)
    items, queries = rng.normal(size=(60, 4)), rng.normal(size=(25, 4))
    asked, corpus = _sides(make_vectors, items, queries)
    monkeypatch.setattr(match, "_STATE_ROWS", 30)
    got = grouped(topk_join(asked, corpus, 3, strategy="queries").collect(), ["qid"], "item_id", "rk")
    assert [got[i] for i in range(25)] == brute_topk(queries, items, np.arange(60), 3)


@pytest.mark.parametrize("on", [(), ("part_id",)])
def test_one_key_is_dealt_over_a_grid(spark, make_vectors, on, monkeypatch):
    monkeypatch.setattr(match, "_PACK_ROWS", 10)
    monkeypatch.setattr(match, "_STRIPE_PACKS", 1)
    rng = np.random.default_rng(10)
    items, queries = rng.normal(size=(200, 4)), rng.normal(size=(150, 4))
    asked, corpus = _sides(make_vectors, items, queries)
    asked = asked.withColumn("part_id", F.lit(0)) if on else asked
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        blocks = match._keyed_blocks(asked, corpus, list(on), [], None) if on else match._striped_blocks(asked, corpus, [])
        cells = [b.groupBy("query_stripe", "item_stripe").count().collect() for b in blocks[:2]]
        for side in cells:
            assert len(side) > 100  # cells of a single key
            assert max(c["count"] for c in side) <= 8 * np.median([c["count"] for c in side])
        rows = topk_join(asked, corpus, 4, on=on, strategy="packed").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = grouped(rows, ["qid"], "item_id", "rk")
    assert [got[i] for i in range(150)] == brute_topk(queries, items, np.arange(200), 4)


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("on", [(), ("part_id",)])
def test_packed_assignment_deals_rows_and_keeps_all_columns(spark, make_vectors, metric, on, monkeypatch):
    monkeypatch.setattr(match, "_PACK_ROWS", 4)
    monkeypatch.setattr(match, "_STRIPE_PACKS", 2)
    rng = np.random.default_rng(11)
    items, centroids = np.round(rng.normal(size=(120, 3)), 1), np.round(rng.normal(size=(13, 3)), 1)
    rows = make_vectors(items, ids=np.arange(120) // 2).withColumns({"m": F.create_map(F.lit("a"), "vec_id"), "x": F.lit(None).cast("string")})
    columns = "part_id int, list_id int, centroid array<double>" if on else "list_id int, centroid array<double>"
    table = spark.createDataFrame([((0,) if on else ()) + (i, [float(v) for v in c]) for i, c in enumerate(centroids)], columns)
    broadcast = nearest_centroid(rows, table, on=on, metric=metric)
    packed = nearest_centroid(rows, table, on=on, metric=metric, limit_bytes=0)
    assert packed.columns == broadcast.columns
    assert sorted(map(str, packed.collect())) == sorted(map(str, broadcast.collect()))


def test_packed_assignment_finds_no_row_again(spark, tmp_path, make_vectors):
    make_vectors(np.eye(3)).write.parquet(str(tmp_path / "rows"))
    table = spark.createDataFrame([(0, 0, [1.0, 0.0, 0.0])], "part_id int, list_id int, centroid array<double>")
    rows = spark.read.parquet(str(tmp_path / "rows"))
    plan = nearest_centroid(rows, table, on=["part_id"], limit_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("embedding#") and "xxhash64(vec_id" not in plan
    wide = [line for line in plan.splitlines() if "FileScan" in line and "embedding" in line.split("ReadSchema")[1]]
    assert len(wide) == 1  # the vectors are read once


@pytest.mark.parametrize("per", [(), ("part_id",)])
def test_many_queries_go_in_shares_of_bounded_size(make_vectors, per, monkeypatch):
    """A task holds a bounded number of queries however many there are, and lists that tasks have cut to k aren't sorted before the shuffle."""
    rng = np.random.default_rng(5)
    items, queries = rng.normal(size=(150, 4)), rng.normal(size=(60, 4))
    asked, corpus = _sides(make_vectors, items, queries, np.arange(150) % 3)
    monkeypatch.setattr(match, "_SHARE_BYTES", 15 * 8 * 4, raising=False)
    held, broadcast = [], match._queries_broadcast

    def counted(own, *rest):
        held.append(own.count())
        return broadcast(own, *rest)

    monkeypatch.setattr(match, "_queries_broadcast", counted)
    hits = topk_join(asked, corpus, 3, per=per, strategy="queries")
    rows = hits.collect()
    assert sum(held) == 60 and max(held) < 30
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Partial" not in plan
    got = grouped(rows, ["qid", *per], "item_id", "rk")
    for part in range(3) if per else [None]:
        at = np.arange(150) if part is None else np.flatnonzero(np.arange(150) % 3 == part)
        assert [got[q if part is None else (q, part)] for q in range(60)] == brute_topk(queries, items[at], at, 3)


def test_a_repeated_query_has_the_same_rows_when_items_are_broadcast_in_place_of_queries(make_vectors):
    rng = np.random.default_rng(6)
    items, queries = rng.normal(size=(40, 4)), rng.normal(size=(6, 4))
    asked, corpus = _sides(make_vectors, items, queries)
    twice = asked.unionByName(asked)
    rows = [sorted(map(tuple, topk_join(twice, corpus, 4, strategy=form).collect())) for form in FORMS]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 6 * 4
