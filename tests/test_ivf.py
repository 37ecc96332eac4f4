from __future__ import annotations

import numpy as np
import pytest
from conftest import brute_topk, grouped
from pyspark.sql import functions as F

from vectorloom.functions.kernels import sq8_decode
from vectorloom.operators import ivf, search
from vectorloom.operators.kmeans import kmeans_fit
from vectorloom.sources.index_store import index_extend, index_read, index_write, postings_manifest
from vectorloom.streaming.append import stream_index_append

DIM = 6


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    matrix = rng.normal(size=(400, DIM)).astype(np.float32)
    parts = np.minimum(np.arange(400) // 130, 3)  # 130, 130, 130, 10
    matrix[parts == 1, 2] = 0.25  # a constant dimension
    return matrix, parts, rng.normal(size=(15, DIM)).astype(np.float32)


@pytest.fixture(scope="module")
def corpus(make_vectors, data):
    return make_vectors(data[0], data[1]).cache()


@pytest.fixture(scope="module")
def queries(make_vectors, data):
    return make_vectors(data[2]).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")).cache()


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    index_write(ivf.build_index(corpus, niter=3), path)
    return index_read(spark, path)


def _decoded(index, data):
    """Stored vectors as the search sees them, in id order."""
    ranges = {r.part_id: (np.array(r.vmin), np.array(r.vdiff)) for r in index.sq.collect()}
    out = np.zeros((len(data[0]), DIM))
    for r in index.postings.collect():
        out[r.vec_id] = sq8_decode(np.frombuffer(r.code, np.uint8)[None], *ranges[r.part_id])[0]
    return out


def _brute_lloyd(x, start, niter):
    c = start.copy()
    for _ in range(niter):
        a = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for j in range(len(c)):
            if (a == j).any():
                c[j] = x[a == j].mean(axis=0)
    return c


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_kmeans_both_forms_match_plain_lloyd(corpus, data, limit):
    x = data[0].astype(float)
    want = _brute_lloyd(x, x[[j * 400 // 7 for j in range(7)]], 4)
    got = kmeans_fit(corpus, 7, niter=4, limit_bytes=limit).orderBy("cluster_id").collect()
    assert [r.cluster_id for r in got] == list(range(7))
    assert np.allclose([r.centroid for r in got], want, atol=1e-9)


def test_kmeans_needs_enough_vectors(corpus):
    with pytest.raises(ValueError):
        kmeans_fit(corpus.limit(3), 7)


def test_every_vector_is_stored_once_in_its_own_part(index, data):
    rows = {r.vec_id: r.part_id for r in index.postings.collect()}
    assert rows == {i: int(p) for i, p in enumerate(data[1])}
    assert {r.part_id: r.n for r in index.coarse.groupBy("part_id").agg(F.count("*").alias("n")).collect()} == {
        0: 11, 1: 11, 2: 11, 3: 3,
    }
    assert postings_manifest(index).agg(F.sum("n_rows")).head()[0] == 400


def test_constant_dimension_survives_the_codes(index, data):
    decoded = _decoded(index, data)
    assert np.allclose(decoded[data[1] == 1, 2], 0.25)


def test_all_lists_probed_equals_scan_of_decoded_vectors(index, queries, data):
    decoded = _decoded(index, data)
    want = []
    for q in data[2].astype(float):
        score = (decoded * q).sum(axis=1)
        want.append([int(i) for i in np.lexsort((np.arange(400), -score))[:5]])
    for hits in (
        ivf.ivf_topk(queries, index, 5, 99),
        search.routed_search(queries, index, 4, 5, sample_nprobe=2, deep_nprobe=99),
        ivf.ivf_topk(queries, index, 5, 99, strategy="packed"),
    ):
        got = grouped(hits.collect(), ["qid"], "vec_id", "rk")
        assert [got[i] for i in range(15)] == want


def test_few_lists_are_searched_alike_by_both_forms(index, queries):
    small = ivf.ivf_topk(queries, index, 4, 2).orderBy("qid", "rk").collect()
    packed = ivf.ivf_topk(queries, index, 4, 2, strategy="packed").orderBy("qid", "rk").collect()
    assert small == packed
    none_fits = ivf.ivf_topk(queries, index, 4, 2, limit_bytes=0).orderBy("qid", "rk").collect()
    assert small == none_fits


def test_routing_with_all_parts_equals_exact(corpus, queries, data):
    want = brute_topk(data[2], data[0], np.arange(400), 5)
    got = grouped(search.exact_routed_search(queries, corpus, 4, 5).collect(), ["qid"], "vec_id", "rk")
    assert [got[i] for i in range(15)] == want


def test_routed_search_step_by_step(index, queries, data):
    decoded, parts = _decoded(index, data), data[1]
    lists = {r.vec_id: r.list_id for r in index.postings.collect()}
    coarse = {}
    for r in index.coarse.collect():
        coarse.setdefault(r.part_id, {})[r.list_id] = np.array(r.centroid)
    k, c, shallow, deep = 4, 2, 1, 3
    got = grouped(search.routed_search(queries, index, c, k, shallow, deep).collect(), ["qid"], "vec_id", "rk")
    for q, vector in enumerate(data[2].astype(float)):
        def members(part, nprobe):
            best = sorted(coarse[part], key=lambda j: (-(coarse[part][j] @ vector), j))[:nprobe]
            return [i for i in np.flatnonzero(parts == part) if lists[i] in best]

        def top(ids):
            return sorted(ids, key=lambda i: (-float((decoded[i] * vector).sum()), i))[:k]

        means = {}
        for part in coarse:
            ids = top(members(part, shallow))
            if ids:  # missing hits do not count
                means[part] = np.mean([decoded[i] @ vector for i in ids])
        chosen = sorted(means, key=lambda p: (-means[p], p))[:c]
        assert got[q] == [int(i) for i in top([i for p in chosen for i in members(p, deep)])]


def test_part_smaller_than_k_gives_what_it_has(index, queries):
    hits = search.sample_search(queries, index, 50, 99).where("part_id = 3")
    assert {r.n for r in hits.groupBy("qid").agg(F.count("*").alias("n")).collect()} == {10}


def test_append_equals_build_and_join_form(index, corpus):
    want = {(r.part_id, r.list_id, r.vec_id, bytes(r.code)) for r in index.postings.collect()}
    for limit in (0, 1 << 20):
        made = ivf.index_append(index, corpus, limit_bytes=limit).collect()
        assert {(r.part_id, r.list_id, r.vec_id, bytes(r.code)) for r in made} == want


def test_encode_and_decode_rows(index, corpus, data):
    for limit in (0, 1 << 20):
        coded = ivf.sq8_encode_rows(corpus, index.sq, limit)
        back = {r.vec_id: r.decoded for r in ivf.sq8_decode_rows(coded, index.sq, limit).collect()}
        assert np.allclose([back[i] for i in range(400)], _decoded(index, data))


def _rows(postings):
    return sorted((r.part_id, r.list_id, r.vec_id, bytes(r.code)) for r in postings.collect())


def _store(index, path, kept):
    """An index file that holds only the vectors of ``kept``."""
    index_write(ivf.IvfIndex(index.coarse, index.sq, ivf.pack_postings(index.postings.where(kept))), path)


@pytest.mark.parametrize("limits", [(0, 0), (1 << 20, 1 << 20), (0, 1 << 20), (1 << 20, 0)])
def test_additions_by_batch_and_stream_are_read_once(spark, index, corpus, tmp_path, limits):
    """Half written, the rest added by batch and by a stream whose form changes in between; all rows come back once."""
    path = str(tmp_path / "index")
    _store(index, path, "vec_id % 4 < 2")
    before = index_read(spark, path)
    frozen = [sorted(map(str, t.collect())) for t in (before.coarse, before.sq)]
    index_extend(spark, path, corpus.where("vec_id % 4 = 2"), limit_bytes=limits[0])
    for n, limit in enumerate(limits):
        folder = corpus.where(f"vec_id % 4 = 3 and vec_id % 8 = {3 + 4 * n}")
        folder.repartition(3, "vec_id").write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):  # a second run finds nothing new
            arrivals = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            stream_index_append(arrivals, path, str(tmp_path / "cp"), limit_bytes=limit).awaitTermination()
    after = index_read(spark, path)
    assert _rows(after.postings) == _rows(index.postings)
    assert [sorted(map(str, t.collect())) for t in (after.coarse, after.sq)] == frozen


def test_an_addition_of_the_same_name_replaces_itself(spark, index, corpus, tmp_path):
    path = str(tmp_path / "index")
    _store(index, path, "vec_id % 2 = 0")
    for _ in range(2):
        index_extend(spark, path, corpus.where("vec_id % 2 = 1"), "odd")
    assert _rows(index_read(spark, path).postings) == _rows(index.postings)
    _store(index, path, "vec_id < 10")  # writing anew drops the additions
    assert len(_rows(index_read(spark, path).postings)) == 10
    with pytest.raises(ValueError, match="index_extend"):
        index_write(index, path, mode="append")


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_unknown_parts_and_missing_ranges_are_errors(spark, index, corpus, queries, limit):
    """The same outcome in the broadcast and the join forms: an error, never fewer rows; an empty part is no error."""
    stray = corpus.limit(3).withColumn("part_id", F.lit(77))
    for rows in (stray, corpus.unionByName(stray)):
        with pytest.raises(Exception, match="part 77|part has no centroid"):
            ivf.index_append(index, rows, limit_bytes=limit).collect()
        with pytest.raises(Exception, match="part 77"):
            ivf.sq8_encode_rows(rows, index.sq, limit).collect()
    lame = ivf.IvfIndex(index.coarse, index.sq.where("part_id <> 1"), index.blocks)
    with pytest.raises(Exception, match="part 1 has no code range"):
        ivf.index_append(lame, corpus, limit_bytes=limit).collect()
    with pytest.raises(Exception, match="part 1 has no code range"):
        ivf.ivf_topk(queries, lame, 5, 99, limit_bytes=limit).collect()
    nobody = ivf.IvfIndex(index.coarse, index.sq, index.blocks.where("part_id <> 1"))
    assert ivf.ivf_topk(queries, nobody, 5, 99, limit_bytes=limit).count() == 15 * 5
    assert ivf.index_append(index, corpus.where("part_id <> 1"), limit_bytes=limit).count() == corpus.where("part_id <> 1").count()


def test_split_search_ignores_later_splits(corpus, queries, data):
    at = np.flatnonzero(data[1] < 2)
    want = brute_topk(data[2], data[0][at], at, 5)
    got = grouped(search.split_search(queries, corpus, 2, 5).collect(), ["qid"], "vec_id", "rk")
    assert [got[i] for i in range(15)] == want


def test_ranked_trace_lists_all_parts(index, queries):
    trace = search.ranked_trace(search.route(queries, index, 1, 2)).collect()
    assert len(trace) == 15
    assert all(sorted(r.ranked) == [0, 1, 2, 3] for r in trace)


def test_batched_search_equals_exact(corpus, queries):
    batched = search.batched_search(queries, corpus, 3, batch=4).orderBy("qid", "rk").collect()
    exact = search.exact_topk(queries, corpus, 3).orderBy("qid", "rk").collect()
    assert [(r.qid, r.rk, r.vec_id) for r in batched] == [(r.qid, r.rk, r.vec_id) for r in exact]
    assert all(r.qblock == r.qid // 4 for r in batched)


def test_batches_are_runs_of_queries_whatever_their_ids(corpus, queries):
    gapped = queries.withColumn("qid", F.col("qid") * 100 + 7)
    batched = search.batched_search(gapped, corpus, 1, batch=4).collect()
    assert sorted((r.qid, r.qblock) for r in batched) == [(100 * i + 7, i // 4) for i in range(15)]
