from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from vectorloom.operators import quality

HITS = "qid bigint, rk int, vec_id bigint"


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame([(q, r + 1, d) for q in (1, 2, 3) for r, d in enumerate((10, 11, 12))], HITS)


def test_hand_computed_scores(spark, truth):
    hits = spark.createDataFrame([(1, 1, 11), (1, 2, 99), (1, 3, 10), (2, 1, 98), (2, 2, 97)], HITS)
    rows = {r.qid: r for r in quality.query_quality(hits, truth).collect()}
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert rows[1].n_hits == 2 and rows[1].recall == pytest.approx(2 / 3)
    assert rows[1].dcg == pytest.approx(1 + 1 / math.log2(4))
    assert rows[1].ndcg == pytest.approx((1 + 1 / math.log2(4)) / ideal)
    # nothing relevant, and nothing retrieved at all: both score 0
    for q in (2, 3):
        assert (rows[q].n_hits, rows[q].recall, rows[q].dcg, rows[q].ndcg) == (0, 0.0, 0.0, 0.0)
    overlap = {(r.qid, r.vec_id): r.hit for r in quality.ground_truth_overlap(hits, truth).collect()}
    assert overlap == {(1, 11): 1, (1, 99): 0, (1, 10): 1, (2, 98): 0, (2, 97): 0}
    assert quality.hit_rows(hits, truth).count() == 2
    assert quality.miss_rows(hits, truth).count() == 3


def test_truth_against_itself_is_perfect(truth):
    for r in quality.query_quality(truth, truth).collect():
        assert (r.recall, r.ndcg) == (1.0, pytest.approx(1.0))


def test_settings_are_scored_apart_and_pivoted(spark, truth):
    rows = [(1, 1, 1, 10), (1, 1, 2, 11), (2, 1, 1, 10), (2, 1, 2, 11), (2, 1, 3, 12)]
    hits = spark.createDataFrame(rows, "c int, qid bigint, rk int, vec_id bigint")
    scored = quality.query_quality(hits, truth, ["c"]).withColumn("strategy", F.lit("a"))
    assert {r.c: r.recall for r in scored.collect()} == {1: pytest.approx(2 / 3), 2: 1.0}
    table = quality.quality_by_config(scored, ["c"], ["a", "b"])
    assert table.columns == ["c", "a_recall", "a_ndcg", "b_recall", "b_ndcg"]
    assert {r.c: r.b_recall for r in table.collect()} == {1: None, 2: None}


def test_quality_by_config_searches_everything_twice_not_three_times(spark, tmp_path, monkeypatch):
    """The exact lists are the best of the clusters' lists, so the corpus is searched once per kind of part and never for them alone."""
    from vectorloom.operators import search
    from vectorloom.plans import catalog

    rows = [(i, [float((i * 7 + d * 3) % 11 - 5) for d in range(4)], i % 10) for i in range(120)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    passes, join = [], search.topk_join
    monkeypatch.setattr(search, "topk_join", lambda *a, **b: passes.append(b.get("per")) or join(*a, **b))
    found = {r.c: r for r in catalog.quality_by_config(spark, str(tmp_path)).collect()}
    assert passes == [["part_id"]] * 2
    # all parts searched exactly: the exact result itself
    assert sorted(found) == list(range(1, 11))
    assert [found[10][n] for n in ("split_recall", "routed_recall", "split_ndcg", "routed_ndcg")] == [1.0] * 4
