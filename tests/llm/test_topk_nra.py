import math
import random

from vectorloom.llm.topk_nra import exact_topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, rank string, g string"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "own", "own", "own") for i, v in rows], SCHEMA).repartition(4)


def _brute(rows, k=5, every=50, scale=256):
    import numpy as np

    good = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for q in {i for i, _ in good if i % every == 0}:
        mine = min(v for i, v in good if i == q)
        found = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in good if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


def _check(spark, rows, **options):
    got = exact_topk(_table(spark, rows), **options).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == _brute(rows, **options)


def test_random_vectors(spark, monkeypatch):
    from vectorloom.llm import topk_nra

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(700)]
    _check(spark, rows)
    monkeypatch.setattr(topk_nra, "ITEM_BLOCK", 64)
    monkeypatch.setattr(topk_nra, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk_nra, "QUERIES_AT_ONCE", 3)
    _check(spark, rows)
    _check(spark, [(i, [abs(x) for x in v]) for i, v in rows], k=3)


def test_ties_bad_vectors_and_repeated_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, -0.5]) for _ in range(3)]) for i in range(120)]
    rows += [(130, None), (150, [1.0, None, 0.0]), (200, [float("nan"), 1.0, 0.0]), (250, [float("inf"), 1.0, 0.0]), (None, [9.0, 9.0, 9.0])]
    rows += [(7, [1.0, 1.0, 1.0])] * 3 + [(300, [0.0, 0.0, 0.0]), (350, [1e5, -1e5, 1e5])]
    _check(spark, rows)


def test_fewer_candidates_and_empty_table(spark):
    _check(spark, [(0, [1.0]), (50, [2.0]), (3, [-1.0])])
    _check(spark, [(0, [1.0])])
    assert exact_topk(_table(spark, [])).collect() == []
