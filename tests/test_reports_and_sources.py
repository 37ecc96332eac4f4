from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import reports
from vectorloom.plans import catalog
from vectorloom.sources import runs, tables


def test_trimmed_mean_of_small_and_large_groups(spark):
    rows = [("four", i, v) for i, v in enumerate([1.0, 100.0, 2.0, 3.0])]
    rows += [("five", 10 + i, v) for i, v in enumerate([1.0, 100.0, 2.0, 3.0, 50.0])]
    rows += [("ties", 20 + i, v) for i, v in enumerate([5.0] * 6)]
    rows += [("gap", 30, None), ("gap", 31, 4.0)]
    log = spark.createDataFrame(rows, "g string, id bigint, v double")
    got = {r.g: (r.n_rows, r.n_used, r.trimmed_mean) for r in reports.trimmed_mean(log, ["g"], "v", "id").collect()}
    assert got == {"four": (4, 4, 26.5), "five": (5, 1, 3.0), "ties": (6, 2, 5.0), "gap": (1, 1, 4.0)}


def test_series_reports(spark):
    series = spark.createDataFrame(
        [(1, "base", 2.0), (1, "fast", 1.0), (2, "base", 0.0), (2, "fast", 3.0), (3, "fast", 4.0)], "c int, name string, v double"
    )
    relative = reports.normalise_to_baseline(series, ["c"], "name", "base", "v")
    assert {(r.c, r.name): r.relative for r in relative.collect()} == {
        (1, "base"): 1.0, (1, "fast"): 0.5, (2, "base"): None, (2, "fast"): None, (3, "fast"): None,
    }
    named = {n: series.where(F.col("name") == n) for n in ("base", "fast")}
    aligned = {r.c: (r.base, r.fast) for r in reports.align_series(named, "c", "v").collect()}
    assert aligned == {1: (2.0, 1.0), 2: (0.0, 3.0), 3: (None, 4.0)}
    means = {r.name: r.v for r in reports.group_means(series, ["name"], ["v"]).collect()}
    assert means == {"base": 1.0, "fast": pytest.approx(8 / 3)}
    assert reports.config_select(series, {"c": 2, "name": "fast"}).head().v == 3.0
    paired = reports.zip_series(named["base"].select("c", F.col("v").alias("a")), named["fast"].select("c", F.col("v").alias("b")), ["c"])
    assert sorted(map(tuple, paired.collect())) == [(1, 2.0, 1.0), (2, 0.0, 3.0)]
    levels = {(r.column, r.level): r.n_levels for r in reports.distinct_levels(series, ["c", "name"]).collect()}
    assert levels == {("c", "1"): 3, ("c", "2"): 3, ("c", "3"): 3, ("name", "base"): 2, ("name", "fast"): 2}


def test_typed_csv_drops_junk_rows(spark, tmp_path):
    header = ",".join(f.name for f in runs.CLUSTER_PROFILE)
    (tmp_path / "a.csv").write_text(f"{header}\n0,1,8,5,32,0.0047\n,,,,,\n,,,,,0.5\n3,16,128,5,32,0.25")
    (tmp_path / "b.csv").write_text(f"{header}\n1,2,8,5,32,0.125\n")
    keys = ["Cluster ID", "Batch Size"]
    profile = runs.canonical_names(runs.metrics_csv(spark, str(tmp_path / "a.csv"), runs.CLUSTER_PROFILE, keys))
    assert profile.columns == ["cluster_id", "batch_size", "nprobe", "k", "threads", "latency_s"]
    assert sorted(map(tuple, profile.collect())) == [(0, 1, 8, 5, 32, 0.0047), (3, 16, 128, 5, 32, 0.25)]
    both = runs.multi_csv_labelled(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], runs.CLUSTER_PROFILE, keys)
    assert {r.run: r.n for r in both.groupBy("run").agg(F.count("*").alias("n")).collect()} == {"a.csv": 2, "b.csv": 1}


def test_result_sink_appends_with_header(spark, tmp_path):
    path = str(tmp_path / "out")
    for value in (1.5, 2.5):
        runs.result_sink(spark.createDataFrame([("busy", 800, int(value))], runs.POWER_PROFILE), path)
    got = runs.metrics_csv(spark, path, runs.POWER_PROFILE, ["State"])
    assert sorted(map(tuple, got.collect())) == [("busy", 800, 1), ("busy", 800, 2)]


def test_vector_validation(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0]), (3, [1.0, float("nan")]), (4, [1.0, None]), (5, [3.0, 4.0])]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert tuple(tables.vector_validate(corpus, 2).head()) == (6, 2, 1, 1, 2)
    assert sorted(r.vec_id for r in tables.valid_vectors(corpus, 2).collect()) == [0, 5]


def test_missing_columns_are_named(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="embedding"):
        tables.corpus_scan(spark, str(tmp_path / "t"))


def test_synthetic_vectors_do_not_depend_on_partitions(spark):
    one = tables.synthetic_vectors(spark.range(500, numPartitions=1), 8, seed=3, id_col="id")
    many = tables.synthetic_vectors(spark.range(500, numPartitions=7), 8, seed=3, id_col="id")
    a, b = ({r.vec_id: tuple(r.embedding) for r in df.collect()} for df in (one, many))
    assert a == b and len(set(a.values())) == 500
    matrix = np.array(list(a.values()))
    assert matrix.shape == (500, 8) and matrix.min() >= -1 and matrix.max() < 1
    assert abs(matrix.mean()) < 0.05 and abs(matrix.std() - 3**-0.5) < 0.02
    other = tables.synthetic_vectors(spark.range(500), 8, seed=4, id_col="id")
    assert set(a.values()).isdisjoint(tuple(r.embedding) for r in other.collect())


def test_query_set_takes_the_first_rows(spark, make_vectors):
    vectors = make_vectors(np.eye(6), ids=[50, 40, 30, 20, 10, 0])
    assert sorted(r.qid for r in tables.query_set(vectors, 3).collect()) == [0, 10, 20]
    assert tables.query_set(vectors).count() == 6


def test_trimmed_mean_keeps_a_null_key(spark):
    rows = [(None if i % 2 else "a", i, float(i)) for i in range(12)]
    got = reports.trimmed_mean(spark.createDataFrame(rows, "g string, id int, v double"), ["g"], "v", "id", trim=1).collect()
    assert {r.g: (r.n_rows, r.n_used, r.trimmed_mean) for r in got} == {"a": (6, 4, 5.0), None: (6, 4, 6.0)}


def test_result_sink_query_writes_every_status(spark, monkeypatch):
    schema = "l_returnflag string, l_linestatus string, c int, n bigint, mean_price double"
    rows = [("A", status, n, 1, 2.5) for n, status in enumerate(["F", "O", "P", "", None, None])]
    for given in (rows, []):
        monkeypatch.setattr(catalog, "_line_runs", lambda *_, given=given: spark.createDataFrame(given, schema))
        assert sorted(map(tuple, catalog.result_sink(spark, "").collect()), key=str) == sorted(given, key=str)


def _trimmed(values, trim):
    kept = sorted(values)[trim : len(values) - trim] if len(values) > 2 * trim else values
    return len(values), len(kept), sum(kept) / len(kept)


@pytest.mark.parametrize("trim", [0, 1, 2, 5])
def test_trimmed_mean_takes_rows_as_they_are(spark, trim):
    rng = random.Random(trim)
    rows = []
    for i in range(400):
        key = rng.choice([None, "a", "b", "rare"]) if i else "one"
        rows.append((key, rng.choice([None, 1, 2]), None if i % 9 == 0 and i else rng.choice([0.5, 1.5, 1e300, -1e300, 7.0, 3.0]), rng.choice([1, None])))
    log = spark.createDataFrame(rows, "g string, id int, v double, h int").repartition(5)
    got = {(r.g, r.h): (r.n_rows, r.n_used, r.trimmed_mean) for r in reports.trimmed_mean(log, ["g", "h"], "v", "id", trim=trim).collect()}
    want = {}
    for g, _, v, h in rows:
        if v is not None:
            want.setdefault((g, h), []).append(v)
    assert got.keys() == want.keys()
    for key, values in want.items():
        n, used, mean = _trimmed(values, trim)
        assert got[key][:2] == (n, used) and got[key][2] == pytest.approx(mean, rel=1e-9, abs=1e285)
    assert reports.trimmed_mean(log.where("g = 'none'"), ["g"], "v").collect() == []


def test_trimmed_mean_of_many_groups_and_nan(spark, monkeypatch):
    monkeypatch.setattr(reports, "_HELD_GROUPS", 3)
    log = spark.createDataFrame([(i % 50, float(i)) for i in range(500)], "g int, v double").coalesce(1)
    got = {r.g: r.trimmed_mean for r in reports.trimmed_mean(log, ["g"], "v").collect()}
    assert got == {g: g + 225.0 for g in range(50)}
    spiked = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 3.0, float("nan"))], "g int, v double")
    assert reports.trimmed_mean(spiked, ["g"], "v", trim=1).head().trimmed_mean == 2.5


def test_trimmed_mean_is_one_exchange(spark, tmp_path):
    spark.range(10).selectExpr("id % 2 AS g", "id * 0.5D AS v").write.parquet(str(tmp_path / "log"))
    plan = reports.trimmed_mean(spark.read.parquet(str(tmp_path / "log")), ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan


def test_a_null_key_finds_its_baseline(spark):
    series = spark.createDataFrame([(None, "base", 2.0), (None, "new", 6.0), (1, "base", 4.0), (1, "new", 2.0)], "k int, name string, v double")
    got = {(r.k, r.name): r.relative for r in reports.normalise_to_baseline(series, ["k"], "name", "base", "v").collect()}
    assert got == {(None, "base"): 1.0, (None, "new"): 3.0, (1, "base"): 1.0, (1, "new"): 0.5}
