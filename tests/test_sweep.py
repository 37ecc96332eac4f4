"""The one-pass sweep against one search per setting."""

from __future__ import annotations

import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import ivf, match, quality, search, sizing
from vectorloom.operators.partition import single_partition, split_partition
from vectorloom.plans import sweep
from vectorloom.plans.sweep import accuracy_run, quality_sweep
from vectorloom.sources import runs


def test_sweep_equals_separate_searches(spark, make_vectors, tmp_path):
    rng = np.random.default_rng(0)
    corpus = make_vectors(rng.normal(size=(150, 5)), np.arange(150) % 3).cache()
    queries = make_vectors(rng.normal(size=(12, 5))).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")).cache()
    plain = corpus.select("vec_id", "embedding")
    indexes = []
    for parts in (single_partition(plain), split_partition(plain, 3), corpus):
        made = ivf.build_index(parts.select("part_id", "vec_id", "embedding"), 1)
        indexes.append(ivf.IvfIndex(made.coarse, made.sq, made.blocks.cache()))
    mono, splits, clusters = indexes
    table = quality_sweep(
        queries, plain, mono, splits, clusters, n_parts=3, sample_nprobe=[1, 3], deep_nprobe=[1, 2], k=[2, 4], monolithic_nprobe=3
    )
    got = {(r.sample_nprobe, r.deep_nprobe, r.k, r.c): r for r in table.collect()}
    assert len(got) == 2 * 2 * 2 * 3

    def means(hits, k):
        rows = quality.query_quality(hits, search.exact_topk(queries, plain, k)).agg(F.avg("recall"), F.avg("ndcg")).head()
        return pytest.approx(tuple(rows))

    for s, d, k, c in [(1, 1, 2, 1), (3, 2, 4, 2), (1, 2, 4, 3), (3, 1, 2, 2)]:
        row = got[(s, d, k, c)]
        assert (row.monolithic_recall, row.monolithic_ndcg) == means(ivf.ivf_topk(queries, mono, k, 3), k)
        assert (row.split_recall, row.split_ndcg) == means(search.ivf_split_search(queries, splits, c, k, d), k)
        assert (row.routed_recall, row.routed_ndcg) == means(search.routed_search(queries, clusters, c, k, s, d), k)

    runs.result_sink(accuracy_run(table.where("k = 4")), str(tmp_path / "accuracy"))
    back = runs.metrics_csv(spark, str(tmp_path / "accuracy"), runs.ACCURACY_RUN, ["Sample nProbe", "nProbe"])
    rows = {(r.sample_nprobe, r.deep_nprobe, r.clusters_searched): r for r in runs.canonical_names(back).collect()}
    assert rows[(3, 2, 2)]["Cluster NDCG"] == pytest.approx(got[(3, 2, 4, 2)].routed_ndcg)
    assert len(rows) == 2 * 2 * 3


def test_sweep_goes_in_rounds_and_deals_hits_by_query_alone(spark, make_vectors, monkeypatch):
    """The same table whether queries go at once or in rounds; no search has all of them, and hits aren't shuffled by query, part and list."""
    rng = np.random.default_rng(1)
    corpus = make_vectors(rng.normal(size=(80, 4)), np.arange(80) % 2)
    plain = corpus.select("vec_id", "embedding")
    queries = make_vectors(rng.normal(size=(40, 4))).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    parts = (single_partition(plain), split_partition(plain, 2), corpus)
    indexes = [ivf.build_index(p.select("part_id", "vec_id", "embedding"), 1) for p in parts]
    asking, plans, search_probed, list_hits = [], [], sweep.search_probed, sweep.list_hits

    def searched(queries, *args, **options):
        asking.append(queries.count())
        return search_probed(queries, *args, **options)

    def found(*args, **options):
        hits = list_hits(*args, **options)
        plans.append(hits._jdf.queryExecution().executedPlan().toString())
        return hits

    def run():
        table = quality_sweep(queries, plain, *indexes, n_parts=2, sample_nprobe=[1], deep_nprobe=[1, 2], k=[3], monolithic_nprobe=2)
        return {tuple(r)[:4]: tuple(r)[4:] for r in table.collect()}

    whole = run()
    monkeypatch.setattr(sweep, "search_probed", searched)
    monkeypatch.setattr(sweep, "list_hits", found)
    monkeypatch.setattr(sweep, "_ROUND_PROBES", 40 * 10 // 2, raising=False)  # a query probes ten lists
    monkeypatch.setattr(match, "_SHARE_BYTES", 4 * 8 * 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rounds = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(whole) == 4 and rounds.keys() == whole.keys()
    assert all(rounds[setting] == pytest.approx(values) for setting, values in whole.items())
    assert not [p for p in plans if re.search(r"hashpartitioning\(qid#\d+L?, part_id", p)]
    assert len(asking) == 2 and max(asking) < 40 and sum(asking) == 40


def test_files_of_dropped_tables_are_let_go(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = [Path(d.getPath()) for d in env.blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for folder in folders for f in folder.glob("*/shuffle_*.data")}

    before = files()
    table = spark.range(1000).repartition(3, "id").groupBy("id").count()
    assert len(table.collect()) == 1000
    made = files() - before
    assert made
    del table
    until = time.time() + 30
    while made & files() and time.time() < until:
        sizing.let_go(spark)
        time.sleep(0.2)
    assert not made & files()
