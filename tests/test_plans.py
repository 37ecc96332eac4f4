"""Physical plans of the operators that carry the volume."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import ivf, querylog, reports, search
from vectorloom.sources.index_store import index_read, index_write


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, make_vectors, tmp_path_factory):
    rng = np.random.default_rng(0)
    path = str(tmp_path_factory.mktemp("plans"))
    corpus = make_vectors(rng.normal(size=(200, 4)), np.arange(200) % 4)
    corpus.withColumn("unused", F.lit("x")).write.parquet(f"{path}/corpus")
    index_write(ivf.build_index(corpus, 1), f"{path}/index")
    queries = make_vectors(rng.normal(size=(6, 4))).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return spark.read.parquet(f"{path}/corpus"), index_read(spark, f"{path}/index"), queries


def test_exact_search_shuffles_short_lists_only(stored):
    corpus, _, queries = stored
    plan = plan_of(search.exact_topk(queries, corpus, 3))
    assert plan.count("Exchange") == 1  # the per-task top-k lists
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial") < plan.index("MapInArrow")
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_routed_search_prunes_parts_and_lists(stored):
    _, index, queries = stored
    plan = plan_of(search.routed_search(queries.where("qid = 0"), index, 1, 3, 1, 2))
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    assert len(re.findall(r"part_id#\d+ = \d", filters)) == 1  # one of four folders
    assert "LeftSemi" in plan
    assert re.search(r"PushedFilters: \[(In|EqualTo|Or\(EqualTo)\(list_id", plan)  # row groups of other lists are skipped


def test_small_centroid_sets_assign_without_a_shuffle(stored):
    corpus, index, _ = stored
    assert "Exchange" not in plan_of(ivf.index_append(index, corpus))
    assert "Exchange" not in plan_of(ivf.probe_lists(corpus.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), index.coarse, 2))


def test_manifest_reads_no_codes(spark, stored):
    plan = plan_of(stored[1].blocks.groupBy("part_id", "list_id").agg(F.sum(F.size("vec_ids"))))
    assert "codes" not in plan


def test_trimmed_mean_limits_before_the_shuffle(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 2 AS g", "id * 0.5D AS v", "'x' AS wide").write.parquet(str(tmp_path / "log"))
    plan = plan_of(reports.trimmed_mean(spark.read.parquet(str(tmp_path / "log")), ["g"], "v", "id"))
    below = plan[plan.index("Exchange") :]  # what tasks do before the shuffle: bounded states, added up
    assert plan.count("Exchange") == 1 and "partial" in below and "MapInArrow" in below and "wide" not in plan


def test_selection_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 2 AS g", "id % 5 AS h").write.parquet(str(tmp_path / "runs"))
    plan = plan_of(reports.config_select(spark.read.parquet(str(tmp_path / "runs")), {"g": 1, "h": 3}))
    assert "EqualTo(g,1)" in plan and "EqualTo(h,3)" in plan


def test_ceiling_lookup_is_an_equi_join(spark):
    loads = spark.createDataFrame([(0, 1, 3)], "batch bigint, cluster_id int, load bigint")
    profile = spark.createDataFrame([(1, 4, 0.5)], "cluster_id int, size int, latency_s double")
    plan = plan_of(querylog.ceiling_lookup(loads, profile))
    assert "NestedLoop" not in plan and re.search(r"Join \[cluster_id#\d+, load#\d+L\], \[cluster_id#\d+, load#\d+L\]", plan)


def _bare_exchanges(df):
    """Nodes below exchanges on a part, or a part's list, alone."""
    lines = plan_of(df).splitlines()
    keys = r"hashpartitioning\(part_id#\d+(, list_id#\d+)?, \d+\)"
    return [lines[n + 1].strip(" +-:") for n, line in enumerate(lines) if "Exchange" in line and re.search(keys, line)]


def test_join_forms_have_no_hot_key(spark, stored):
    """Corpus and postings are never shuffled on a part alone; only counts per key are, after adding up in the tasks."""
    corpus, index, queries = stored
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = [
            ivf.index_append(index, corpus, limit_bytes=0),
            ivf.ivf_assign(corpus, index.coarse, limit_bytes=0),
            ivf.sq8_encode_rows(corpus, index.sq, 0),
            search.per_partition_topk(queries, corpus, 3, strategy="packed"),
            ivf.ivf_topk(queries, index, 3, 2, limit_bytes=0),
        ]
        below = [node for df in frames for node in _bare_exchanges(df)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all(re.search(r"HashAggregate.*partial_count|Aggregate.*partial", node) for node in below), below
