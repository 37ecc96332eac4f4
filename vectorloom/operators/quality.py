"""Retrieval quality against exact results: overlap, recall, DCG, NDCG."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1))


def ground_truth_overlap(hits: DataFrame, truth: DataFrame, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """Every retrieved row with ``hit``: 1 if the document is in the query's true list, else 0."""
    marks = truth.select(*keys, "vec_id").withColumn("_true", F.lit(1))
    return hits.join(marks, [*keys, "vec_id"], "left").withColumn("hit", F.coalesce("_true", F.lit(0))).drop("_true")


def hit_rows(hits: DataFrame, truth: DataFrame) -> DataFrame:
    return hits.join(truth.select("qid", "vec_id"), ["qid", "vec_id"], "left_semi")


def miss_rows(hits: DataFrame, truth: DataFrame) -> DataFrame:
    return hits.join(truth.select("qid", "vec_id"), ["qid", "vec_id"], "left_anti")


def query_quality(
    hits: DataFrame, truth: DataFrame, setting: Sequence[str] = (), truth_keys: Sequence[str] = ("qid",)
) -> DataFrame:
    """``(*setting, qid, n_hits, n_true, recall, dcg, idcg, ndcg)``, one row per query (and setting).

    Without ``setting`` every query of ``truth`` has a row; one that retrieved nothing scores 0.
    ``setting`` columns separate several result sets; a (setting, query) pair that retrieved nothing
    has no row, so means over settings divide by the number of true queries. ``truth_keys`` select
    the true list of a row (a subset of setting + qid).
    """
    ideal = truth.groupBy(*truth_keys).agg(
        F.count(F.lit(1)).alias("n_true"), F.sum(discount(F.col("rk"))).alias("idcg")
    )
    gained = (
        ground_truth_overlap(hits, truth, truth_keys)
        .groupBy(*setting, "qid")
        .agg(
            F.sum("hit").alias("n_hits"),
            F.sum(F.when(F.col("hit") == 1, discount(F.col("rk"))).otherwise(0.0)).alias("dcg"),
        )
    )
    scored = gained.join(ideal, list(truth_keys)) if setting else ideal.join(gained, "qid", "left")
    n_hits, dcg = F.coalesce("n_hits", F.lit(0)), F.coalesce("dcg", F.lit(0.0))
    return scored.select(
        *setting,
        "qid",
        n_hits.cast("bigint").alias("n_hits"),
        "n_true",
        (n_hits / F.col("n_true")).alias("recall"),
        dcg.alias("dcg"),
        "idcg",
        F.when(F.col("idcg") == 0, 0.0).otherwise(dcg / F.col("idcg")).alias("ndcg"),
    )


def recall_at_k(hits: DataFrame, truth: DataFrame) -> DataFrame:
    return query_quality(hits, truth).select("qid", "n_hits", "n_true", "recall")


def dcg_at_k(hits: DataFrame, truth: DataFrame) -> DataFrame:
    return query_quality(hits, truth).select("qid", "dcg")


def ndcg_at_k(hits: DataFrame, truth: DataFrame) -> DataFrame:
    return query_quality(hits, truth).select("qid", "dcg", "idcg", "ndcg")


def quality_by_config(per_query: DataFrame, config: Sequence[str], strategies: Sequence[str]) -> DataFrame:
    """Mean recall and NDCG, one row per configuration and a column pair per strategy.

    ``per_query(*config, strategy, qid, recall, ndcg)``.
    """
    return (
        per_query.groupBy(*config)
        .pivot("strategy", list(strategies))
        .agg(F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"))
    )
