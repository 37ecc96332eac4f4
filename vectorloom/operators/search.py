"""Exact, split and routed search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.expressions import is_valid_vector
from vectorloom.operators.ivf import IvfIndex, probe_lists, search_probed
from vectorloom.operators.match import best_per, topk_join
from vectorloom.operators.positions import with_positions
from vectorloom.operators.sizing import checkpointed, vector_dim


def _items(corpus: DataFrame, *keep: str) -> DataFrame:
    return corpus.select(*keep, F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int, skip_invalid: bool = False, **match) -> DataFrame:
    """``(qid, vec_id, score, rk)``: exact top ``k`` by inner product.

    A NULL, ragged, NaN or infinite vector is an error. With ``skip_invalid`` such corpus vectors, and queries, take no part, where the
    right length is that of the first query; ``sources.tables.vector_validate`` reports how many there are.
    """
    if skip_invalid:
        dim = vector_dim(queries, "qv")
        queries, corpus = queries.where(is_valid_vector("qv", dim)), corpus.where(is_valid_vector("embedding", dim))
    return topk_join(queries, _items(corpus), k, **match).withColumnRenamed("item_id", "vec_id")


def per_partition_topk(queries: DataFrame, partitioned: DataFrame, k: int, **match) -> DataFrame:
    """Exact top ``k`` inside every part."""
    hits = topk_join(queries, _items(partitioned, "part_id"), k, per=["part_id"], **match)
    return hits.withColumnRenamed("item_id", "vec_id")


def merge_topk_lists(hits: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The ``k`` best of the union of partial lists."""
    return best_per(hits.drop("rk"), k, list(by), id_col="vec_id")


def split_search(queries: DataFrame, splits: DataFrame, c: int, k: int, **match) -> DataFrame:
    """Search the first ``c`` splits and merge their lists; the filter prunes before the search."""
    return merge_topk_lists(per_partition_topk(queries, splits.where(F.col("part_id") < c), k, **match), k)


def ivf_split_search(queries: DataFrame, index: IvfIndex, c: int, k: int, nprobe: int, **match) -> DataFrame:
    """:func:`split_search` over an index of the splits."""
    coarse = index.coarse.where(F.col("part_id") < c)
    return search_probed(queries, index, probe_lists(queries, coarse, nprobe), k, **match)


def sample_scores(hits: DataFrame) -> DataFrame:
    """``(qid, part_id, sample_score)``: mean score of the hits present per query and part."""
    return hits.groupBy("qid", "part_id").agg(F.avg("score").alias("sample_score"))


def rank_parts(scores: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Add ``route_rk``: parts best-first per query (and setting), ties to the lower id."""
    w = Window.partitionBy(*by).orderBy(F.desc("sample_score"), F.asc("part_id"))
    return scores.withColumn("route_rk", F.row_number().over(w))


def ranked_trace(ranked: DataFrame) -> DataFrame:
    """``(qid, ranked ARRAY<INT>)``: one list per query, as long as there are parts."""
    pairs = F.sort_array(F.collect_list(F.struct("route_rk", "part_id")))
    return ranked.groupBy("qid").agg(F.transform(pairs, lambda x: x["part_id"]).alias("ranked"))


def sample_search(queries: DataFrame, index: IvfIndex, m: int, sample_nprobe: int, **match) -> DataFrame:
    """Cheap search in every part: top ``m`` hits per query and part."""
    probes = probe_lists(queries, index.coarse, sample_nprobe)
    return search_probed(queries, index, probes, m, per=("part_id",), **match)


def route(queries: DataFrame, index: IvfIndex, m: int, sample_nprobe: int, **match) -> DataFrame:
    """``(qid, part_id, sample_score, route_rk)`` from the sample search."""
    return rank_parts(sample_scores(sample_search(queries, index, m, sample_nprobe, **match)))


def routed_search(
    queries: DataFrame,
    index: IvfIndex,
    c: int,
    k: int,
    sample_nprobe: int,
    deep_nprobe: int,
    m: int | None = None,
    **match,
) -> DataFrame:
    """Rank the parts by a sample search, search the best ``c`` deeply, merge.

    ``m`` hits per part make the sample score (default ``k``).
    """
    # both phases read one probe table: the shallow probes are the head of the deep ones
    probes = checkpointed(probe_lists(queries, index.coarse, max(sample_nprobe, deep_nprobe)).drop("score"))
    shallow = probes.where(F.col("probe_rk") <= sample_nprobe)
    sample = search_probed(queries, index, shallow, k if m is None else m, per=("part_id",), **match)
    chosen = rank_parts(sample_scores(sample)).where(F.col("route_rk") <= c).select("qid", "part_id")
    deep = probes.where(F.col("probe_rk") <= deep_nprobe).join(chosen, ["qid", "part_id"])
    return search_probed(queries, index, deep, k, **match)


def with_routes(lists: DataFrame, m: int) -> DataFrame:
    """Add ``route_rk`` to per-part hit lists: the parts of a query ranked by the mean of their top ``m``.

    The lists are read once. Lists that were merged are dealt by query already, so all windows run inside its few rows.
    """
    within = Window.partitionBy("qid", "part_id")
    scored = lists.withColumn(
        "sample_score", F.avg(F.when(F.col("rk") <= m, F.col("score"))).over(within)
    )
    by_score = Window.partitionBy("qid").orderBy(F.desc("sample_score"), F.asc("part_id"))
    return scored.withColumn("route_rk", F.dense_rank().over(by_score))


def exact_routed_search(
    queries: DataFrame, partitioned: DataFrame, c: int, k: int, m: int | None = None, **match
) -> DataFrame:
    """Routed search without an index: parts ranked and searched by exact scans."""
    m = k if m is None else m
    lists = with_routes(per_partition_topk(queries, partitioned, max(k, m), **match), m)
    deep = lists.where((F.col("route_rk") <= c) & (F.col("rk") <= k))
    return merge_topk_lists(deep.select("qid", "vec_id", "score"), k)


def batched_search(queries: DataFrame, corpus: DataFrame, k: int, batch: int, **match) -> DataFrame:
    """Exact search with the batch number ``qblock`` of every query: runs of ``batch`` queries in id order, whatever gaps the ids have.

    All batches go through one search; its physical blocks are chosen by size.
    """
    placed = with_positions(queries.select("qid"), "qid").select("qid", F.floor(F.col("pos") / batch).cast("bigint").alias("qblock"))
    return exact_topk(queries, corpus, k, **match).join(placed, "qid")
