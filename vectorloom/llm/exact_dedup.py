"""Exact duplicates with a heavy-hitter split, DataFrame functions only.

A mergeable Misra-Gries sketch (``approx_top_k``) names the digests that may hold more than one row in
``heavy``; their exact counts and winners are verified by a partial aggregation and broadcast (at most
``heavy`` rows). Copies of those texts are settled without a shuffle. All other digests, each of which
holds less than that share of the rows, are shuffled as usual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.operators.sizing import SMALL_ROWS, checkpointed

#: A digest is heavy if it holds at least one row in HEAVY, so there are at most HEAVY of them.
HEAVY = 1024
#: Counters of the sketch; its error is below rows / TRACKED * 2, far below rows / HEAVY.
TRACKED = 16384


def text_digest(text_col: str) -> Column:
    """SHA-256 of the UTF-8 text, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def heavy_winners(rows: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """Frequent digests of ``rows (doc_id, digest, rid)``: ``(digest, winner, group_size)``, at most ``heavy`` rows.

    The sketch only proposes; counts and winners are exact.
    """
    key = F.xxhash64("digest")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(xxhash64(digest), {heavy}, {tracked})").alias("top")).head()
    least = max(2, -(-found.n // heavy))
    # the sketch's estimate is an upper bound, so no digest with at least ``least`` rows is missed
    names = [item["item"] for item in (found.top or []) if item["count"] >= least]
    candidates = rows.where(key.isin(names)) if names else rows.where(F.lit(False))
    counted = candidates.groupBy("digest").agg(
        F.max(F.struct("doc_id", "rid")).alias("winner"), F.count(F.lit(1)).alias("group_size")
    )
    return checkpointed(counted.where(F.col("group_size") >= least))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, tracked: int = TRACKED
) -> DataFrame:
    """One row per document: ``(doc_id, keep_id, group_size, kept, text_sha256)``.

    Of equal texts the row with the largest id stays. A null text equals an empty one; a null id is the
    smallest. Of rows that are repeated with the same id and text exactly one is kept. Only the two named columns
    are read, whatever others there are; an empty table gives an empty result.
    """
    rows = checkpointed(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            text_digest(text_col).alias("digest"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    winners = F.broadcast(heavy_winners(rows, heavy, tracked))
    settled = rows.join(winners, "digest")
    group = Window.partitionBy("digest")
    rest = (
        rows.join(winners.select("digest"), "digest", "left_anti")
        .withColumn("winner", F.max(F.struct("doc_id", "rid")).over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    return settled.select(rest.columns).union(rest).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("winner.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """The documents that :func:`exact_dedup` keeps, with all their columns.

    Only ids and digests are shuffled while the losers are found. Copies of frequent texts go map-side, and so do the other losers
    if they are measured few; else they are joined. Rows that are repeated with the same id and text are left to one of them.
    """
    rows = checkpointed(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_digest(text_col).alias("digest"), F.lit(0).alias("rid"))
    )
    winners = heavy_winners(rows, heavy, tracked).select("digest", F.col("winner.doc_id").alias("doc_id"))
    pairs = checkpointed(rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")))
    light = pairs.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    order = Window.partitionBy("digest").orderBy(F.col("doc_id").desc_nulls_last())
    losers = checkpointed(light.withColumn("place", F.row_number().over(order)).where("place > 1").select("digest", "doc_id"))
    frequent = winners.select(F.col("digest").alias("__heavy"), F.col("doc_id").alias("__winner"))
    marked = docs.withColumn("__digest", text_digest(text_col)).withColumn("__id", F.col(id_col).cast("bigint"))
    left = marked.join(F.broadcast(frequent), F.col("__digest") == F.col("__heavy"), "left").where(
        F.col("__heavy").isNull() | F.col("__id").eqNullSafe(F.col("__winner"))
    )
    left = _matching(left, losers, "left_anti")
    repeated = checkpointed(pairs.where("n > 1").select("digest", "doc_id"))
    if repeated.head() is None:
        return left.select(*docs.columns)
    one = Window.partitionBy("__digest", "__id").orderBy(F.xxhash64(*[c for c in docs.columns if c != text_col]))
    several = _matching(left, repeated, "left_semi").withColumn("__rank", F.row_number().over(one)).where("__rank = 1")
    return _matching(left, repeated, "left_anti").select(*docs.columns).union(several.select(*docs.columns))


def _matching(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``rows (__digest, __id)`` with ``keys (digest, doc_id)``; the keys are broadcast if they are measured few."""
    named = keys.select(F.col("digest").alias("__key"), F.col("doc_id").alias("__key_id"))
    if keys.count() <= SMALL_ROWS:
        named = F.broadcast(named)
    return rows.join(named, (F.col("__digest") == F.col("__key")) & F.col("__id").eqNullSafe(F.col("__key_id")), how)
