"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.operators.sizing import SMALL_ROWS, checkpointed, written


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()


#: A key is heavy if it holds at least one row in HEAVY of all, so there are at most HEAVY of them.
HEAVY = 1024


def join_heavy(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Equi-join with a table of one row per key that knows how many of the ``total`` rows hold it (``weight``).

    Rows of heavy keys meet their key's row map-side (at most HEAVY rows are broadcast); the others are shuffled as usual. Pass tables that
    are cheap to read twice.
    """
    heavy = keyed.where(F.col(weight) >= max(2, -(-total // HEAVY)))
    if heavy.head() is None:
        return rows.join(keyed, key)
    heavy = F.broadcast(heavy)
    light = keyed.where(F.col(weight) < max(2, -(-total // HEAVY)))
    rest = rows.join(heavy.select(key), key, "left_anti").join(light, key)
    return rows.join(heavy, key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges (a, b)``; a component is named by its smallest node.

    Each round maps every node's larger neighbours, then its smaller ones, to its smallest neighbour; the rounds needed grow with the
    logarithm of the size. Minima are partial aggregations and those of hubs are broadcast, so a hub isn't gathered in one task. Loops are ignored; an empty table
    gives an empty result.
    """
    high = F.greatest("a", "b").alias("a")
    low = F.least("a", "b").alias("b")
    edges = written(edges.where(F.col("a") != F.col("b")).select(high, low).distinct())
    state = _state(edges)
    while True:
        small_enough = 2 * state.n <= SMALL_ROWS  # bounds the nodes, and so the minima
        # large star: neighbours above a node go to its smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("degree"))
        met = both.join(F.broadcast(least), "a") if small_enough else join_heavy(both, checkpointed(least), "a", "degree", 2 * state.n)
        large = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        large = large if small_enough else checkpointed(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
        met = large.join(F.broadcast(least), "a") if small_enough else join_heavy(large, checkpointed(least), "a", "degree", state.n)
        small = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where(F.col("a") != F.col("b")).distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
