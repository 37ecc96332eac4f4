"""Query logs: one row per query with its clusters, best first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trace_parse(log: DataFrame, text_col: str = "ranked_text") -> DataFrame:
    """``(qid, ranked ARRAY<INT>)`` from the list literal ``"[3, 1, 2]"``; NULL if it is no list."""
    return log.select("qid", F.from_json(F.col(text_col), "array<int>").alias("ranked"))


def trace_format(trace: DataFrame) -> DataFrame:
    """``(qid, ranked_text)``: the list literal form of a query log."""
    items = F.transform("ranked", lambda x: x.cast("string"))
    return trace.select("qid", F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")).alias("ranked_text"))
