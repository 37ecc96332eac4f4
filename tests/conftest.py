from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("part_id", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_vectors(spark):
    """Build ``(vec_id, part_id, embedding)`` from a matrix; returns the DataFrame."""

    def build(matrix, parts=None, ids=None, partitions=3):
        n = len(matrix)
        ids = range(n) if ids is None else ids
        parts = np.zeros(n, int) if parts is None else parts
        rows = [(int(i), int(p), [float(x) for x in v]) for i, p, v in zip(ids, parts, matrix)]
        return spark.createDataFrame(rows, VECTORS).repartition(partitions, "vec_id")

    return build


def brute_topk(queries, items, ids, k):
    """Top-k ids per query by DOUBLE inner product, ties to the lower id."""
    q, c = np.asarray(queries, np.float32).astype(float), np.asarray(items, np.float32).astype(float)
    out = []
    for row in q:
        scores = (c * row).sum(axis=1)
        out.append([int(ids[i]) for i in np.lexsort((ids, -scores))[:k]])
    return out


def grouped(rows, keys, value, order):
    """Collected rows as {key: [value in order]}."""
    out: dict = {}
    for row in sorted(rows, key=lambda r: r[order]):
        key = tuple(row[c] for c in keys)
        out.setdefault(key if len(key) > 1 else key[0], []).append(row[value])
    return out
