"""Vector tables: corpus, query set, bounded prefix, validation, generated vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.expressions import is_valid_vector
from vectorloom.operators.positions import with_positions


def corpus_scan(
    spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Vector table ``(vec_id, embedding, *keep)``; only these columns are read from the files."""
    table = spark.read.parquet(path)
    missing = [c for c in (id_col, vector_col, *keep) if c not in table.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}; it has {table.columns}")
    return table.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding"), *[F.col(c) for c in keep]
    )


def corpus_prefix(corpus: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` vectors by position (id order)."""
    return with_positions(corpus, "vec_id", below=limit).drop("pos")


def query_set(vectors: DataFrame, max_queries: int | None = None) -> DataFrame:
    """Vectors as queries ``(qid, qv)``, optionally only the first ``max_queries`` by position."""
    if max_queries is not None:
        vectors = corpus_prefix(vectors, max_queries)
    return vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def valid_vectors(corpus: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` real components; the kernels accept only these."""
    return corpus.where(is_valid_vector("embedding", dim))


def vector_validate(corpus: DataFrame, dim: int) -> DataFrame:
    """One row: how many vectors are usable, and why the others are not."""
    v = F.col("embedding")
    valid = is_valid_vector("embedding", dim)
    null, wrong = v.isNull(), v.isNotNull() & (F.size(v) != dim)

    def count(condition):
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")

    return corpus.agg(
        F.count(F.lit(1)).alias("n_rows"),
        count(valid).alias("n_valid"),
        count(null).alias("n_null"),
        count(wrong).alias("n_wrong_dim"),
        count(~null & ~wrong & ~valid).alias("n_bad_component"),
    )


def synthetic_vectors(ids: DataFrame, dim: int, seed: int = 0, id_col: str = "vec_id") -> DataFrame:
    """A uniform(-1, 1) vector for every id.

    A component is 52 bits of the MD5 of "seed:id:dimension": a re-run task, another partitioning or another engine
    produces the same vectors, and no two tasks share a random stream.
    """
    def component(j):
        name = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), j.cast("string"))
        bits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("bigint")
        return (bits / F.lit(float(2**51)) - 1.0).cast("float")

    return ids.select(
        F.col(id_col).alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), component).alias("embedding")
    )
