"""Run tables (results of measured sweeps) as CSV or Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The column layouts of the run tables this library reads and writes.
CLUSTER_PROFILE = T.StructType(
    [
        T.StructField("Cluster ID", T.IntegerType()),
        T.StructField("Batch Size", T.IntegerType()),
        T.StructField("nprobe", T.IntegerType()),
        T.StructField("Retrieved Docs", T.IntegerType()),
        T.StructField("Num Threads", T.IntegerType()),
        T.StructField("Avg Retrieval Latency (s)", T.DoubleType()),
    ]
)
FREQUENCY_PROFILE = T.StructType([T.StructField("Frequency", T.IntegerType()), *CLUSTER_PROFILE.fields])
POWER_PROFILE = T.StructType(
    [
        T.StructField("State", T.StringType()),
        T.StructField("Frequency (Khz)", T.IntegerType()),
        T.StructField("Power (W)", T.IntegerType()),
    ]
)
ACCURACY_RUN = T.StructType(
    [
        T.StructField("Number of Clusters Searched", T.IntegerType()),
        T.StructField("Sample nProbe", T.IntegerType()),
        T.StructField("nProbe", T.IntegerType()),
        T.StructField("Monolithic NDCG", T.DoubleType()),
        T.StructField("Split NDCG", T.DoubleType()),
        T.StructField("Cluster NDCG", T.DoubleType()),
        T.StructField("Monolithic Recall", T.DoubleType()),
        T.StructField("Split Recall", T.DoubleType()),
        T.StructField("Cluster Recall", T.DoubleType()),
    ]
)
QUERY_LOG = T.StructType(
    [T.StructField("Query", T.LongType()), T.StructField("Ranked Clusters", T.StringType())]
)

# Run-table headers and the column names used by the operators.
COLUMN_NAMES = {
    "Cluster ID": "cluster_id",
    "Batch Size": "batch_size",
    "nprobe": "nprobe",
    "nProbe": "deep_nprobe",
    "Deep nProbe": "deep_nprobe",
    "Deep nprobe": "deep_nprobe",
    "Sample nProbe": "sample_nprobe",
    "Sample nprobe": "sample_nprobe",
    "Retrieved Docs": "k",
    "Num Threads": "threads",
    "Frequency": "frequency_mhz",
    "Frequency (Khz)": "frequency_mhz",
    "State": "state",
    "Power (W)": "watts",
    "Avg Retrieval Latency (s)": "latency_s",
    "Number of Clusters Searched": "clusters_searched",
    "Clusters Searched": "clusters_searched",
    "Query": "qid",
    "Ranked Clusters": "ranked_text",
}


def canonical_names(df: DataFrame) -> DataFrame:
    """Run-table headers to the short column names; unknown headers are kept."""
    return df.select(*[F.col(f"`{c}`").alias(COLUMN_NAMES.get(c, c)) for c in df.columns])


def metrics_csv(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, keys: Sequence[str]
) -> DataFrame:
    """Typed read of result CSVs with a header; rows without a complete key are junk and dropped."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(schema).option("header", True).csv(paths).dropna(subset=list(keys))


def multi_csv_labelled(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType, keys: Sequence[str]
) -> DataFrame:
    """Several runs in one table; ``run`` is the base name of the run's file or folder."""
    df = spark.read.schema(schema).option("header", True).csv(list(paths))
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:/part-[^/]*)?$", 1)
    return df.withColumn("run", run).dropna(subset=list(keys))


def result_sink(df: DataFrame, path: str, fmt: str = "csv", mode: str = "append") -> None:
    """Write results with a header, appending to what is there by default."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
