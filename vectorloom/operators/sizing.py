"""Size checks and the shared folder: what may be broadcast, and where tables may be written."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest payload, in bytes, that is collected on the driver and broadcast to executors.
BROADCAST_LIMIT_BYTES = 64 << 20


# What was found out about a DataFrame, as long as the program holds it.
_known: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def vector_dim(df: DataFrame, column: str) -> int:
    """Length of the vectors, read from one row; 0 for an empty table. Looked up once per DataFrame."""
    known = _known.setdefault(df, {})
    if ("shape", column) in known:
        return known["shape", column][1]
    if ("dim", column) not in known:
        known["dim", column] = _first_length(df, column)
    return known["dim", column]


def _first_length(df: DataFrame, column: str) -> int:
    row = df.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).head()
    return row.n if row else 0


def table_shape(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows, and length of the vectors in ``column`` (0 for an empty table), in one job per DataFrame."""
    known = _known.setdefault(df, {})
    if ("shape", column) not in known:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(column)).alias("dim")).head()
        known["shape", column] = row.n, max(0, row.dim or 0)
    return known["shape", column]


# Rows of a table of counts or ranges that is broadcast; beyond, the join is salted.
SMALL_ROWS = 200_000
_SALTS = 16


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    salt_by: str,
    how: str = "inner",
    max_rows: int = SMALL_ROWS,
    null_safe: bool = False,
) -> DataFrame:
    """Join a table with one row per key: broadcast if it is measured small, else salted, so that no key's rows meet in one task.

    With ``null_safe`` a NULL in a key column equals a NULL.
    """
    fits = small.count() <= max_rows
    keys = list(on)
    if not fits:
        small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        big = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(_SALTS)).cast("int"))
        keys.append("_salt")
    if null_safe:
        small = small.withColumnsRenamed({c: f"_small_{c}" for c in keys})
        condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_small_{c}")) for c in keys], F.lit(True))
        joined = big.join(F.broadcast(small) if fits else small, condition, how).drop(*[f"_small_{c}" for c in keys])
    else:
        joined = big.join(F.broadcast(small) if fits else small, keys, how)
    return joined.drop("_salt")


def collect_within(df: DataFrame, max_rows: int, rows: int | None = None) -> pa.Table | None:
    """The whole table on the driver if it has at most ``max_rows`` rows, else None.

    Counts first (``rows`` if the caller knows the count): nothing is fetched from a table
    that is too large.
    """
    n = df.count() if rows is None else rows
    if n > max_rows:
        return None
    return df.toArrow()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
        return path.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="vectorloom-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/vectorloom/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The table as Parquet in the shared folder: for tables that each step of a loop makes from the one before.

    A checkpoint cuts the lineage but hands the estimate of its size on; joins multiply estimates, so after some ten steps they are numbers of
    millions of digits and planning takes minutes. A file has its own size.
    """
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and broadcasts of tables that the program has dropped.

    It does so once the driver's JVM has found them unused, which is a matter of chance while its memory lasts; a loop over parts
    of a table would keep the files of all of them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
