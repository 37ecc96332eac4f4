"""Dense positions in id order without a one-task window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.operators.sizing import checkpointed, join_small

_BUCKET_ROWS = 200_000
#: Most ranges the rows are cut into; beyond ``_BUCKET_ROWS * _MAX_RANGES`` rows the ranges grow instead. Bounds what the driver sees.
_MAX_RANGES = 20_000
_PLACE_BITS = 33  # monotonically_increasing_id: partition above, row inside the partition below


def _range_names(df: DataFrame, lo: int, hi: int):
    """Sum of the hashes of lo..hi: equal to that of as many ids in this range only if none repeats."""
    whole = df.sparkSession.range(lo, hi + 1)
    return whole.agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("names")).head().names


def with_positions(
    df: DataFrame,
    id_col: str,
    by: Sequence[str] = (),
    below: int | None = None,
    limits: DataFrame | None = None,
    bucket_rows: int = _BUCKET_ROWS,
) -> DataFrame:
    """Add ``pos``: 0, 1, 2 ... in order of ``id_col``, counted within ``by``; repeated ids get positions of their own.

    No row is lost: a NULL id comes before all others, a NULL in ``by`` is a group like any other (NaN too), and the result is the same for
    every ``bucket_rows``. Rows of the same group and id are ordered by a digest of their other columns. An empty table gives
    an empty result. ``below`` keeps positions below a constant; ``limits(*by, n_keep)`` does so per group (a group without a
    limit has no rows, NULL groups match).

    Whole numbers without gaps or repetitions need arithmetic only. Otherwise the rows are exchanged once, by ranges of
    (group, id, digest, row number), so that neither a group nor an id that holds most rows is one task's work; see :func:`ordered_rows`.
    """
    by = list(by)
    if below is not None and limits is not None:
        raise ValueError("give either below or limits")
    if not by and isinstance(df.schema[id_col].dataType, T.IntegralType):
        names = F.sum(F.xxhash64(F.col(id_col).cast("bigint")).cast("decimal(38,0)"))
        sizes = F.count(F.lit(1)).alias("rows"), F.count(id_col).alias("n")
        span = df.agg(*sizes, F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), names.alias("names")).head()
        rows = span.rows
        if rows == span.n > 0 and span.hi - span.lo + 1 == span.n and span.names == _range_names(df, span.lo, span.hi):
            if below is not None:
                df = df.where(F.col(id_col) < F.lit(span.lo + below))  # reaches the scan
            return df.withColumn("pos", F.col(id_col) - F.lit(span.lo))
    else:
        rows = df.count()
    placed = ordered_rows(df, [id_col], by, rows, bucket_rows).drop("_ord")
    if below is not None:
        placed = placed.where(F.col("pos") < below)
    if limits is not None:
        placed = join_small(placed, limits.select(*by, "n_keep"), by, "pos", null_safe=True).where("pos < n_keep").drop("n_keep")
    return placed.select(*df.columns, "pos")


def ordered_rows(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), rows: int | None = None, bucket_rows: int = _BUCKET_ROWS
) -> DataFrame:
    """Add ``pos`` (0, 1, 2 ... within ``by``, in ascending order of ``order``, NULLs first) and ``_ord`` (unique, ascending over all rows).

    One range exchange by (by, order, digest of the other columns, row number), written to the shared folder so that the
    ranges are the same in what follows. Tasks then number the rows of their range; only the first group of a range can go on from the
    range before, so a table with at most one row per range holds all offsets. ``_ord`` counts up by 1 within a range.
    """
    by, order = list(by), list(order)
    rows = df.count() if rows is None else rows
    n_ranges = min(max(1, -(-rows // bucket_rows)), _MAX_RANGES)
    others = [f.name for f in df.schema if f.name not in {*by, *order} and not _has_map(f.dataType)]
    digest = F.xxhash64(*others) if others else F.lit(0).cast("bigint")
    keyed = df.withColumns({"_digest": digest, "_row": F.monotonically_increasing_id()})
    keys = [*by, *order, "_digest", "_row"]
    ranged = keyed.repartitionByRange(n_ranges, *keys) if n_ranges > 1 else keyed.coalesce(1)
    ranged = ranged.sortWithinPartitions(*keys).drop("_digest", "_row")
    placed = checkpointed(ranged.withColumn("_ord", F.monotonically_increasing_id()))
    inside = F.col("_ord").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    numbered = _numbered(placed, by) if by else placed.withColumn("_at", inside)
    part = F.shiftright("_ord", _PLACE_BITS)
    group = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    ends = numbered.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(group, "_ord").alias("first"),
        F.max_by(group, "_ord").alias("last"),
        F.max_by("_at", "_ord").alias("last_at"),
    )
    offsets = df.sparkSession.createDataFrame(_offsets(ends.collect()), "_part bigint, _offset bigint")
    joined = numbered.join(F.broadcast(offsets), part == F.col("_part"), "left")
    goes_on = F.when(F.col("_at") == inside, F.coalesce("_offset", F.lit(0))).otherwise(0)
    return joined.withColumn("pos", F.col("_at") + goes_on).drop("_at", "_part", "_offset")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def _group_name(group) -> str:
    return repr(group)  # NULL, NaN and numbers of a column compare as text


def _offsets(ends: list) -> list[tuple[int, int]]:
    """Rows that the first group of each range has in the ranges before it, where there are any."""
    found = []
    group, so_far = None, 0
    for end in sorted(ends, key=lambda e: e.part):
        offset = so_far if _group_name(end.first) == group else 0
        if offset:
            found.append((end.part, offset))
        whole = end.last_at + 1 == end.n  # a single group fills the range
        so_far = end.last_at + 1 + (offset if whole else 0)
        group = _group_name(end.last)
    return found


def _numbered(placed: DataFrame, by: list[str]) -> DataFrame:
    """Add ``_at``: the place of a row in its group's run inside its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, reached = None, 0  # last row's group of the batch before, and its rows so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = [batch.column(batch.schema.get_field_index(c)) for c in by]
            new = np.zeros(n, bool)
            for column in groups:
                new[1:] |= _differs(column.slice(1), column.slice(0, n - 1))
            new[0] = before is None or any(_differs(c.slice(0, 1), b)[0] for c, b in zip(groups, before))
            place = np.arange(n)
            latest = np.maximum.accumulate(np.where(new, place, -1))
            at = np.where(latest >= 0, place - latest, place + reached)
            before, reached = [c.slice(n - 1, 1) for c in groups], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "_at"])

    schema = T.StructType([*placed.schema.fields, T.StructField("_at", T.LongType())])
    return placed.mapInArrow(run, schema)


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns differ; NULL equals NULL, NaN equals NaN."""
    if pa.types.is_floating(a.type):
        same = pc.fill_null(pc.or_(pc.equal(a, b), pc.and_(pc.is_nan(a), pc.is_nan(b))), False)
    else:
        same = pc.fill_null(pc.equal(a, b), False)
    both_null = pc.and_(pc.is_null(a), pc.is_null(b))
    return ~pc.or_(same, both_null).to_numpy(zero_copy_only=False)
