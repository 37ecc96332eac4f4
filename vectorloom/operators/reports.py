"""Reports over run tables: selection, means, aligned and normalised series, trimmed means."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def config_select(runs: DataFrame, config: Mapping[str, object]) -> DataFrame:
    """Rows that equal ``config`` on all its columns; the comparison reaches the scan."""
    return runs.where(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in config.items()], F.lit(True)))


def group_means(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of every metric per key combination."""
    return runs.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def align_series(series: Mapping[str, DataFrame], key: str, value: str) -> DataFrame:
    """One row per key of any series, one column per series; a missing point is NULL."""
    named = [df.select(key, F.col(value).alias(name)) for name, df in series.items()]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), named)


def zip_series(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two series paired by their configuration."""
    return left.join(right, list(keys))


def normalise_to_baseline(
    series: DataFrame, keys: Sequence[str], name_col: str, baseline: object, value: str
) -> DataFrame:
    """Add ``relative``: the value over the baseline series' value of the same key, NULL without one; NULL keys match."""
    base = series.where(F.col(name_col) == F.lit(baseline)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_base"))
    joined = series.join(base, _same(list(keys)), "left")
    return joined.withColumn("relative", F.try_divide(F.col(value), F.col("_base"))).drop("_base", *[f"_{k}" for k in keys])


def trimmed_mean(log: DataFrame, keys: Sequence[str], value: str, id_col: str | None = None, trim: int = 2) -> DataFrame:
    """``(keys, n_rows, n_used, trimmed_mean)``: the mean without the ``trim`` lowest and highest values.

    Groups of at most ``2 * trim`` rows are averaged whole, and a NULL key is a group like any other. Rows are taken as they are: values that
    repeat, with or without an id, count each time (``id_col`` is accepted and not read). NULL values don't count; NaN is the highest
    value. An empty log gives an empty result.

    One pass with a bounded state: each task keeps a group's ``2 * trim`` ends and the sum of what lies between, so
    these few numbers per task and group are all that is shuffled. Values that may yet be trimmed are never added up.
    """
    keys = list(keys)
    rows = log.select(*keys, F.col(value).cast("double").alias("_value")).where(F.col("_value").isNotNull())
    state = [T.StructField("_n", T.LongType()), T.StructField("_sum", T.DoubleType()), T.StructField("_ends", T.ArrayType(T.DoubleType()))]
    states = rows.mapInArrow(_trimmed_states(keys, trim), T.StructType([*rows.schema.fields[: len(keys)], *state]))
    merged = states.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.sum("_sum").alias("_sum"), F.sort_array(F.flatten(F.collect_list("_ends"))).alias("_ends")
    )
    cut = F.col("n_rows") > 2 * trim
    inner = F.when(cut, F.slice("_ends", trim + 1, F.greatest(F.size("_ends") - 2 * trim, F.lit(0)))).otherwise(F.col("_ends"))
    total = F.col("_sum") + F.aggregate(inner, F.lit(0.0), lambda a, x: a + x)
    used = F.when(cut, F.col("n_rows") - 2 * trim).otherwise(F.col("n_rows"))
    return merged.select(*keys, "n_rows", used.alias("n_used"), (total / used).alias("trimmed_mean"))


_HELD_GROUPS = 50_000  # groups a task holds before it hands their states on


def _trimmed_states(keys: Sequence[str], trim: int):
    """Rows to mergeable states per group: count, sum of the values between the ends, and the ends (at most ``2 * trim`` values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def drained() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
            states = list(held.values())
            kinds = (pa.int64(), pa.float64(), pa.list_(pa.float64()))
            columns += [pa.array([s[i] for s in states], t) for i, t in enumerate(kinds)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "_n", "_sum", "_ends"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i) for i in range(len(keys))]
            types = [c.type for c in columns]
            values = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            group = np.zeros(batch.num_rows, np.int64)
            for column in columns:
                coded = column.dictionary_encode(null_encoding="encode")
                group = group * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)
                group = np.unique(group, return_inverse=True)[1].ravel()
            order = np.lexsort((values, group))
            starts = np.concatenate(([0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]))
            for a, b in zip(starts[:-1], starts[1:]):
                key = tuple(c[int(order[a])].as_py() for c in columns)
                state = held.setdefault(key, [0, 0.0, np.zeros(0)])
                pool = np.sort(np.concatenate((state[2], values[order[a:b]])))
                state[0] += int(b - a)
                if len(pool) > 2 * trim:
                    state[1] += float(pool[trim : len(pool) - trim].sum())
                    pool = np.concatenate((pool[:trim], pool[len(pool) - trim :]))
                state[2] = pool
            if len(held) > _HELD_GROUPS:
                yield drained()
        if held:
            yield drained()

    return run


def _same(keys: Sequence[str]):
    """Null-safe equality of columns with those of the same names after an underscore."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))


def distinct_levels(runs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, level, n_levels)``: the distinct values of every column, as text, and their number."""
    named = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    )
    # tasks drop repeated (column, level) pairs before the shuffle
    levels = runs.select(named.alias("_l")).select("_l.*").where(F.col("level").isNotNull()).distinct()
    counts = levels.groupBy("column").agg(F.count(F.lit(1)).alias("n_levels"))
    return levels.join(counts, "column")
