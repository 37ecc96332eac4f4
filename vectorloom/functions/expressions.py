"""Column expressions shared by the operators; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round to ``digits``; adding 0.0 turns a negative zero into a plain zero."""
    return F.round(_col(c), digits) + F.lit(0.0)


def inner_product(a: Column | str, b: Column | str) -> Column:
    """Inner product of two numeric arrays, summed in DOUBLE.

    Interpreted by Spark, so meant for single pairs (checks, reports), not for search.
    """
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def vector_sum(v: Column | str) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def is_valid_vector(v: Column | str, dim: int) -> Column:
    """True for a vector of the right length without NULL, NaN or infinite components."""
    v = _col(v)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & ~bad


def join_text(values: Column | str, sep: str = ",") -> Column:
    """Array of numbers as one comma-separated string."""
    return F.array_join(F.transform(_col(values), lambda x: x.cast("string")), sep)
