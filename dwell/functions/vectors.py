"""Vectors as arrays of double: JVM-side folds, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def finite(v: Column) -> Column:
    """Whether a vector is there, not empty, and of finite numbers alone; never null."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, odd), F.lit(False))


def common_width(df: DataFrame, column: str = "embedding") -> int:
    """The width that most of the finite vectors have, the lesser of equally many; 0 for none. One row a width is
    compared."""
    widths = df.where(finite(F.col(column))).groupBy(F.size(column).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    found = widths.agg(F.min_by("w", F.struct(-F.col("n"), F.col("w")))).first()[0]
    return found or 0


def usable(df: DataFrame, column: str = "embedding", width: int | None = None) -> Column:
    """Whether a row's vector takes part: it is finite, and as wide as most are (or as ``width`` says)."""
    return finite(F.col(column)) & (F.size(column) == (common_width(df, column) if width is None else width))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, eps: float = 1e-6) -> Column:
    """Of length one; as it is when shorter than ``eps``. The norm is bound once, not once an element."""
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.when(n < eps, v).otherwise(F.transform(v, lambda x: x / n))), 1)


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def safe_cosine(a: Column, b: Column) -> Column:
    """With 1e-9 added to the product of the norms."""
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)


def mean_by(df: DataFrame, keys: list[str], vector: str, out: str) -> DataFrame:
    """The mean vector of each group and its number of rows: partial sums by position, so no group meets in a task."""
    each = df.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("pos", "x"))
    means = each.groupBy(*keys, "pos").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x)
    return means.groupBy(*keys).agg(ordered.alias(out), F.max("n").alias("n"))
