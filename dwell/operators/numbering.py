"""Consecutive numbers in an order, without a window over the whole table or over all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwell.operators.graph import cut


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """Adds 0, 1, ... in ascending ``order``. The rows are dealt by range; only the ranges' sizes, one row a
    partition, meet in a task."""
    return numbered_within(df, [], [order], out)


def numbered_within(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds 0, 1, ... in ascending ``order`` within each of the ``keys``; nulls are a key and come first. Rows are dealt
    by range, so a key of many rows is spread; what meets in a task is the sizes of a key's ranges."""
    dealt = cut(df.repartitionByRange(*(F.col(c) for c in [*keys, *order])).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.struct(*keys, "__part").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inner = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order)) - 1
    # ranges hold keys in order: a row for each range, and one more for each key that begins within one
    placed = dealt.withColumn(out, inner).withColumn("__of", F.struct(*keys, "__part"))
    joined = placed.join(F.broadcast(starts) if not keys else starts, "__of")
    return joined.withColumn(out, F.col("__start") + F.col(out)).select(*df.columns, out)
