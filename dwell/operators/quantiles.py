"""Exact quantiles of groups of any size, without a map of a group's values in one task.

Groups of up to ``few`` values go through Spark's own percentile. In a larger one, the values at the ranks on either side
of each quantile are found by refining histograms over the values' bits, in their order: the values that a rank may be
are counted by their next ``BITS`` bits, in tasks first, and only the bin that holds the rank is counted again, until its
values are all equal or few. So there are at most seven rounds, however the values lie, and what a task holds of a group
is its bins, and at last at most ``few`` values. Large groups are one in ``few`` of the rows at most: they and their ranks
are broadcast, so that the rows of one group stay in as many tasks as they come in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwell.operators.folds import kinds
from dwell.operators.graph import cut

FEW = 100_000
BITS = 10


def _in_bits(rows: DataFrame) -> DataFrame:
    """Adds ``__k``, integers in the order of the doubles ``__x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = (batch["__x"].to_numpy() + 0.0).view(np.int64)  # one zero, not two
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits ^ ((bits >> 63) & np.int64(2**63 - 1)))], names=[*batch.schema.names, "__k"])

    return rows.mapInArrow(run, kinds(rows, *rows.columns) + ", __k long")


def quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float], few: int | None = None) -> DataFrame:
    """(keys, one column a share): linearly interpolated quantiles of the finite values of each group, null for a group
    without any. Null keys are a group."""
    few = FEW if few is None else few
    rows = df.select(*keys, F.col(column).cast("double").alias("__x"))
    known = rows.where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    sizes = rows.groupBy(*keys).agg(F.count(F.when(~F.isnan("__x"), F.col("__x"))).alias("__n"))
    large = sizes.where(F.col("__n") > few)
    plain = lambda of: of.groupBy(*keys).agg(*(F.percentile(F.when(~F.isnan("__x"), F.col("__x")), F.lit(q)).alias(n) for n, q in shares.items()))
    if large.isEmpty():
        return plain(rows)
    large = cut(large)
    of = F.struct(*keys, F.lit(0).alias("__0")).alias("__of")
    small = rows.join(F.broadcast(large.select(of)), F.struct(*keys, F.lit(0).alias("__0")) == F.col("__of"), "left_anti")
    at = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), (F.lit(q) * (F.col("__n") - 1)).alias("place")) for n, q in shares.items())))
    places = large.select(of, at.alias("t")).select("__of", "t.name", "t.place").withColumn("rank", F.explode(F.array(F.floor("place"), F.ceil("place"))))
    held = known.select(of, "__x").join(F.broadcast(large.select(of)), "__of")
    found = _values(cut(_in_bits(held)), places.select("__of", "rank").distinct(), few)
    both = places.join(found, ["__of", "rank"]).groupBy("__of", "name", "place").agg(F.min_by("value", "rank").alias("a"), F.max_by("value", "rank").alias("b"))
    share = F.col("place") - F.floor("place")
    named = both.withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * share).groupBy("__of").agg(*(F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in shares))
    if not keys:
        return named.select(*shares)
    return plain(small).unionByName(named.select(*(F.col(f"__of.{k}").alias(k) for k in keys), *shares))


def _values(rows: DataFrame, ranks: DataFrame, few: int) -> DataFrame:
    """(__of, rank, value): the values (__of, __x, __k) of each group at some ranks, from 0."""
    ends = rows.groupBy("__of").agg(F.min("__k").alias("lo"), F.max("__k").alias("hi"), F.min("__x").alias("value"), F.count(F.lit(1)).alias("n"))
    open_ = cut(ranks.join(ends, "__of").withColumn("before", F.lit(0).cast("long")))
    done = []
    for shift in [*range(64 - BITS, 0, -BITS), 0]:
        within = lambda some: rows.join(F.broadcast(some.drop("value", "n")), "__of").where(F.col("__k").between(F.col("lo"), F.col("hi")))
        counts = within(open_).withColumn("bin", F.shiftright("__k", shift)).groupBy("__of", "rank", "before", "bin").agg(F.min("__k").alias("lo"), F.max("__k").alias("hi"), F.min("__x").alias("value"), F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("__of", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(w), F.lit(0)))
        bins = cut(counts.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).drop("bin"))
        done.append(bins.where("lo = hi").select("__of", "rank", "value"))
        # of the last few values of a rank's bin, the one at its place
        last = within(bins.where(F.col("lo") < F.col("hi")).where(F.col("n") <= few)).groupBy("__of", "rank", "before").agg(F.array_sort(F.collect_list("__x")).alias("v"))
        done.append(last.select("__of", "rank", F.get("v", F.col("rank") - F.col("before")).alias("value")))
        open_ = bins.where((F.col("lo") < F.col("hi")) & (F.col("n") > few))
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
