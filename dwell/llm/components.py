"""Connected components of a link table, by contraction.

In each round every node points to the least node, in a random order of that round, among itself and its
neighbours; nodes that point to the same one become one. Random orders shrink every component by a constant share
a round, chains too, so rounds grow with the logarithm of the longest path. Each round is an aggregation with partial
sums and joins against one row a node, so a hub costs no more than its links. Links that are few, as counted each
round, are settled in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm.shared import settle
from dwell.operators.graph import forest


#: Links that one task may hold: 16 bytes each.
FEW_LINKS = 1_000_000


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links of one task."""
    parts = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    node, root = forest(a, b)
    roots = np.unique(root)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, roots])), pa.array(np.concatenate([root, roots]))], names=["node", "root"])


def components(links: DataFrame, cut: Callable[[DataFrame, str], DataFrame] = settle, few: int = FEW_LINKS, rounds: int = 200) -> DataFrame:
    """(node, root) for each node of ``links`` (columns a and b, longs without nulls); nodes of a component share a
    root, which is one of them. At most ``few`` links, distinct and counted, are settled in one task."""
    edges = cut(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "links")
    names: DataFrame | None = None
    for salt in range(rounds):
        if edges.count() <= few:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        least = both.groupBy("a").agg(F.min(order("b")).alias("near")).select(F.col("a").alias("node"), F.least(order("a"), F.col("near"))["n"].alias("to"))
        least = cut(least, "least")
        names = least.withColumnRenamed("to", "root") if names is None else _moved(names, least)
        names = cut(names, "names")
        a, b = least.select(F.col("node").alias("a"), F.col("to").alias("a2")), least.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        edges = cut(edges.join(a, "a").join(b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    last = edges.repartition(1).mapInArrow(_settled, "node long, root long")
    return last if names is None else _moved(names, cut(last, "last").withColumnRenamed("root", "to"))


def _moved(names: DataFrame, to: DataFrame) -> DataFrame:
    """Names after their roots went on to others (node, to)."""
    return names.join(to.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
