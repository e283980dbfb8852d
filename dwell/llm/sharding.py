"""Shards of near equal size by longest-processing-time scheduling: rows that must stay together are a group, and
groups, from the largest on, each go to the shard of the least load, found through a heap.

Groups of one size are interchangeable, so the schedule is made of sizes, not of groups: a class is a size and how many
groups have it, and what it gives each shard is what placing its groups one by one would give. All groups of different
sizes together hold at least the sum of these sizes, so classes are fewer than the square root of twice the total size:
14 million for 100 TB, 16 bytes each, are the most that the one task of the schedule sees. Groups are numbered within
their class by ranges in order of size and key, and a shard takes a range of these numbers.

Rows of a group are counted before they are exchanged, and rows of groups that hold over one in 10,000 of them stay
where they are (``join_counted``), so a group of a third of all rows fills no task. A group can't be divided: where it
is larger than an even share, its shard is as large as it.

Null keys and texts count as empty, in one group with empty ones. Texts are taken whole. Rows that repeat an id, with
null ids or with equal texts are rows each. A shard's slots follow doc_id, nulls first. An empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwell.llm.shared import join_counted, settle, table

SHARDS = 40
#: Bytes that each row takes beside its text.
ROW_BYTES = 16
#: Groups of a size that are placed one by one through the heap; of more, the level they fill up to is sought.
ONE_BY_ONE = 64


def place(loads: list[tuple[int, int]], size: int, n: int) -> np.ndarray:
    """How many of ``n`` groups of one size each shard takes; ``loads`` is a heap of (load, shard), changed in place.

    One by one they go to the shard of the least load, the lesser of equal ones. Many fill shards to a common level, the
    greatest below which there is room for no more than ``n`` starts; what is left starts on the level.
    """
    taken = np.zeros(len(loads), np.int64)
    if n <= ONE_BY_ONE:
        for _ in range(n):
            load, shard = loads[0]
            heapq.heapreplace(loads, (load + size, shard))
            taken[shard] += 1
        return taken
    own = dict((shard, load) for load, shard in loads)
    starts = lambda level: [max(0, -(-(level - own[s]) // size)) for s in range(len(loads))]  # noqa: E731  below the level
    lo, hi = min(own.values()), min(own.values()) + n * size
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if sum(starts(mid)) <= n:
            lo = mid
        else:
            hi = mid - 1
    taken += starts(lo)
    on = [s for s in range(len(loads)) if own[s] + int(taken[s]) * size == lo]
    for s in on[: n - int(taken.sum())]:
        taken[s] += 1
    loads[:] = [(own[s] + int(taken[s]) * size, s) for s in range(len(loads))]
    heapq.heapify(loads)
    return taken


def _schedule(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """(size, ends): the number of a class's groups up to each shard, of classes (size, n) in descending order."""
    loads = [(0, s) for s in range(shards)]
    for batch in batches:
        ends = [np.cumsum(place(loads, size, n)) for size, n in zip(batch["size"].to_pylist(), batch["n"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["size"], pa.array([e.tolist() for e in ends], pa.list_(pa.int64()))], names=["size", "ends"])


def _numbered(df: DataFrame, column: str) -> DataFrame:
    """Adds ``part``, the number of the task, and ``nth``, a row's number among those of its task with an equal value,
    which follow one another."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch[column].to_numpy()
            at = np.arange(len(of))
            first = np.maximum.accumulate(np.where(np.diff(of, prepend=of[0] - 1) != 0, at, 0))
            nth = at - first + np.where(first == 0, held if of[0] == last else 0, 0)
            last, held = of[-1], int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(of), part)), pa.array(nth)], names=[*batch.schema.names, "part", "nth"])

    return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", part long, nth long")


def _before(numbered: DataFrame, column: str) -> DataFrame:
    """(part, column, before): how many rows of an equal value earlier tasks have; a row for each task's value."""
    w = Window.partitionBy(column).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("part", column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")


def shards_of_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds the shard to groups (key, size and more): the largest first to the shard of the least load; of equal sizes,
    shards take the keys in order."""
    tasks = max(1, groups.sparkSession.sparkContext.defaultParallelism)
    dealt = groups.repartitionByRange(max(tasks, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "size", "key").sortWithinPartitions("size", "key")
    named = settle(_numbered(dealt, "size"), "groups")
    classes = named.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    ends = settle(classes.repartition(1).sortWithinPartitions(F.desc("size")).mapInArrow(lambda b: _schedule(b, shards), "size long, ends array<long>"), "schedule")
    runs = _before(named, "size").join(ends, "size")
    at = named.join(runs, ["part", "size"])
    # a number belongs to the first shard that ends beyond it
    return at.select(*groups.columns, F.size(F.filter("ends", lambda e: e <= F.col("nth") + F.col("before"))).alias("shard"))


def shard_documents(documents: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; equal texts share a shard."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select(
        F.col("doc_id"), (F.length(text).cast("long") + row_bytes).alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("key"), F.monotonically_increasing_id().alias("row")
    )
    rows = settle(rows, "rows")
    groups = settle(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "sizes")
    placed = settle(shards_of_groups(groups, shards).drop("size"), "placed")
    settled = settle(join_counted(rows, placed, "key"), "sharded")
    order = ["shard", "doc_id", "row"]
    numbered = settle(_numbered(settled.select("doc_id", "size", "text_crc32", "shard", "row").repartitionByRange(*order).sortWithinPartitions(*order), "shard"), "numbered")
    # ranges in order of the shard: a row for each task and one more for each shard that begins within one
    slots = numbered.join(F.broadcast(_before(numbered, "shard")), ["part", "shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op12_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
