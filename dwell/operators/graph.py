"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; one of our own only where none is named and driver and executors
    are one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="dwell-"))
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one, which goes when the driver's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/dwell-{kind}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Edges that one task may hold: 16 bytes each.
FEW_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each component of the edges (a[i], b[i]): (node, least node), the least itself left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    more = root != np.arange(len(nodes))
    return nodes[more], nodes[root[more]]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches]
    if parts:
        node, root = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        own = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, own])), pa.array(np.concatenate([root, own]))], names=["node", "root"])


def connected(edges: DataFrame, max_rounds: int = 200, few: int = FEW_EDGES) -> DataFrame:
    """(node, root): root is the least node of the component. Few edges, as counted, are settled in one task. Otherwise
    least roots go along edges and roots are jumped, so rounds grow with the logarithm of the longest path in most
    graphs."""
    once = cut(edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a <> b").distinct())
    if once.count() <= few:
        return once.repartition(1).mapInArrow(_settled, "node long, root long")
    both = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root"))
    roots = cut(roots)
    for _ in range(max_rounds):
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        new = roots.join(near, "node").select("node", F.least("root", "r").alias("new"), "root")
        jump = new.select(F.col("node").alias("new"), F.col("new").alias("far"))
        new = cut(new.join(jump, "new", "left").select("node", F.least("new", "far").alias("new"), "root"))
        moved = new.where("new <> root").limit(1).count()
        roots = new.select("node", F.col("new").alias("root"))
        if not moved:
            return roots
    raise RuntimeError("components did not settle")
