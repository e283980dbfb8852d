"""Reading tables, the folder all executors share, and cutting lineage there.

What operators write on their way lies below ``dwell-<application>`` in that folder. A result that isn't read yet hangs
on it, so it stays until the driver's JVM ends, which removes the folder of its application; ``scratch`` removes what
was made within it as soon as it ends, for callers that have written their result by then.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold over one in so many rows each are fewer than so many.
HOT = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch of rows that goes to a Python worker at once, where texts are long.
TEXT_BATCH = 8 << 20


def text_batches(spark: SparkSession, most: int = TEXT_BATCH) -> None:
    """Has the session send at most so many bytes at once to its Python workers (Spark's own bound is 64 MB): what a
    worker and its executor hold of texts goes with it. A lower bound that is set already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > most:
        spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or else the context's; one of our own only where driver and
    executors are one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="dwell-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def _hadoop(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path with its scheme and host."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


_marked: set[str] = set()
_scopes: list[list[str]] = []


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder. Its application's folder goes with the driver's JVM, it itself with the
    ``scratch`` it was made in."""
    root = f"{shared_dir(spark)}/dwell-{spark.sparkContext.applicationId}"
    if root not in _marked:
        fs, at = _hadoop(spark, root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _marked.add(root)
    path = f"{root}/{kind}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what operators wrote to the shared folder within it. A result that is lazily read must be
    written before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def settle(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key and in ``n`` the number of rows that have it.

    A key of more than one in ``hot`` rows would fill a task of its own: such keys are fewer than ``hot`` and are
    broadcast, the others are exchanged. Both are settled tables or cheap to read twice.
    """
    most = max(1, (keyed.agg(F.sum("n")).first()[0] or 0) // hot)
    large, small = F.broadcast(keyed.where(F.col("n") > most).drop("n")), keyed.where(F.col("n") <= most).drop("n")
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(small, key))
