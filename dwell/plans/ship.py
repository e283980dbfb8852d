"""Makes the package importable in Python workers, wherever the driver was started from."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    stage = tempfile.mkdtemp(prefix="dwell-ship-")
    shutil.copytree(os.path.join(home, "dwell"), os.path.join(stage, "in", "dwell"), ignore=shutil.ignore_patterns("__pycache__"))
    if os.path.exists(top := os.path.join(home, "corpus_pipeline.py")):
        shutil.copy(top, os.path.join(stage, "in"))
    sc.addPyFile(shutil.make_archive(os.path.join(stage, "dwell"), "zip", os.path.join(stage, "in")))
    _shipped.add(sc.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
