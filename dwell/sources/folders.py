"""Folders of a cluster as Python workers open them: Spark's URIs by their schemes as pyarrow's file systems name them."""

from __future__ import annotations

from urllib.parse import urlsplit, urlunsplit

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

#: Fixed: schemes that Hadoop's connectors use, and pyarrow's for the same store.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "wasb": "abfss", "wasbs": "abfss", "gcs": "gs"}
#: Fixed: the host of an Azure account's blobs, and of its hierarchical files.
_BLOB, _DFS = ".blob.core.windows.net", ".dfs.core.windows.net"


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark resolves it: one without a scheme is of the cluster's default file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def worker_uri(uri: str) -> str:
    """A qualified URI of Spark's as pyarrow reads it; a path without a scheme can't be told from one of a worker's own
    disk and is refused."""
    parts = urlsplit(uri)
    if not parts.scheme:
        raise ValueError(f"{uri} has no scheme: qualify it on the driver")
    if parts.scheme == "dbfs":  # workers see it as a mounted folder
        return "file:///dbfs" + parts.path
    host = parts.netloc
    if parts.scheme in ("wasb", "wasbs") and host.endswith(_BLOB):
        host = host.removesuffix(_BLOB) + _DFS
    scheme = _SCHEMES.get(parts.scheme, parts.scheme)
    if scheme == "file":
        return "file://" + parts.path
    return urlunsplit((scheme, host, parts.path, "", ""))


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified URI and the path within it."""
    return pafs.FileSystem.from_uri(worker_uri(uri))
