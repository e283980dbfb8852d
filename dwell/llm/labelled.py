"""Bounded samples of labelled documents for fitting a classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.llm.shared import settle

#: Features that are fitted on, on the driver; those of 4,000 documents of a few kilobytes are a fifth of it.
MOST_BYTES = 256 << 20


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def sample(labels: DataFrame, label: str, held_out: Callable[[Column], Column], per_class: int) -> DataFrame:
    """At most ``per_class`` ids of either label, in the order of a hash of the id; held-out ids never take part.

    Rows without an id or with a label other than 0 and 1 are no training rows; an id labelled both ways counts
    as the smaller label.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def within(sizes: list[tuple[int, int, int]], most_bytes: int) -> list[int]:
    """Of (doc_id, y, bytes) the ids whose features may come to the driver: in the order of a checksum of the id, those
    of either label until they would take more than half of ``most_bytes``, and always the first."""
    out = []
    for y in (0, 1):
        held = 0
        for doc_id, _, size in sorted((s for s in sizes if s[1] == y), key=lambda s: (crc32(str(s[0]).encode()), s[0])):
            if held and held + size > most_bytes // 2:
                break
            held += size
            out.append(doc_id)
    return out


def features(
    documents: DataFrame, chosen: DataFrame, extract: Callable[[], Callable[[str], tuple[bytes, bytes]]], most_bytes: int = MOST_BYTES
) -> list[tuple[int, bytes, bytes]]:
    """(y, ids, counts) of each chosen document, extracted from whole texts on the executors.

    ``chosen`` is bounded by its caller, so that it is broadcast; what a document sends is bounded by the number of
    buckets, whatever its length, and all of them together by ``most_bytes`` (``within``). Of the rows that repeat an
    id one is taken, that of the least hash of its features.
    """
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = extract()
        for batch in batches:
            got = [of(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), batch["y"], pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary())],
                names=["doc_id", "y", "ids", "counts"],
            )

    each = rows.mapInArrow(run, "doc_id long, y int, ids binary, counts binary")
    of = F.struct("y", "ids", "counts")
    one = settle(each.groupBy("doc_id").agg(F.min_by(of, F.struct(F.xxhash64("ids", "counts"), "ids")).alias("of")).select("doc_id", "of.*"), "features")
    sizes = [tuple(r) for r in one.select("doc_id", "y", F.length("ids") + F.length("counts")).collect()]  # a row a chosen id
    kept = within(sizes, most_bytes)
    if len(kept) < len(sizes):
        one = one.join(F.broadcast(one.sparkSession.createDataFrame([(k,) for k in kept], "doc_id long")), "doc_id", "left_semi")
    got = one.toArrow().sort_by([("doc_id", "ascending")])
    return list(zip(got["y"].to_pylist(), got["ids"].to_pylist(), got["counts"].to_pylist(), strict=True))
