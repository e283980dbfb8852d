"""SimHash near-duplicates by fuzzy Golay keys.

A text's 64-bit fingerprint has each bit that is set in over half the XXH64 hashes (seed 42) of its three-word
shingles, ASCII letters lower-cased. Fingerprints that differ in at most two bits are linked.

The 64 bits are three segments of 22, 21 and 21. Two errors leave a segment untouched, and in one of its two
neighbours, taken in a circle, at most one error; so each fingerprint gets, for each segment, keys of the whole
segment and the Golay indices of the next one (``golay.keys``), and linked fingerprints share a key. Distinct
fingerprints are grouped by key and verified; a group sends a spanning forest, not its pairs. Groups of over ``block``
fingerprints are cut into blocks and each pair of blocks is a group of its own, so no task meets an unbounded group.

Null and empty texts have no words and fingerprint zero, and are linked like any other. component_id is the smallest
non-null doc_id of the component (null if none); rows of a repeated id are one document each, with the id's
component by its own text; an empty table gives an empty result; extra columns are ignored, whatever their names.
Texts of any length are read to their end; their shingles are hashed by the thousand, so memory grows with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwell.llm import golay
from dwell.llm.components import components
from dwell.llm.shared import join_counted, settle, table
from dwell.operators.graph import forest

WORDS = 3
DISTANCE = 2
BLOCK = 512
_SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift, bits
_LONG = 4096


def fingerprint(text: str | None, width: int = WORDS) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()][:n]
    ends = ends.tolist()[width - 1 :] or [len(line)]
    of = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _LONG):
        hashes = np.array([of(line[a:b], 42) for a, b in zip(starts[lo : lo + _LONG], ends[lo : lo + _LONG], strict=True)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * x > n else "0" for x in ones), 2)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""
    rows = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the fingerprint) of every key, as unsigned bits of: segment number, segment, Golay index."""
    fp = fp.view(np.uint64)
    parts = [(fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1) for shift, bits in _SEGMENTS]
    found, at = [], []
    for k in range(3):
        codes = golay.keys(parts[(k + 1) % 3])
        whole = (k << 34) | (parts[k].astype(np.int64) << 12)
        has = codes >= 0
        found.append((whole[:, None] | codes)[has])
        at.append(np.nonzero(has)[0])
    return np.concatenate(found), np.concatenate(at)


def _links(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``group``, reduced to a forest as they are found: each offset once for all runs."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    alive = np.arange(len(fp))
    step = 1
    bits = fp.view(np.uint64)
    while len(alive):
        alive = alive[alive + step < len(fp)]
        alive = alive[group[alive] == group[alive + step]]
        near = alive[np.bitwise_count(bits[alive] ^ bits[alive + step]) <= distance]
        a, b = np.concatenate([a, fp[near]]), np.concatenate([b, fp[near + step]])
        if len(a) > 200_000:
            a, b = forest(a, b)
        step += 1
    return forest(a, b) if len(a) else (a, b)


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints (column fp) joined by chains of near ones."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            key, at = fuzzy_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at])], names=["key", "fp"])

    keys = settle(distinct.select("fp").mapInArrow(keyed, "key long, fp long"), "keys")
    # one row for each key and task goes into the counts; keys of one fingerprint link nothing
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
    shared = keys.join(many, "key").select("key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = shared.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    parts = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            new = np.ones(len(rows[3]), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
            a, b = _links(np.cumsum(new), rows[3], distance)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            rows = [batch[c].to_numpy() for c in ("key", "lo", "hi", "fp")]
            if not len(rows[3]):
                continue
            if kept is not None:
                rows = [np.concatenate([k, r]) for k, r in zip(kept, rows, strict=True)]
            # the last group may go on in the next batch
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            kept = [r[last:] for r in rows]
            if last:
                yield out([r[:last] for r in rows])
        if kept is not None:
            yield out(kept)

    return parts.mapInArrow(linked, "a long, b long")


def roots_of(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) of the distinct fingerprints of ``rows``; near ones share a root, which is one of them."""
    distinct = settle(rows.select("fp").distinct(), "classes")
    roots = components(fingerprint_links(distinct, distance)).select(F.col("node").alias("fp"), "root")
    return settle(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = settle(fingerprints(documents), "fingerprints")
    roots = roots_of(rows, distance)
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).join(roots, "fp"), "counted")
    ids = settle(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "ids")
    of = settle(join_counted(classes.select("root", "fp", "rows"), ids, "root").select("fp", "component_id", F.col("rows").alias("n")), "components")
    return join_counted(rows, of, "fp").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, rows with an id before those
    without; of rows equal in id, that of the smallest fingerprint, and then any one of them.

    It is rows that go, not ids: another text of an id that goes stays, where nothing is near to it.
    """
    at, taken = documents.columns.index("text"), set(documents.columns)
    fp_name, row_name = (next(x for k in range(len(taken) + 1) if (x := f"__{name}_{k}") not in taken) for name in ("fp", "row"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], names=[*batch.schema.names, fp_name])

    schema = T.StructType([*documents.schema.fields, T.StructField(fp_name, T.LongType())])
    # a row's number is written with it, so that it stays the same whatever is run again
    whole = settle(documents.mapInArrow(marked, schema).withColumn(row_name, F.monotonically_increasing_id()), "marked")
    rows = whole.select("doc_id", F.col(fp_name).alias("fp"), F.col(row_name).alias("row"))
    # one row for each fingerprint and task goes before the exchange, then one for each component
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "fp", "row")
    first = rows.groupBy("fp").agg(F.min(order).alias("first")).join(roots_of(rows, distance), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = first.select(F.col("first.row").alias(row_name))
    return whole.join(kept, row_name, "left_semi").select(*documents.columns)


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
