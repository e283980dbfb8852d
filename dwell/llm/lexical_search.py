"""Ranked lexical search by sort-based accumulation: the best documents of each query item, by integer impacts.

A first pass over the texts keeps, for each document, the number of its terms and the items' terms it holds with their
occurrences, as two packed arrays in a settled table. Document frequencies are counted from that table, in tasks first.
Then each task takes the range of documents that its part of the table holds: the matched postings are concatenated
term by term and spread to the items that ask for the term, as arrays of item, document and impact; item and document
are packed into one key, the keys are radix sorted, and equal ones are summed by ``reduceat``. A heap for each item
keeps the best ``k`` of the range, and only those of all ranges are compared. A slice of the arrays is bounded
(``MOST_ENTRIES``), whatever the documents and items.

Items are read in blocks of a bounded number of bytes, whose terms go to all tasks; documents pass once for each block.
Texts are taken whole, of any length. A document or item without terms (null, empty) finds nothing and isn't found.
Each row is a document or an item of its own, rows that repeat an id included; among equal scores the smaller doc_id is
first, and null ids come last. An empty table of either gives an empty result; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwell.llm.shared import settle, table

K = 10
#: Weight of a term's rarity, scale of its occurrences, and how far they saturate: 8 tenths of a document's length mark.
SCALE, UNIT, SATURATION = 1000, 10**9, 8
#: Of a hundred, the share of a length mark that goes with the document's length.
LENGTH_SHARE = 90
#: Bytes of the items of a block, as they are dealt by a hash.
BLOCK_BYTES = 32 << 20
#: Entries (item, document, impact) that are sorted at once, 40 bytes each.
MOST_ENTRIES = 2_000_000
_DIGIT = 16

#: ASCII letters in lower case and digits stand for themselves, as do bytes of other characters; the rest separates.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split() if text else []


class Items:
    """The terms of some items, numbered, and the items of each as slices of one array."""

    def __init__(self, texts: list[bytes | None]) -> None:
        self.number: dict[bytes, int] = {}
        pairs = sorted({(self.number.setdefault(t, len(self.number)), i) for i, text in enumerate(texts) for t in terms(text)})
        of = np.array([p[0] for p in pairs], np.int64)
        self.items = np.array([p[1] for p in pairs], np.int64)
        self.starts = np.searchsorted(of, np.arange(len(self.number) + 1))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, a digit of 16 bits after another; numpy sorts such digits by counting."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    for shift in range(_DIGIT, int(keys.max(initial=0)).bit_length(), _DIGIT):
        order = order[np.argsort((keys[order] >> np.uint64(shift)).astype(np.uint16), kind="stable")]
    return order


def accumulate(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, sum of impacts) of each pair that occurs, in order of the item and the document."""
    bits = np.uint64(max(1, n_docs - 1).bit_length())
    key = item.astype(np.uint64) << bits | doc.astype(np.uint64)
    order = radix_order(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)))
    own = key[first]
    return (own >> bits).astype(np.int64), (own & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), np.add.reduceat(impact[order], first)


def weight(n_docs: int, df: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """A heap of the best ``k`` for each item: (score, negative id), null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self._heaps: list[list[tuple[int, float | int]]] = [[] for _ in range(items)]
        self._floor = np.zeros(items, np.int64)
        self._k = k

    def add(self, item: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """``ids`` holds objects; scores are above 0."""
        near = np.flatnonzero(score >= np.maximum(1, self._floor[item]))
        # of one slice, no more than a heap's worth with the ties of its last score
        near = near[np.lexsort((-score[near], item[near]))]
        of = item[near]
        lo = np.searchsorted(of, of)
        last = near[np.minimum(lo + self._k, np.searchsorted(of, of, side="right")) - 1]
        near = near[score[near] >= score[last]]
        for i, d, s in zip(item[near].tolist(), ids[near].tolist(), score[near].tolist(), strict=True):
            heap, one = self._heaps[i], (s, -math.inf if d is None else -d)
            if len(heap) < self._k:
                heapq.heappush(heap, one)
            else:
                heapq.heappushpop(heap, one)
            if len(heap) == self._k:
                self._floor[i] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for i, heap in enumerate(self._heaps):
            for s, d in heap:
                yield i, None if d == -math.inf else -int(d), s


def _matched(documents: DataFrame, asked) -> DataFrame:
    """Of each document: n, its number of terms, and the numbers and occurrences of the items' terms in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = asked.value.number.get
        for batch in batches:
            n, own, tf = [], [], []
            for text in batch["text"]:
                found = terms(text.as_py())
                n.append(len(found))
                counts = Counter(map(number, found))
                counts.pop(None, None)
                own.append(np.fromiter(counts.keys(), "<i4", len(counts)).tobytes())
                tf.append(np.fromiter(counts.values(), "<i4", len(counts)).tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(own, pa.binary()), pa.array(tf, pa.binary())], names=["doc_id", "n", "terms", "tf"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, tf binary").where("n > 0")


def _frequencies(matched: DataFrame, size: int) -> dict[int, int]:
    """Documents by term; one row a term of the items comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch["terms"].to_pylist()), "<i4"), minlength=size)
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(counts[has])], names=["term", "df"])

    return {r.term: r.df for r in matched.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _slices(entries: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` entries together, or of one document."""
    ends = np.cumsum(entries)
    lo = 0
    while lo < len(entries):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def search(documents: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the best ``k`` documents of each item."""
    spark = documents.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    rows = settle(items.select("item_id", F.col("text").cast("binary").alias("text")), "items")
    blocks = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_bytes))
    found = [_block(documents, rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), b, k, kind) for b in range(blocks)]
    best = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long").unionByName(ranked.select("item_id", "rank", "doc_id", "score"))


def _block(documents: DataFrame, items: DataFrame, block: int, k: int, kind: str) -> DataFrame:
    """(block, item, item_id, doc_id, score) of the best of each range of documents."""
    sc = documents.sparkSession.sparkContext
    own = items.toArrow()
    asked = Items(own["text"].to_pylist())
    shared = sc.broadcast(asked)
    matched = settle(_matched(documents, shared), "postings")
    n_docs, length = (x or 0 for x in matched.agg(F.count(F.lit(1)), F.sum("n")).first())
    df = _frequencies(matched, len(asked.number))
    ids = own["item_id"].combine_chunks()
    weights = sc.broadcast(np.array([weight(n_docs, df.get(t, 0)) for t in range(len(asked.number))], np.int64))
    names = sc.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, w = shared.value, weights.value
        fan = np.diff(of.starts)
        best = Best(len(names.value), k)
        for batch in batches:
            sizes = np.array([len(x) // 4 for x in batch["terms"].to_pylist()], np.int64)
            t = np.frombuffer(b"".join(batch["terms"].to_pylist()), "<i4")
            tf = np.frombuffer(b"".join(batch["tf"].to_pylist()), "<i4").astype(np.int64)
            mark = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // length for n in batch["n"].to_pylist()], np.int64)
            ids_ = np.array(batch["doc_id"].to_pylist(), object)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            entries = np.add.reduceat(np.concatenate([fan[t], [0]]), starts[:-1]) * (sizes > 0)
            for lo, hi in _slices(entries, MOST_ENTRIES):
                part = slice(starts[lo], starts[hi])
                doc = np.repeat(np.arange(hi - lo), sizes[lo:hi])
                order = np.argsort(t[part], kind="stable")  # postings of a term side by side
                doc, term, n = doc[order], t[part][order], tf[part][order]
                impact = w[term] * (UNIT * n // (SCALE * n + SATURATION * mark[lo:hi][doc]))
                each = fan[term]
                at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(of.starts[term], each)
                if len(at):
                    i, d, score = accumulate(of.items[at], np.repeat(doc, each), np.repeat(impact, each), hi - lo)
                    best.add(i, ids_[lo:hi][d], score)
        got = list(best.rows())
        columns = [pa.array([x[c] for x in got], pa.int64()) for c in range(3)]
        yield pa.RecordBatch.from_arrays([columns[0], names.value.take(columns[0]), *columns[1:]], names=["item", "item_id", "doc_id", "score"])

    scored = matched.where(F.length("terms") > 0).mapInArrow(run, f"item long, item_id {kind}, doc_id long, score long")
    return scored.withColumn("block", F.lit(block))


def op13_sorted_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
