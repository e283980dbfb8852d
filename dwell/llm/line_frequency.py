"""Quality rules from line frequency across documents.

Lines are normalised (ASCII letters lower-cased, digits set to 0, white space runs to one space) and hashed to 64
bits. For each host (column ``source``) the distinct documents of a line are counted; lines of more than
``max_documents`` are removed wherever they stand on that host, and a document is depleted when fewer than
``min_words`` words, or less than ``min_share`` of its words, are left.

A null host is a host of its own; null and empty texts have no lines and are depleted; rows with null ids count for
their host each as one document, repeated rows of an id as one with the lines of all of them. Words are runs of bytes
other than ASCII white space. Texts and lines of any length are read to their end, in time and memory in proportion to
the text. An empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.shared import settle, table

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
WINDOW = 8
MAX_DOCUMENTS = 50
MIN_WORDS = 20
MIN_SHARE = 0.5
#: Frequent lines that may be broadcast: 24 bytes each.
BROADCAST_LINES = 200_000
HOT = 10_000
_NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    # pairs of numbered windows are numbered in turn: exact, and a window of 8 words takes three rounds
    span = 1
    while span < width:
        step = min(span, width - span)
        pairs = codes[:-step] * (int(codes.max()) + 1) + codes[step:]
        codes = np.unique(pairs, return_inverse=True)[1]
        span += step
    twice = (np.bincount(codes) > 1)[codes]
    ends = np.zeros(len(words) + 1, np.int64)
    np.add.at(ends, np.flatnonzero(twice), 1)
    np.add.at(ends, np.flatnonzero(twice) + width, -1)
    return int(np.count_nonzero(np.cumsum(ends[:-1])))


def measure(text: str | None) -> tuple[tuple[int, int, int, int, int], dict[int, int]]:
    """Base counts, and the words of each distinct normalised line, all its repeats together."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    dup = 0
    for line in b.split(b"\n"):
        own = line.split()
        if not own:
            continue
        dup += line in seen
        seen.add(line)
        code = xxhash.xxh64_intdigest(b" ".join(own).translate(_NORMAL)) - (1 << 63)
        lines[code] = lines.get(code, 0) + len(own)
    chars = len(text or "") - (len(b) - len(b.translate(None, SPACE)))
    return (len(words), chars, len(b) - len(b.translate(None, SYMBOLS)), dup, repeated_words(words)), lines


_MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, codes array<long>, words array<int>"


def measured(documents: DataFrame) -> DataFrame:
    """One pass over the texts: the counts and the coded lines of every row, with a key of its own."""
    rows = documents.select("doc_id", F.col("source").cast("string").alias("host"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measure(t.as_py()) for t in batch["text"]]
            counts = [pa.array([g[0][k] for g in got], pa.int64()) for k in range(5)]
            codes, words = pa.array([list(g[1]) for g in got], pa.list_(pa.int64())), pa.array([list(g[1].values()) for g in got], pa.list_(pa.int32()))
            names = ["doc_id", "host", *(x.split()[0] for x in _MEASURED.split(", "))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["host"], *counts, codes, words], names=names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, host string, {_MEASURED}")


def frequent_lines(lines: DataFrame, max_documents: int) -> DataFrame:
    """(host, code, n) of lines in more than ``max_documents`` documents of the host; ``lines`` has one row for each
    document and distinct line. Partial counts go before the exchange, so a line of every document is one row a task.
    """
    return lines.groupBy("host", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_documents)


def _met(each: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows of ``each`` (of, is) that are frequent lines. Of all rows of frequent lines a line holds more than one in
    HOT only if it is one of under HOT lines; those are broadcast, so no group that is exchanged is larger."""
    rows, lines = frequent.agg(F.sum("n"), F.count(F.lit(1))).first()
    same = F.col("of").eqNullSafe(F.col("host")) & (F.col("is") == F.col("code"))
    if lines <= BROADCAST_LINES:
        return each.join(F.broadcast(frequent), same, "left_semi")
    hot = frequent.where(F.col("n") > rows // HOT)
    common = each.join(F.broadcast(hot), same, "left_semi")
    return common.unionByName(each.join(F.broadcast(hot), same, "left_anti").join(frequent.where(F.col("n") <= rows // HOT), same, "left_semi"))


def line_rules(
    documents: DataFrame, max_documents: int = MAX_DOCUMENTS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE
) -> DataFrame:
    """Every row with its base counts, the words in removed lines and the verdict ``depleted``."""
    rows = settle(measured(documents).withColumn("row", F.monotonically_increasing_id()), "lines")
    # a line of several rows of an id counts once for its host; only such rows are sent to be told apart
    again = rows.where(F.col("doc_id").isNotNull()).groupBy(F.col("host").alias("at"), F.col("doc_id").alias("id")).count().where("count > 1")
    again = settle(again.select("at", "id"), "again")
    lines = rows.select("host", F.explode("codes").alias("code"))
    if not again.isEmpty():
        same = F.col("host").eqNullSafe(F.col("at")) & (F.col("doc_id") == F.col("id"))
        once = rows.join(again, same, "left_semi").select("host", "doc_id", F.explode("codes").alias("code")).distinct()
        lines = rows.join(again, same, "left_anti").select("host", F.explode("codes").alias("code")).unionByName(once.select("host", "code"))
    frequent = settle(frequent_lines(lines, max_documents), "frequent")
    each = rows.select("row", "host", F.explode(F.arrays_zip(F.col("codes").alias("code"), F.col("words").alias("words"))).alias("line")).select(
        "row", F.col("host").alias("of"), F.col("line.code").alias("is"), F.col("line.words").alias("words")
    )
    removed = _met(each, frequent).groupBy("row").agg(F.sum("words").alias("removed"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        rows.drop("codes", "words")
        .join(removed, "row", "left")
        .withColumn("removed_words", F.coalesce("removed", F.lit(0)))
        .withColumn("depleted", (left < min_words) | (left < min_share * F.col("n_words")))
        .drop("row", "removed")
    )


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        line_rules(table(spark, sf_dir, "documents"))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
    )
