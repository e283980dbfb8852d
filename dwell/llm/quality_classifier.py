"""Quality classifier: a support vector machine over n-gram indicators scaled by Naive Bayes log-count ratios.

A document is the set of its n-grams (indicators, not counts): words, word pairs, and runs of one to three word
shapes; two more indicators give the share of distinct words and of repeated neighbours. The indicators are
scaled by r = log(p/|p| : q/|q|) of the two classes' smoothed counts, and a linear hinge-loss model is fitted to
the scaled indicators by dual coordinate descent.

Labels are learned from at most ``per_class`` documents of either label (``labelled.sample``), and of these from those
whose features take no more than ``labelled.MOST_BYTES`` on the driver; every whole text is
then scored in Arrow batches with the weights broadcast. Null and empty texts are one document without n-grams and
get the score of the two extra indicators and the bias. Rows with a null id are scored like any other and are never
held out; repeated rows get equal scores; extra columns are ignored, whatever their names. Texts and words of any
length are read to their end, in time and memory in proportion to the text; an empty table gives an empty result, and
without labels every score is 0.5.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.hashing import ngrams
from dwell.llm.labelled import features, remainder, sample
from dwell.llm.shared import table

BITS = 18
BUCKETS = 1 << BITS
PER_CLASS = 3000
#: Logits a unit of margin. By three folds within the training rows the log loss is least at 5 to 7 (README).
SLOPE = 6.0
THRESHOLD = 0.3
_WORDS_KEPT, _CHARS_KEPT = 400_000, 20_000_000
_RUN = re.compile(r"(.)\1+")


class _Classes(dict):
    """For str.translate: letters by case, digits as one class, other characters as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = found = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return found


class _Words(dict):
    """Word to its row in two growing arrays: the codes of the lower-cased word and of its shape, runs cut to one."""

    def __init__(self) -> None:
        super().__init__()
        self.word, self.shape = np.empty(_WORDS_KEPT, np.uint64), np.empty(_WORDS_KEPT, np.uint64)
        self.chars = 0
        self._classes = _Classes()

    def __missing__(self, w: str) -> int:
        k = len(self)
        if k == len(self.word):  # one document may hold more distinct words than are kept
            self.word, self.shape = np.resize(self.word, 2 * k), np.resize(self.shape, 2 * k)
        self.word[k] = xxhash.xxh64_intdigest(w.lower(), 1)
        self.shape[k] = xxhash.xxh64_intdigest(_RUN.sub(r"\1", w.translate(self._classes)), 2)
        self.chars += len(w)
        self[w] = k
        return k


class Grams:
    """Text to its distinct n-gram buckets; keeps the codes of words seen, up to a bound of words and of their characters."""

    def __init__(self) -> None:
        self._seen = _Words()
        self._last = np.zeros(BUCKETS, np.int64)

    def __call__(self, text: str) -> np.ndarray:
        if len(self._seen) > _WORDS_KEPT // 2 or self._seen.chars > _CHARS_KEPT:
            self._seen = _Words()
        words = text.split()
        n = len(words)
        at = np.fromiter(map(self._seen.__getitem__, words), np.int64, n)
        word, shape = self._seen.word[at], self._seen.shape[at]
        same = int(10 * np.count_nonzero(at[1:] == at[:-1]) / max(n - 1, 1))
        # distinct words grow slower than the text: their number is taken against n^0.8
        varied = int(8 * len(set(words)) / max(n, 1) ** 0.8)
        extra = np.array([1000 + same, 2000 + min(varied, 16)], np.uint64)
        grams = [word, ngrams(word, 2, 10), *(ngrams(shape, k, 20) for k in (1, 2, 3)), ngrams(extra, 1, 30)]
        ids = (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)
        order = np.arange(len(ids))
        self._last[ids] = order
        return ids[self._last[ids] == order].astype(np.uint32)  # the last of equal ones


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by bucket, the ratios multiplied in
    bias: float

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum(dtype=np.float64)) + self.bias

    def score(self, ids: np.ndarray) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, SLOPE * self.margin(ids)))))


def log_count_ratios(docs: list[np.ndarray], y: np.ndarray, buckets: int, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, buckets), alpha)
    for ids, label in zip(docs, y, strict=True):
        counts[label][ids] += 1  # ids of a document are distinct
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(
    docs: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, c: float = 1.0, epochs: int = 30, seed: int = 7, tolerance: float = 1e-3
) -> np.ndarray:
    """min |w|²/2 + c Σ max(0, 1 - yᵢ w·xᵢ), one dual variable at a time; y is -1 or 1."""
    w, a = np.zeros(size), np.zeros(len(docs))
    square = np.array([float(v @ v) for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(docs)):
            if not square[i]:
                continue
            g = y[i] * float(w[docs[i]] @ values[i]) - 1.0
            pg = min(g, 0.0) if a[i] == 0 else max(g, 0.0) if a[i] == c else g
            worst = max(worst, abs(pg))
            if pg:
                new = min(max(a[i] - g / square[i], 0.0), c)
                w[docs[i]] += (new - a[i]) * y[i] * values[i]
                a[i] = new
        if worst < tolerance:
            break
    return w


def fit(rows: list[tuple[int, bytes, bytes]], c: float = 1.0) -> Model:
    """A single label, or none at all, gives a model that always answers with it (without labels: 0.5)."""
    y = np.array([r[0] for r in rows], int)
    docs = [np.frombuffer(r[1], np.uint32) for r in rows]
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not len(y) else 1.0 if y[0] else -1.0)
    r = log_count_ratios(docs, y, BUCKETS)
    # a last feature, always 1, is the bias
    values = [np.append(r[d], 1.0) for d in docs]
    wide = [np.append(d, BUCKETS).astype(np.int64) for d in docs]
    w = dual_coordinate_descent(wide, values, 2.0 * y - 1, BUCKETS + 1, c)
    return Model((w[:-1] * r).astype(np.float32), float(w[-1]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, 5) == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, held: Callable[[Column], Column] = held_out, per_class: int = PER_CLASS) -> Model:
    def extract() -> Callable[[str], tuple[bytes, bytes]]:
        grams = Grams()
        return lambda text: (grams(text).tobytes(), b"")

    return fit(features(documents, sample(labels, "quality", held, per_class), extract))


def scorer(spark: SparkSession, model: Model) -> Callable[[], Callable[[str | None], float]]:
    """For use in tasks: a function that makes a function of texts; the weights are a broadcast of fixed size."""
    shared = spark.sparkContext.broadcast(model)

    def make() -> Callable[[str | None], float]:
        grams, of = Grams(), shared.value
        return lambda text: of.score(grams(text or ""))

    return make


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    make = scorer(documents.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            scores = pa.array([of(t.as_py()) for t in batch["text"]], pa.float64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], scores], names=["doc_id", "score"])

    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least ``threshold``, with all their columns."""
    make = scorer(documents.sparkSession, model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            yield batch.filter(pa.array([of(t.as_py()) >= threshold for t in batch.column(at)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(documents, train(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
