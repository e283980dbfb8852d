"""Toxicity: bags of subword embeddings, averaged into a linear softmax, all trained jointly in numpy.

A word is the bag of itself and its character 3- and 4-grams, word ends marked, each hashed to one of 2^17 vectors;
a document is the average over the subwords of all its distinct words and PADDING zero vectors, which keep a few
words from deciding alone. README says how both came to be chosen, with fold figures of the training rows. So a misspelling that
was never seen shares most vectors with the word it comes from. The vectors and the softmax are trained together by
stochastic gradients (Adagrad).

Labels are learned from at most ``per_class`` documents of either label (``labelled.sample``), and of these from those
whose bags take no more than ``labelled.MOST_BYTES`` on the driver. Once trained, the
model is linear in the bag: each word has one sum, so whole texts are scored with one lookup a word. Null and empty
texts have an empty bag and get the score of the bias. Rows with a null id are scored like any other and are never
held out; repeated rows get equal scores; extra columns are ignored, whatever their names. Texts and words of any
length are read to their end, in time and memory in proportion to the text; an empty table gives an empty result, and
without labels every score is 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.labelled import features, remainder, sample
from dwell.llm.shared import table

BITS = 17
BUCKETS = 1 << BITS
PER_CLASS = 2000
THRESHOLD = 0.7
PADDING = 400
_WORDS_KEPT, _CHARS_KEPT = 400_000, 20_000_000
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


def subwords(word: str) -> list[int]:
    """Buckets of the whole word and its 3- and 4-grams."""
    w = "<" + (word.strip(_EDGES) or word) + ">"
    b = w.encode("utf-8", "surrogatepass")
    if len(w) == len(b):
        grams = [b[i : i + n] for n in (3, 4) for i in range(len(b) - n + 1)]
    else:
        grams = [w[i : i + n].encode("utf-8", "surrogatepass") for n in (3, 4) for i in range(len(w) - n + 1)]
    return [crc32(g) >> (32 - BITS) for g in grams] + [crc32(b, 1) >> (32 - BITS)]


def bag(text: str) -> tuple[bytes, bytes]:
    """Distinct buckets of a whole text, and how often each occurs."""
    words = dict.fromkeys(text.lower().split(), 1)
    own = [subwords(w) for w in words]
    if not own:
        return b"", b""
    counts = np.bincount(np.concatenate(own), np.repeat(np.fromiter(words.values(), np.float64, len(words)), [len(x) for x in own]), BUCKETS)
    ids = np.flatnonzero(counts)
    return ids.astype(np.uint32).tobytes(), counts[ids].astype(np.float32).tobytes()


@dataclass(frozen=True)
class Model:
    values: np.ndarray  # by bucket: its vector times the difference of the softmax's rows
    bias: float

    def score(self, total: float, n: float) -> float:
        z = self.bias + total / (n + PADDING)
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def gradients(e: np.ndarray, w: np.ndarray, b: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the weighted mean log loss of some bags (ids, counts): the vectors touched and their gradients, and those of
    the softmax's rows and biases."""
    sizes = np.array([len(ids) for ids, _ in bags])
    flat = np.concatenate([ids for ids, _ in bags])
    share = np.concatenate([n / (n.sum() + PADDING) for _, n in bags])[:, None]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = np.add.reduceat(e[flat] * share, starts, axis=0)
    z = h @ w + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1.0
    g = (p * weight[y][:, None] / len(y)).astype(e.dtype)
    per_id = np.repeat(g @ w.T, sizes, axis=0) * share
    by_id = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[by_id].astype(np.int64), prepend=-1))
    return flat[by_id][first], np.add.reduceat(per_id[by_id], first, axis=0), h.T @ g, g.sum(axis=0)


def fit(rows: list[tuple[int, bytes, bytes]], dim: int = 8, epochs: int = 8, batch: int = 32, rate: float = 2.0, floor: float = 1e-7, seed: int = 11) -> Model:
    """A single label, or none at all, gives a model that always answers with it (without labels: 0.5)."""
    rows = [r for r in rows if r[1]]
    y = np.array([r[0] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not len(y) else 20.0 if y[0] else -20.0)
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    w = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    e2, w2, b2 = np.full(BUCKETS, floor, np.float32), np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    weight = 0.5 / np.bincount(y, minlength=2) * len(y)  # either class counts alike
    bags = [(np.frombuffer(r[1], np.uint32), np.frombuffer(r[2], np.float32)) for r in rows]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            touched, ge, gw, gb = gradients(e, w, b, [bags[i] for i in at], y[at], weight)
            e2[touched] += (ge**2).mean(axis=1)
            e[touched] -= rate * ge / np.sqrt(e2[touched])[:, None]
            w2 += gw**2
            w -= 0.1 * gw / np.sqrt(w2)
            b2 += gb**2
            b -= 0.1 * gb / np.sqrt(b2)
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, 3) == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, held: Callable[[Column], Column] = held_out, per_class: int = PER_CLASS) -> Model:
    return fit(features(documents, sample(labels, "toxic", held, per_class), lambda: bag))


class _Sums(dict):
    """Word to the sum of its subwords' values and their number."""

    def __init__(self, values: np.ndarray) -> None:
        super().__init__()
        self._values = values.tolist()  # a list gives single items faster
        self.chars = 0

    def __missing__(self, word: str) -> complex:
        low = subwords(word)
        self.chars += len(word)
        self[word] = found = complex(sum(map(self._values.__getitem__, low)), len(low))
        return found


class Scorer:
    def __init__(self, model: Model) -> None:
        self._model, self._sums = model, _Sums(model.values)

    def __call__(self, text: str | None) -> float:
        if len(self._sums) > _WORDS_KEPT or self._sums.chars > _CHARS_KEPT:
            self._sums.clear()
            self._sums.chars = 0
        both = sum(map(self._sums.__getitem__, set((text or "").lower().split())), 0j)  # one addition for the sum and the number
        return self._model.score(both.real, both.imag)


def scorer(spark: SparkSession, model: Model) -> Callable[[], Scorer]:
    """For use in tasks; the values are a broadcast of fixed size."""
    shared = spark.sparkContext.broadcast(model)
    return lambda: Scorer(shared.value)


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
    """The rows that score below ``threshold``, with all their columns."""
    make = scorer(documents.sparkSession, model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            yield batch.filter(pa.array([of(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op5_toxicity_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(documents, train(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
