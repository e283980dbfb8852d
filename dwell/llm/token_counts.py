"""Token counts: a tokenizer's numbers of tokens, from Arrow functions that return lengths only.

Texts are cut into segments at safe boundaries, the segments of the texts of an Arrow batch dealt in order to calls of
nearly equal UTF-8 bytes, and each call encoded by the library at once; only lengths leave the function.

A boundary is safe at a space that follows another character: in a vocabulary with no piece that holds a space
mark after another character, no merge crosses it, and the segment after it, its space taken off, gets that space
back as the mark the library puts before every text. ``boundaries_are_safe`` tests the vocabulary; where it does not
hold, texts are encoded whole.

Null texts count as empty; rows with null ids are counted like others; repeated rows get equal counts; an empty
table gives an empty result; extra columns are ignored, whatever their names. A very long text is many segments and so
many calls; only one without a safe boundary is encoded whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.shared import table

MARK = "▁"
LIMIT = 4096


def boundaries_are_safe(model: sentencepiece.SentencePieceProcessor) -> bool:
    """No piece has a mark after another character, and a mark is put before each text."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return model.encode("a", out_type=str)[0][:1] == MARK and not any(MARK in p.lstrip(MARK) for p in pieces)


def segments(text: str, most: int) -> Iterator[str]:
    """Pieces of about ``most`` characters whose token counts add up to that of the text.

    A stretch without any safe boundary stays whole.
    """
    lo, n = 0, len(text)
    while n - lo > most:
        at = text.find(" ", lo + most)
        while at > 0 and text[at - 1] in " " + MARK:  # within a run of spaces, which may be one token
            at = text.find(" ", at + 1)
        if at < 0 or at == n - 1:  # an empty last segment would get no mark
            break
        yield text[lo:at]
        lo = at + 1
    yield text[lo:]


class Counter:
    def __init__(self, path: str, batch_bytes: int = 1 << 19, segment_chars: int = 1 << 14) -> None:
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._most = segment_chars if boundaries_are_safe(self._model) else 1 << 62
        self._batch = batch_bytes

    def calls(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """Segments, with the texts they are of, in as few lists as hold ``batch_bytes`` each and in equal shares."""
        parts = [(i, part, len(part) if part.isascii() else len(part.encode("utf-8", "surrogatepass"))) for i, text in enumerate(texts) for part in segments(text, self._most)]
        total = sum(size for _, _, size in parts)
        share = total / max(1, math.ceil(total / self._batch))
        owner: list[int] = []
        batch: list[str] = []
        done, made = 0, 1
        for i, part, size in parts:
            if batch and done + size / 2 > share * made:  # a segment goes where most of it lies
                yield owner, batch
                owner, batch = [], []
                made += 1
            owner.append(i)
            batch.append(part)
            done += size
        if batch:
            yield owner, batch

    def lengths(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        for owner, batch in self.calls(texts):
            for i, ids in zip(owner, self._model.encode(batch, num_threads=1), strict=True):
                out[i] += len(ids)
        return out


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    rows = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            text = pc.fill_null(batch["text"], "")
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pc.binary_length(text).cast(pa.int64()), pa.array(counter.lengths(text.to_pylist()), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    counted = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
