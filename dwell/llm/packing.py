"""Cost-balanced packing of documents into sequences of bounded length.

A document's ids, and an end id, are cut into chunks of the sequence length; full chunks are sequences of their own.
The rest of each document is packed within its group: the cost of a piece of n tokens is estimated as
``linear * n + quadratic * n²`` (attention), and pieces, in descending order, each go to the sequence of lowest
cost that still has room. When none has room for a whole piece, it is cut to fill the roomiest sequence. So a group
of T tokens fills T/length sequences, rounded up, and pads less than one sequence.

Chunks are dealt to groups of about ``group`` documents' by a hash of the document's id, its number of ids, the chunk's
checksum, the task that cut it, and how many equal ones that task has cut before: a row that is repeated, be it a
third of all, is spread like others. Every group is packed by one task and holds at most a sequence length of ids a
document, whatever the documents' lengths. Of pieces of equal length that with the lesser id, start and checksum goes
first, and of sequences of equal cost the first made is taken.

Null texts count as empty: such a document is its end id alone. Rows with null ids are packed like others, last of
their group, and ids of any size beside them stay as they are; each
row of a repeated id is packed as a document of its own; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dwell.llm.shared import table

LENGTH = 2048
END_ID = 1
GROUP = 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
_WORDS_KEPT = 400_000


class _Merges:
    """The merges of a tokenizer file for many plain units at once: a unit is its UTF-8 bytes and a byte 1, which stands
    for the end of a word, as in the file's tokens; ids are in the order of the merges."""

    END = "\x01"

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}  # bytes that stand for themselves
        rest = (chr(0x100 + k) for k in range(256))
        byte_of = {chr(b) if b in plain else next(rest): b for b in range(256)}
        ranks = {}
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            if set(token.removesuffix("</w>")) <= byte_of.keys() and (token == "</w>" or not token.startswith("<|")):
                own = token.removesuffix("</w>")
                ranks[bytes(byte_of[c] for c in own) + (b"\x01" if own != token else b"")] = i
                self._ends[i] = own != token
        self._encoding = tiktoken.Encoding("units", pat_str="[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, units: list[str]) -> Iterator[bytes]:
        ids = np.array(self._encoding.encode_ordinary(self.END.join(units) + self.END), "<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(units):
            raise ValueError("units with an end mark inside")
        raw = ids.tobytes()
        lo = 0
        for hi in ends.tolist():
            yield raw[4 * lo : 4 * hi]
            lo = hi


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases and drops white space, so that words cut at spaces and line ends
    encode alone. Plain words (Latin letters, no apostrophe) are cut further where that tokenizer cuts them: runs of
    letters, single digits, runs of other characters; their units are merged in bulk, other words go through the
    tokenizer. What is not known yet is encoded many words at a time, and kept up to a bound.
    """

    _UNITS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
    _ODD = re.compile("[^!-~\xa1-\u012f\u0131-\u024f]|'|<\\|")

    def __init__(self, path: str) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._merges = _Merges(path)
        self._words: dict[str, bytes] = {"": b""}

    def _learn(self, words: set[str]) -> None:
        odd, plain, cut = [], [], []
        for w in words:
            (odd if self._ODD.search(w) else plain).append(w)
        if plain:
            # one pass of the units' pattern over all words at once: a line feed, which no word holds, ends each
            units = self._UNITS.findall("\n".join(plain).lower() + "\n")
            merged = self._merges([u for u in units if u != "\n"])
            own: list[bytes] = []
            for u in units:
                if u == "\n":
                    cut.append(b"".join(own))
                    own = []
                else:
                    own.append(next(merged))
            self._words.update(zip(plain, cut, strict=True))
        if odd:
            encoded = self._tokenizer.encode_batch_fast(odd, add_special_tokens=False)
            self._words.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(odd, encoded, strict=True))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special ones added."""
        for lo in range(0, len(texts), 64):
            split = [t.replace("\n", " ").split(" ") for t in texts[lo : lo + 64]]
            if len(self._words) > _WORDS_KEPT:
                self._words = {"": b""}
            if missing := set().union(*split).difference(self._words):
                self._learn(missing)
            for words in split:
                yield b"".join(map(self._words.__getitem__, words))


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, which runs many tasks."""
    return WordEncoder(path)


class _Roomiest:
    """Sequences by room left; finds the cheapest with enough room in log(length) steps."""

    def __init__(self, n: int, length: int) -> None:
        self._size = 1 << math.ceil(math.log2(length + 1))
        self._heaps: list[list[tuple[float, int]]] = [[] for _ in range(length + 1)]
        self._best: list[tuple[float, int, int] | None] = [None] * (2 * self._size)
        self._heaps[length] = [(0.0, k) for k in range(n)]
        self._raise(length)

    def _raise(self, room: int) -> None:
        at, best = room + self._size, self._best
        best[at] = (*self._heaps[room][0], room) if self._heaps[room] else None
        while at > 1:
            at >>= 1
            a, b = best[2 * at], best[2 * at + 1]
            best[at] = a if b is None or a is not None and a <= b else b

    def take(self, need: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the cheapest sequence with at least ``need`` room, which leaves the structure."""
        lo, hi, found = need + self._size, 2 * self._size, None
        while lo < hi:
            for at in ([lo] if lo & 1 else []) + ([hi - 1] if hi & 1 else []):
                if (x := self._best[at]) is not None and (found is None or x < found):
                    found = x
            lo, hi = (lo + 1) >> 1, hi >> 1
        if found is not None:
            heapq.heappop(self._heaps[found[2]])
            self._raise(found[2])
        return found

    def most(self) -> int:
        """The most room any sequence has."""
        at = 1
        while at < self._size:
            at = 2 * at + 1 if self._best[2 * at + 1] is not None else 2 * at
        return at - self._size

    def put(self, cost: float, sequence: int, room: int) -> None:
        heapq.heappush(self._heaps[room], (cost, sequence))
        self._raise(room)


def pack(lengths: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the item, piece length, sequence, offset) for items of 1 to ``length`` tokens."""
    total = sum(lengths)
    rooms = _Roomiest(-(-total // length), length)
    queue = [(-n, i, 0) for i, n in enumerate(lengths)]
    heapq.heapify(queue)
    out = []
    while queue:
        n, i, start = heapq.heappop(queue)
        n = -n
        if (found := rooms.take(n)) is None:
            part = rooms.most()  # there is always room: all sequences together hold all tokens
            heapq.heappush(queue, (part - n, i, start + part))
            n, found = part, rooms.take(part)
        cost, sequence, room = found
        out.append((i, start, n, sequence, length - room))
        if room > n:
            rooms.put(cost + linear * n + quadratic * n * n, sequence, room - n)
    return out


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(documents: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    rows = documents.select("doc_id", "text")
    groups = max(1, math.ceil(rows.count() / group))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full chunks carry their checksum; the rest of a document carries its ids."""
        encode = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        # equal rows are told apart by their number within the task: it is the same in any order of the rows
        cut_before: Counter[int] = Counter()
        part_id = TaskContext.get().partitionId()
        for batch in batches:
            at, start, size, total, crc, rest, nth = [], [], [], [], [], [], []
            names = batch["doc_id"].to_pylist()
            for k, ids in enumerate(encode([t or "" for t in batch["text"].to_pylist()])):
                ids += end
                n = len(ids) // 4
                for lo in range(0, n, length):
                    part = ids[4 * lo : 4 * (lo + length)]
                    full = len(part) == 4 * length
                    at.append(k)
                    start.append(lo)
                    size.append(len(part) // 4)
                    total.append(n)
                    crc.append(crc32(part))
                    key = hash((names[k], n, lo, crc[-1]))
                    nth.append(cut_before[key] << 24 | part_id)
                    cut_before[key] += 1
                    rest.append(None if full else np.frombuffer(part, "<u4").astype("<u2" if np.frombuffer(part, "<u4").max() < 65536 else "<u4").tobytes())
            own = [pa.array(x, pa.int64()) for x in (start, size, total, crc, nth)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), *own, pa.array(rest, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "crc", "nth", "ids"])

    cut = rows.mapInArrow(chunks, f"doc_id {kind}, start long, length long, doc_tokens long, crc long, nth long, ids binary")
    dealt = cut.withColumn("bin", F.pmod(F.xxhash64("doc_id", "doc_tokens", "crc", "nth"), F.lit(groups))).drop("nth")

    def packed(key: tuple, pieces: pa.Table) -> pa.Table:
        pieces = pieces.combine_chunks().sort_by([("doc_id", "ascending"), ("start", "ascending"), ("crc", "ascending")])  # null ids last
        size, start, crc = (pieces[c].to_numpy() for c in ("length", "start", "crc"))
        full, rest = np.flatnonzero(size == length), np.flatnonzero(size < length)
        ids = pieces["ids"].take(pa.array(rest)).to_pylist()
        sizes = size[rest].tolist()

        def check(i: int, lo: int, n: int) -> int:
            return crc32(np.frombuffer(ids[i], f"<u{len(ids[i]) // sizes[i]}")[lo : lo + n].astype("<u4").tobytes())

        got = np.array(pack(sizes, length), np.int64).reshape(-1, 5)
        checks = [check(*g[:3]) for g in got.tolist()]
        at = np.concatenate([full, rest[got[:, 0]]])
        first = key[0].as_py() << 32  # a group's sequences are numbered from here
        columns = {
            "start": np.concatenate([start[full], start[rest[got[:, 0]]] + got[:, 1]]), "length": np.concatenate([size[full], got[:, 2]]), "ids_crc32": np.concatenate([crc[full], np.array(checks, np.int64)]),
            "doc_tokens": pieces["doc_tokens"].to_numpy()[at], "sequence_id": first + np.concatenate([np.arange(len(full)), len(full) + got[:, 3]]), "offset": np.concatenate([np.zeros(len(full), np.int64), got[:, 4]]),
        }
        return pa.table({"doc_id": pieces["doc_id"].take(pa.array(at))} | {c: pa.array(x, pa.int64()) for c, x in columns.items()})

    return dealt.groupBy("bin").applyInArrow(packed, f"doc_id {kind}, {_PIECE}")


def op3_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
