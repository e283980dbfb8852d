"""Byte-level BPE as a deterministic automaton over tokens.

The automaton starts with one state and an arc for every byte. Each merge (u, v) in turn is a gadget: the state that
u-arcs lead to is replaced by a copy without its v-arc, and every state with a u-arc gets an arc labelled uv to where
the v-arc led. What it accepts in the end is exactly the merged forms of texts, one for each text. As all arcs of a
token lead to one state, states are named by tokens.

Once all merges are in, ``compile`` lays the transitions out as arrays, once for each worker. An arc is there by
default; a state's row lists the tokens whose arcs gadgets took from it or from what it is a copy of, with the gadget's
number (under a million entries for 50,000 merges). The arc of a token uv came with its own gadget to the states that
had a u-arc then, so a transition asks the row for the token and for the tokens it begins with. ``Explicit`` builds the
same automaton arc by arc and is compared with it in the tests.

A pre-split word is encoded in one pass from left to right, without stepping back: labels are followed from each
place through a table of their bytes, and the transitions tell the one token that may end each prefix of the word.
Decoding joins the arcs' labels.

Null texts count as empty; rows with null ids are encoded like others; repeated rows get equal results; an empty
table gives an empty result; extra columns are ignored, whatever their names. Texts and words of any length are
encoded whole, in time in proportion to them.
"""

from __future__ import annotations

import gc
import json
import struct
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from dwell.llm.recent import Recent
from dwell.llm.shared import table

_KEPT = 200_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where Latin-1 prints it,
    else the next letter from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (chr(0x100 + k) for k in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


class Automaton:
    def __init__(self, bytes_of: dict[bytes, int]) -> None:
        """bytes_of: the token of each single byte."""
        self.labels: dict[int, bytes] = {t: b for b, t in bytes_of.items()}
        self.tokens: dict[bytes, int] = dict(bytes_of)
        self._born: dict[int, int] = dict.fromkeys(bytes_of.values(), -1)
        self._parts: dict[int, tuple[int, int]] = {}
        self._taken: dict[tuple[int, int], int] = {}
        self._merges = 0

    def merge(self, u: int, v: int, token: int) -> None:
        """The gadget of the next merge. A merge that no text can reach any more, or that is there, changes nothing."""
        now = self._merges
        self._merges += 1
        label = self.labels[u] + self.labels[v]
        if label in self.tokens or not self._arc(u, v, now):
            return
        self._taken[u, v] = now
        self._parts[token] = (u, v)
        self._born[token] = now
        self.labels[token] = label
        self.tokens[label] = token

    def _arc(self, state: int, token: int, time: int) -> bool:
        """Whether the state after ``state`` has an arc ``token`` before the gadget at ``time``."""
        while True:
            at, until = state, time
            while True:  # the chain of copies: uv's state is a copy of v's as it was when uv was born
                taken = self._taken.get((at, token))
                if taken is not None and taken < until:
                    return False
                if at not in self._parts:
                    break
                until = min(until, self._born[at])
                at = self._parts[at][1]
            if token not in self._parts:
                return True
            # the arc came with the gadget of its birth, where the state had an arc for the left part by then
            if self._born[token] >= time:
                return False
            time = self._born[token] + 1
            token = self._parts[token][0]

    def compile(self) -> Automaton:
        """Lays out the transitions; no merge may follow."""
        own: dict[int, list[tuple[int, int]]] = {}
        for (state, token), time in self._taken.items():
            own.setdefault(state, []).append((token, time))
        size = max(self.labels) + 1
        rows: dict[int, np.ndarray] = {}
        for state in self._born:  # a copy comes after what it is a copy of
            row = np.array(own.get(state, []), np.int64).reshape(-1, 2)
            if state in self._parts:
                origin = rows[self._parts[state][1]]
                row = np.concatenate([row, origin[origin[:, 1] < self._born[state]]])
            rows[state] = row
        starts = np.zeros(size + 1, np.int64)
        for state, row in rows.items():
            starts[state + 1] = len(row)
        every = np.concatenate([rows[s][np.argsort(rows[s][:, 0])] for s in sorted(rows)])
        #: A state's exceptions are those from its start on, in order of token; and the gadgets that made them.
        self._start = array("q", np.cumsum(starts).tolist())
        self._token, self._time = array("i", every[:, 0].tolist()), array("i", every[:, 1].tolist())
        #: What a token begins with before its own gadget, and that gadget's number.
        self._stem, self._birth = array("i", [-1]) * size, array("i", [-1]) * size
        for token, (u, _) in self._parts.items():
            self._stem[token], self._birth[token] = u, self._born[token]
        #: The labels as a table: at each place, by a byte, the next place and the token that ends there, or -1.
        self._root: dict[int, tuple[dict, int]] = {}
        for label, token in sorted(self.tokens.items(), key=lambda x: len(x[0])):
            at = self._root
            for byte in label[:-1]:
                at = at.setdefault(byte, ({}, -1))[0]
            at[label[-1]] = (at[label[-1]][0] if label[-1] in at else {}, token)
        self._longest = max(map(len, self.tokens))
        self._asked: dict[int, bool] = {}
        return self

    def step(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow ``state``."""
        key = state << 32 | token
        found = self._asked.get(key)
        if found is None:
            if len(self._asked) >= _KEPT:
                self._asked.clear()
            found = self._asked[key] = self._transition(state, token)
        return found

    def _transition(self, state: int, token: int) -> bool:
        lo, hi, before = self._start[state], self._start[state + 1], self._merges
        while lo < hi and token >= 0:
            k = bisect_left(self._token, token, lo, hi)
            if k < hi and self._token[k] == token and self._time[k] < before:
                return False
            before = self._birth[token] + 1  # a gadget takes its arc before it lays its own
            token = self._stem[token]
        return True

    def encode(self, word: bytes) -> list[int]:
        """The accepted walk over the word's bytes: of each prefix there is one token that may end it, and the pass from
        left to right finds it by the transitions from the tokens that end shorter ones."""
        if (whole := self.tokens.get(word)) is not None:  # one arc from the start
            return [whole]
        root, asked, step = self._root, self._asked, self.step
        n = len(word)
        last = [-1] * (n + 1)  # of the word's first so many bytes
        for lo in range(n):
            state, at, hi = last[lo], root, lo
            key = state << 32
            for byte in word[lo : lo + self._longest]:
                found = at.get(byte)
                if found is None:
                    break
                at, token = found
                hi += 1
                if token >= 0 and last[hi] < 0:
                    may = asked.get(key | token) if lo else True
                    if may or may is None and step(state, token):
                        last[hi] = token
        out, labels = [], self.labels
        while n:
            out.append(last[n])
            n -= len(labels[last[n]])
        return out[::-1]


class Explicit:
    """The same construction with every arc in a table; for small vocabularies and for tests."""

    def __init__(self, alphabet: list[int]) -> None:
        self.arcs: list[dict[int, int]] = [dict.fromkeys(alphabet, 0)]
        self.start = 0

    def merge(self, u: int, v: int, token: int) -> None:
        after: dict[int, int] = {}
        froms = [p for p, arcs in enumerate(self.arcs) if u in arcs and v in self.arcs[arcs[u]]]
        ends = {p: self.arcs[self.arcs[p][u]][v] for p in froms}
        for q in {self.arcs[p][u] for p in froms}:
            after[q] = len(self.arcs)
            self.arcs.append({t: r for t, r in self.arcs[q].items() if t != v})
        for arcs in self.arcs:
            if arcs.get(u) in after:
                arcs[u] = after[arcs[u]]
        # a copy made here has an arc uv too, as far as it kept its u-arc
        twins = {q2: q for q, q2 in after.items()}
        for p, arcs in enumerate(self.arcs):
            origin = twins.get(p, p)
            if origin in ends and u in arcs:
                arcs[token] = ends[origin]

    def accepts(self, tokens: list[int]) -> bool:
        state = self.start
        for t in tokens:
            if t not in self.arcs[state]:
                return False
            state = self.arcs[state][t]
        return True


#: Fixed: how byte-level vocabularies split a text into words before any merge.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Adjoins(Exception):
    """White space next to a space: words can't be told from either side of it alone."""


class Encoder:
    """Texts to ids and back by a tokenizer file's merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.automaton = Automaton({bytes([b]): vocab[x] for b, x in enumerate(letters)})
        for pair in spec["model"]["merges"]:
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            self.automaton.merge(vocab[u], vocab[v], vocab[u + v])
        self.automaton.compile()
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, token in self._special.items():
            self.automaton.labels[token] = text.encode()
        self._split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        self._words = regex.compile(WORDS)
        self._word = Recent(self._encoded, _KEPT)
        self._piece = Recent(self._after_space, _KEPT)

    def _encoded(self, word: str) -> bytes:
        ids = self.automaton.encode(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, part: str) -> bytes:
        """Of a stretch that begins and ends where words do."""
        return b"".join(map(self._word.__getitem__, self._words.findall(part)))

    def _after_space(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():  # letters alone are one word
            return self._encoded(" " + piece)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Adjoins
        return self._ids(" " + piece)

    def _plain(self, text: str) -> bytes:
        """A word takes a single space before it along, so stretches from space to space encode alone, unless white
        space adjoins the space."""
        first, *pieces = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self._ids(first) + b"".join(map(self._piece.__getitem__, pieces))
            except _Adjoins:
                pass
        return self._ids(text)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self._split_special is None or not any(s in text for s in self._special):
            return self._plain(text)
        out = []
        for k, part in enumerate(self._split_special.split(text)):
            out.append(np.array([self._special[part]], "<u4").tobytes() if k % 2 else self._plain(part) if part else b"")
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.automaton.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which runs many tasks; its tables are left out of garbage collections."""
    made = Encoder(path)
    gc.freeze()
    return made


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    rows = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch["text"]:
                ids = own.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(sha256(ids).hexdigest())
                text_sha.append(sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
