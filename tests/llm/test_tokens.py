import random
from collections import defaultdict
from itertools import product
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dwell.llm import bpe_automaton as B
from dwell.llm import packing as K
from dwell.llm import token_counts as C

ODD = ["", " ", "  a", "a  b ", "\n\n x\ty  ", "don't we'll x", "<|endoftext|>hi <|endoftext|>", "<s>a</s>", "日本語 テキスト😀", "a" * 300, "\x1c x\x85y\xa0z", "hello  \n  world", "é\n É ΑΣ Σ İ", "▁ a ▁▁b", "\x00a", "1234 thé ²½"]
ROWS = [*enumerate(ODD), (None, None), (3, "same"), (3, "same"), (99, "word, and another; " * 20_000)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in ROWS], "doc_id long, text string, n_tokens int, ids string, start string").repartition(2)


def texts():
    rng = random.Random(4)
    return [*ODD, *("".join(rng.choice(" abethrniøoÉ'\n.é\t1<|>#") for _ in range(rng.randint(1, 80))) for _ in range(300))]


def test_counts_match_the_library(spark, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert C.boundaries_are_safe(model)
    got = C.token_counts(documents, P.path("piece_bpe_32k.model"), 100).collect()
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert C.token_counts(documents.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_segments_add_up():
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for t in texts():
        for most in (1, 7, 50):
            assert sum(len(model.encode(s)) for s in C.segments(t, most)) == len(model.encode(t))
            assert " ".join(C.segments(t, most)) == t


def test_calls_have_equal_bytes():
    counter = C.Counter(P.path("piece_bpe_32k.model"), batch_bytes=4000, segment_chars=100)
    many = ["é" * 40 + " " + "a" * 50 + " b" * 20] * 300 + ["plain words " * 4000, "", "日本 語テ " * 900]
    sizes = [sum(len(p.encode()) for p in batch) for _, batch in counter.calls(many)]
    assert max(sizes) <= 4000 + 600 and min(sizes) >= max(sizes) - 800 and len(sizes) > 10
    owners = [i for owner, _ in counter.calls(many) for i in owner]
    assert owners == sorted(owners) and set(owners) == set(range(len(many)))
    assert counter.lengths(many) == [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).encode(many)]


def test_automaton_ids_and_round_trip(spark, documents):
    from hashlib import sha256

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = B.Encoder(P.path("byte_bpe_50k.json"))
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        raw = own.encode(t)
        assert np.frombuffer(raw, "<u4").tolist() == ids
        assert own.decode(raw) == library.decode(ids, skip_special_tokens=False)
    got = {(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.encode_documents(documents, P.path("byte_bpe_50k.json")).collect()}
    want = set()
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((str(i), len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want


def merged(word, merges):
    """BPE as it is told: the first merge that applies, everywhere from the left, until none applies."""
    out = list(word)
    while True:
        best = min((merges[p] for p in zip(out, out[1:], strict=False) if p in merges), default=None)
        if best is None:
            return out
        pair, i, new = next(p for p, r in merges.items() if r == best), 0, []
        while i < len(out):
            if tuple(out[i : i + 2]) == pair:
                new.append(out[i] + out[i + 1])
                i += 2
            else:
                new.append(out[i])
                i += 1
        out = new


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6))
def test_automata_accept_exactly_the_merged_forms(seed):
    rng = random.Random(seed)
    vocab, merges = [b"a", b"b", b"c"], {}
    while len(merges) < 6:
        u, v = rng.choice(vocab), rng.choice(vocab)
        if (u, v) not in merges and u + v not in vocab and merged([bytes([c]) for c in u + v], merges) == [u, v]:
            merges[u, v] = len(merges)
            vocab.append(u + v)
    number = {t: i for i, t in enumerate(vocab)}
    compiled, full = B.Automaton({t: number[t] for t in vocab[:3]}), B.Explicit([0, 1, 2])
    for u, v in merges:
        compiled.merge(number[u], number[v], number[u + v])
        full.merge(number[u], number[v], number[u + v])
    compiled.compile()
    for word in ("".join(w).encode() for n in range(1, 7) for w in product("abc", repeat=n)):
        want = [number[t] for t in merged([bytes([c]) for c in word], merges)]
        assert compiled.encode(word) == want and full.accepts(want)
    for tokens in (list(t) for n in (2, 3) for t in product(range(len(vocab)), repeat=n)):
        word = b"".join(vocab[t] for t in tokens)
        right = merged([bytes([c]) for c in word], merges) == [vocab[t] for t in tokens]
        assert full.accepts(tokens) == right == all(compiled.step(a, b) for a, b in zip(tokens, tokens[1:], strict=False))


def check_packing(rows, ids_of, length):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= length
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            ids = ids_of[doc]
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids_of[doc])
    return sum(length - sum(n for _, n in s) for s in sequences.values())


def test_packing_holds_every_id_once(spark):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(i, t) for i, t in enumerate([*texts(), "word, and another; " * 5_000])]
    d = spark.createDataFrame([(i, t if t else None, "x", 0) for i, t in rows], "doc_id long, text string, crc string, offset int").repartition(3)
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    got = K.pack_documents(d, P.path("word_bpe_49k.json"), length=256, group=100).collect()
    assert {r.doc_id for r in got} == set(ids)
    assert check_packing(got, ids, 256) < 256 * 4  # less than a sequence for each of the groups
    assert K.pack_documents(d.limit(0), P.path("word_bpe_49k.json")).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None), (7, None)], "doc_id long, text string")
    got = K.pack_documents(same, P.path("word_bpe_49k.json")).collect()
    assert sorted(r.length for r in got) == [1, 1, 3, 3] and len({(r.sequence_id, r.offset) for r in got}) == 4


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60))
def test_pack_fills_sequences_and_balances_costs(lengths):
    got = K.pack(lengths, 64)
    assert sum(g[2] for g in got) == sum(lengths)
    used = defaultdict(int)
    for _, _, n, s, offset in sorted(got, key=lambda g: (g[3], g[4])):
        assert offset == used[s]
        used[s] += n
    assert len(used) == -(-sum(lengths) // 64) and all(x <= 64 for x in used.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=40))
def test_each_piece_goes_to_the_cheapest_sequence_with_room(lengths):
    """Against a plain search of all sequences; ties, of costs and of lengths, go to the first."""
    length = 32
    rooms, costs = [length] * -(-sum(lengths) // length), [0.0] * -(-sum(lengths) // length)
    queue = sorted((-n, i, 0) for i, n in enumerate(lengths))
    want = []
    while queue:
        n, i, start = queue.pop(0)
        n = -n
        fits = [s for s in range(len(rooms)) if rooms[s] >= n]
        if not fits:
            part = max(rooms)
            queue = sorted([*queue, (part - n, i, start + part)])
            n, fits = part, [s for s in range(len(rooms)) if rooms[s] >= part]
        s = min(fits, key=lambda s: (costs[s], s))
        want.append((i, start, n, s, length - rooms[s]))
        rooms[s] -= n
        costs[s] += K.LINEAR * n + K.QUADRATIC * n * n
    assert K.pack(lengths, length) == want


def test_repeated_rows_are_spread(spark):
    rows = spark.range(4000).selectExpr("cast(null as long) AS doc_id", "cast(null as string) AS text").unionByName(spark.range(2000).selectExpr("7L AS doc_id", "'the same words' AS text"))
    got = K.pack_documents(rows.repartition(4), P.path("word_bpe_49k.json"), group=100)
    by_group = got.selectExpr("shiftright(sequence_id, 32) AS g").groupBy("g").count().toPandas()["count"]
    assert got.count() == 6000 and len(by_group) > 50 and by_group.max() < 250


def test_packing_keeps_ids_beside_null_ids(spark):
    """Ids above 2^53 in the group of a null id."""
    big = 9007199254740993
    d = spark.createDataFrame([(big, "a b c"), (None, "d e"), (big + 2, "f"), (None, None), (-big, "g " * 3000)], "doc_id long, text string")
    rows = K.pack_documents(d, P.path("word_bpe_49k.json"), 2048).collect()
    assert {r.doc_id for r in rows} == {big, big + 2, None, -big}
    assert {r.doc_id: r.doc_tokens for r in rows if r.doc_id is not None} == {big: 4, big + 2: 2, -big: 3001}
    assert sorted(r.doc_tokens for r in rows if r.doc_id is None) == [1, 3]
