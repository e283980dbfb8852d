import heapq
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dwell.llm import hard_negatives as H
from dwell.llm import lexical_search as L
from dwell.llm import sharding as S
from dwell.llm.registry import QUERIES

# ---- shards


def plain_loads(sizes, shards):
    loads = [(0, s) for s in range(shards)]
    for n in sorted(sizes, reverse=True):
        load, s = loads[0]
        heapq.heapreplace(loads, (load + n, s))
    return {s: load for load, s in loads}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=7), st.integers(1, 40), st.integers(0, 300))
def test_classes_fill_shards_as_groups_one_by_one(loads, size, n):
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    one_by_one = list(heap)
    for _ in range(n):
        load, s = one_by_one[0]
        heapq.heapreplace(one_by_one, (load + size, s))
    taken = S.place(heap, size, n)
    assert sorted(heap) == sorted(one_by_one) and taken.sum() == n
    assert {s: loads[s] + int(taken[s]) * size for s in range(len(loads))} == {s: load for load, s in one_by_one}


def shards(spark, rows, schema="doc_id long, text string", n=40):
    return [r.asDict() for r in S.shard_documents(spark.createDataFrame(rows, schema), n).collect()]


def check_shards(rows, got, n):
    assert Counter((d, crc32((t or "").encode()), len((t or "").encode()) + 16) for d, t in rows) == Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in got)
    assert {r["law"] for r in got} <= {"bytes"} and {r["grown_shard"] for r in got} <= {None}
    for s in range(n):
        own = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        ids = [r["doc_id"] for r in own]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    at = {}
    for r in got:
        at.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in at.values())
    sizes = Counter()
    for _, t in rows:
        sizes[t or ""] += len((t or "").encode()) + 16
    loads = Counter({s: 0 for s in range(n)})
    for r in got:
        loads[r["shard"]] += r["size"]
    assert dict(loads) == plain_loads(sizes.values(), n)


def test_shards_are_those_of_groups_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_shards([(r.doc_id, r.text) for r in docs.collect()], [r.asDict() for r in QUERIES["op12_lpt_shards"](spark, sf).collect()], 40)


def test_shards_with_copies_nulls_and_long_texts(spark):
    rows = [(k, "same text") for k in range(700)] + [(k, f"{k}é" * (k % 5)) for k in range(700, 1400)] + [(None, None), (None, ""), (5, None), (5, None), (5, "same text"), (1 << 60, "x" * 200_000), (-3, "A\x00b")]
    check_shards(rows, shards(spark, rows, n=7), 7)
    check_shards(rows[:1], shards(spark, rows[:1], n=3), 3)


def test_shards_of_empty_tables_and_clashing_columns(spark):
    assert shards(spark, []) == []
    rows = [(k, f"t{k % 3}", "x", 1, 2, 3, 4) for k in range(20)]
    got = shards(spark, rows, "doc_id long, text string, key string, shard int, slot int, size int, row int")
    check_shards([r[:2] for r in rows], got, 40)


# ---- lexical search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def plain_search(docs, items, k=10):
    own = [(d, plain_terms(t)) for d, t in docs]
    own = [(d, Counter(w), len(w)) for d, w in own if w]
    N, total = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in own:
            m = 100 - 90 + 90 * n * N // total
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if c[t])
            if s > 0:
                found.append((s, d))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(found[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, **more):
    got = L.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **more)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    return sorted(map(tuple, got.collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBZ09é—İ \n\t\x0b\x1c\x7f.-_[`{\xa0", max_size=40))
def test_terms(text):
    assert [t.decode() for t in L.terms(text.encode())] == plain_terms(text)


@given(st.lists(st.tuples(st.integers(0, 1 << 40), st.integers(0, 99)), max_size=60))
def test_radix_order_is_stable(pairs):
    keys = np.array([p[0] for p in pairs], np.uint64)
    assert L.radix_order(keys).tolist() == np.argsort(keys, kind="stable").tolist()


def test_search_is_the_plain_one(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()] for t, c in (("documents", ("doc_id", "text")), ("benchmark", ("item_id", "text"))))
    got = QUERIES["op13_sorted_impacts"](spark, sf)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain_search(docs, items)


@pytest.mark.parametrize("block_bytes", [L.BLOCK_BYTES, 20])
def test_search_with_nulls_ties_repeats_and_blocks(spark, monkeypatch, block_bytes):
    docs = [(k, f"tie word{k % 3} {'common ' * (k % 4)}") for k in range(60)] + [(None, "rare tie"), (None, None), (7, "rare"), (7, "rare"), (8, ""), (9, "--- !"), (1 << 60, "long tail " * 20_000 + "rare"), (-4, "rare tie")]
    items = [(1, "tie"), (2, "RARE"), (3, None), (4, ""), (5, "absent"), (None, "word1 common"), (6, "rare tie common long tail"), (7, "word2 word2 word2")]
    assert searched(spark, docs, items, block_bytes=block_bytes) == plain_search(docs, items)


def test_slices_of_few_entries_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_ENTRIES", 3)
    assert list(L._slices(np.array([1, 2, 5, 0, 1]), 3)) == [(0, 2), (2, 3), (3, 5)]


def test_search_of_empty_tables_and_clashing_columns(spark):
    assert searched(spark, [], [(1, "a")]) == searched(spark, [(1, "a")], []) == []
    docs = spark.createDataFrame([(1, "a b", 5, "x", 3)], "doc_id long, text string, item_id long, score string, n int")
    got = L.search(docs, spark.createDataFrame([(9, "a", 1)], "item_id long, text string, doc_id int"))
    assert [tuple(r)[:3] for r in got.collect()] == [(9, 1, 1)]


# ---- hard negatives


def plain_negatives(rows, least_share=80):
    """rows: (id, vector, label), labels as they are."""
    own = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    own = [(i, q, (lab + 1) % 10 if i % 7 == 0 else lab) for i, q, lab in own]
    out = []
    for k, (i, q, lab) in enumerate(own):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j, other == lab) for m, (j, p, other) in enumerate(own) if m != k and len(p) == len(q))
        for ps, pid, _ in [x for x in scored if x[2]][:5]:
            near = [(-s, j) for s, j, same in scored if not same and least_share * -ps <= 100 * -s <= 100 * -ps]
            out += [(i, pid, r + 1, j, -ps, s) for r, (s, j) in enumerate(near[:5])]
    return sorted(out)


def negatives(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = H.hard_negatives(df, F.col("vec_id") % 100 == 0, label, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def test_negatives_of_even_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op11_dual_tree_negatives"](spark, sf).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got == plain_negatives(rows) and got


def clustered(n, seed, copies=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    rows = []
    for k in range(n):
        v = centres[k % 12] + 0.05 * rng.normal(size=8)
        if copies and k % 3 == 0:
            v = centres[0]  # a third of all rows are copies
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(0, 10)) if k % 3 else k % 2))
    return rows


def test_negatives_of_clusters_copies_and_small_groups(spark):
    rows = clustered(1500, 3)
    assert negatives(spark, rows, group=4, lane=200) == plain_negatives(rows)


def test_negatives_with_nulls_and_other_widths(spark):
    rows = clustered(400, 4)
    rows += [(None, [1.0] * 8, 1), (500, None, 1), (600, [], 1), (700, [1.0, None] + [0.0] * 6, 1), (800, [float("nan")] * 8, 1), (900, [1.0] * 8, None), (1000, [1.0, 2.0], 1), (1001, [1.0, 2.0], 1), (1002, [1.0, 1.9], 2), (100, rows[5][1], 3), (100, rows[5][1], 3), (1100, [0.0] * 8, 2), (1101, [0.0] * 8, 2), (1102, [0.0] * 8, 3)]
    assert negatives(spark, rows) == plain_negatives(rows)
    # scores that leave 53 bits are exact, and rows whose scores leave 64 take no part
    big = [(0, [2.0**17, 3.0], 1), (1, [2.0**17, 5.0], 1), (2, [2.0**17, 4.0], 2), (3, [2.0**17 - 1, 4.0], 2), (4, [2.0**30, 4.0], 2), (100, [3e38, 1.0], 1)]
    assert negatives(spark, big) == plain_negatives([r for r in big if r[0] < 4])


def test_negatives_of_empty_tables_and_clashing_columns(spark):
    assert negatives(spark, []) == negatives(spark, [(1, [1.0], 1)]) == negatives(spark, [(100, [1.0], 1)]) == []
    rows = clustered(300, 5)
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "vec_id long, embedding array<float>, label int, row int, q int, id int, anchor int")
    got = H.hard_negatives(df, F.col("vec_id") % 100 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_intervals_hold_all_products():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.normal(size=(30, 6)) * 50 + rng.normal(size=6) * 100, rng.normal(size=(40, 6)) * 20
        na, nb = H.Nodes(a, 8), H.Nodes(b, 16)
        low, high = H.interval(na.ball(0, len(na.starts)), nb.ball(0, len(nb.starts)))
        assert low <= (a @ b.T).min() and (a @ b.T).max() <= high


def test_distant_nodes_are_not_scored(monkeypatch):
    """Anchors whose wanted range lies in one cluster score that cluster's leaves only."""
    rng = np.random.default_rng(2)
    q = np.concatenate([c + rng.integers(-3, 4, (256, 8)) for c in np.eye(8) * 1000])
    scored = []
    monkeypatch.setattr(H.Asked, "_score", lambda self, a, ids, rows, labels, q, b, small: scored.append((a.start, b.start)))
    lo, hi = np.full((8, 1), 900_000), np.full((8, 1), 1_100_000)
    asked = H.Asked(np.arange(8), np.zeros(8, int), np.tile(np.eye(8)[0] * 1000, (8, 1)), lo, hi, False, 5)
    asked.meet(np.arange(len(q)), np.arange(len(q)), np.ones(len(q), int), q)
    assert scored == [(0, 0)]
