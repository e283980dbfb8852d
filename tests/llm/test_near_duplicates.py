import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from dwell.llm import golay, simhash
from dwell.llm.components import components
from dwell.llm.grid_join import _partners, _Side, _units, join_sides, near_vectors, plan_grid
from dwell.llm.shared import join_counted
from dwell.operators.graph import forest


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_meet_at_one_error():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 20_000)
    k = golay.keys(w)
    for b in range(23):
        o = golay.keys(w ^ (1 << b))
        assert ((k[:, :, None] == o[:, None, :]) & (k >= 0)[:, :, None]).any(axis=(1, 2)).all()
    assert {int(x) for x in (k >= 0).sum(1)} <= {1, 6}
    # each index names a codeword within 3 bits (the first) or 4 bits of the word
    near, _ = golay.tables()
    assert np.bitwise_count(near).max() == 3 and len(np.unique(near)) == 2048


def test_fuzzy_keys_meet_at_two_errors():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63))
        a, b = rng.choice(64, 2, replace=False)
        y = x ^ (1 << int(a)) ^ (1 << int(b))
        keys, at = simhash.fuzzy_keys(np.array([x, y], np.uint64).view(np.int64))
        assert set(keys[at == 0]) & set(keys[at == 1])


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aBé \n\t\x0b ", max_size=40))
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def brute(fps):
    sets = Sets()
    values = sorted(set(fps.values()))
    v = np.array(values, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i:] ^ v[i]) <= 2) + i:
            sets.link(values[i], values[j])
    least = {}
    for d, f in fps.items():
        r = sets.find(f)
        least[r] = min(least.get(r, d), d)
    return {d: least[sets.find(f)] for d, f in fps.items()}


def test_query_agrees_with_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    fps = {d: plain_fingerprint(t) for d, t in docs.items()}
    got = simhash.op10_simhash_golay(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == brute(fps)


def test_dense_fingerprints_in_small_blocks(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 5)]
    fps = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (200, 2))})
    signed = [int(x) for x in np.array(fps, np.uint64).view(np.int64)]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=16)
    roots = {r.node: r.root for r in components(links).collect()}
    want = brute(dict(enumerate(fps)))
    group = {}
    for k, x in enumerate(signed):
        group.setdefault(want[k], set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in group.values()) and len(set.union(*group.values())) == len(group)


def test_near_duplicate_edge_cases(spark):
    rows = [(5, None, "x"), (2, "", "x"), (None, " \n", "x"), (7, "one two", "x"), (7, "one two", "x"), (8, "ONE two", "x"), (None, "null id alone here", "x"), (9, "word " * 100_000, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(d).collect()]
    assert sorted(got, key=str) == sorted([(5, 2), (2, 2), (None, 2), (7, 7), (7, 7), (8, 7), (None, None), (9, 9)], key=str)
    assert simhash.near_duplicates(d.limit(0)).count() == 0
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "7", "9", "None"]
    assert simhash.keep_one(d.limit(0)).count() == 0


def test_rows_go_not_ids(spark):
    a, b = "the river ran slowly past the old mill by the town", "she read a long letter at the window in the evening"
    rows = [(3, a, 1), (7, a, 2), (7, b, 3), (8, b, 4), (None, a, 5), (None, "quite another text of its own", 6), (None, "quite another text of its own", 7)]
    for parts in (1, 4):
        d = spark.createDataFrame(rows, "doc_id long, text string, __fp_0 int").repartition(parts)
        assert sorted((str(r.doc_id), r.text) for r in simhash.keep_one(d).collect()) == [("3", a), ("7", b), ("None", "quite another text of its own")]


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001 + k) for k in range(50)] + [(5, 5), (3, 4)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[k] for k in range(201)}) == 1 and len({roots[k] for k in range(1000, 1051)}) == 1 and len(set(roots.values())) == 2
    in_rounds = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), few=20).collect()}
    assert set(in_rounds) == set(roots) and len(set(in_rounds.values())) == 2 and len({in_rounds[k] for k in range(201)}) == 1
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long"), few=0, rounds=1)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = forest(np.array([4, 2, 9]), np.array([2, 1, 8]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {2: 1, 4: 1, 9: 8}


def brute_vectors(ids, vectors, t=0.95):
    sets, links = Sets(), [0] * len(ids)
    for i, v in enumerate(vectors):
        sets.find(i)
        for j in range(i):
            a, b = v, vectors[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= t:
                links[i] += 1
                links[j] += 1
                sets.link(i, j)
    least = {}
    for i, d in enumerate(ids):
        least[sets.find(i)] = min(least.get(sets.find(i), d), d)
    return {d: (links[i], least[sets.find(i)]) for i, d in enumerate(ids)}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_grid_join_agrees_with_all_pairs(spark, kind):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    rows = [(centres[k % 12] + rng.normal(size=16) * 0.12 * (k % 5) / 2) * (1 + k % 3) for k in range(700)]
    rows += [rows[0]] * 30 + [rng.normal(size=7) for _ in range(20)] + [np.ones(7), np.ones(7) * 2]
    vectors = [np.asarray(r, np.float32 if kind == "float" else np.float64).astype(float) for r in rows]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    ids = list(range(3, 3 + len(vectors)))
    data = [(i, [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)] + [(10_000 + k, v) for k, v in enumerate(odd)]
    d = spark.createDataFrame([(*r, "n") for r in data], f"vec_id long, embedding array<{kind}>, n string").repartition(3)
    got = near_vectors(d, interval=64).collect()
    want = brute_vectors(ids, vectors) | {10_000 + k: (0, 10_000 + k) for k in range(len(odd))}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(data)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_units_meet_each_other_once():
    for n in range(1, 12):
        met = sorted(tuple(sorted((i, j))) for i in range(n) for j in _partners(i, n))
        assert met == [(i, j) for i in range(n) for j in range(i, n)]
    assert _units([(0, 3), (2, 4), (3, 9), (7, 1), (9, 1)], 8) == [[0, 2], [3], [7, 9]]


@pytest.mark.parametrize(("spread", "clusters"), [(0.02, 3), (1.0, 1500), (0.2, 40)])
def test_leading_coordinates_lose_no_link(spread, clusters):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(clusters, 40))[rng.integers(0, clusters, 1500)] + spread * rng.normal(size=(1500, 40)) * rng.random((1500, 1))
    m = np.concatenate([m, m[:200] + 0.3 * spread * rng.normal(size=(200, 40))])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    grid = plan_grid([r.tobytes() for r in m[:900]], "<f8", np.sqrt(0.1))
    m = m[sorted(range(len(m)), key=lambda k: grid.keys(m[k : k + 1])[0])]
    linked = (m @ m.T >= 0.95) & ~np.eye(len(m), dtype=bool)
    side = _Side(np.arange(len(m)), np.ones(len(m), np.int64), m, grid.leading(m))
    join_sides(side, side, 0.95)
    assert side.links.tolist() == linked.sum(1).tolist()
    half = len(m) // 2
    a, b = (_Side(np.arange(len(x)), np.ones(len(x), np.int64), x, grid.leading(x)) for x in (m[:half], m[half:]))
    join_sides(a, b, 0.95)
    assert a.links.tolist() == linked[:half, half:].sum(1).tolist() and b.links.tolist() == linked[:half, half:].sum(0).tolist()


def test_grid_join_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (None, [0.0, 1.0], None), (6, None, 1)], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [("4", 2, "4", True), ("4", 2, "4", True), ("6", 0, "6", True), ("None", 0, "None", True), ("None", 2, "4", False)]


def test_keys_of_many_rows_are_joined_like_others(spark):
    rows = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS x")
    keyed = rows.groupBy("k").count().selectExpr("k", "k * 2 AS y", "count AS n")
    for hot in (1, 10, 10**6):
        assert sorted(map(tuple, join_counted(rows, keyed, "k", hot).select("x", "k", "y").collect())) == [(i, 0 if i % 3 == 0 else i, 0 if i % 3 == 0 else 2 * i) for i in range(1000)]
    assert join_counted(rows.limit(0), keyed.limit(0), "k").count() == 0
