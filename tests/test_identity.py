import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.operators import clustering as C
from dwell.operators import matching as M
from dwell.operators import vectors as V
from dwell.operators.graph import connected

SCHEMA = "label string, track_id long, sample_id long, embedding array<float>"


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(24):
        v = np.zeros(4)
        v[k % 3] = 1
        v += rng.normal(0, 0.05, 4)
        rows.append((f"L{k % 3}", k % 3, k, [float(x) for x in v]))
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_centroids_and_knn(spark, samples):
    bank = V.facebank(samples)
    for r in bank.collect():
        own = np.array([x.embedding for x in samples.where(F.col("label") == r.label).collect()]).mean(0)
        assert np.allclose(r.embedding, own / np.linalg.norm(own), atol=1e-6) and r["count"] == 8
    top = M.knn(samples, bank, 1).collect()
    assert all(r.match == r.label and r["rank"] == 1 for r in top) and len(top) == 24


def test_banks_in_parts_and_clusters_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"L{k % 5}" if k % 7 else None, k // 5, k, [float(x) for x in rng.normal(size=6)]) for k in range(90)]
    s = spark.createDataFrame(rows, SCHEMA)
    bank = V.facebank(s.where("label is not null"))
    whole = sorted(map(tuple, M.knn(s, bank, 3).select("sample_id", "rank", "match", "score").collect()))
    monkeypatch.setattr(M, "BANK_NUMBERS", 12)
    assert sorted(map(tuple, M.knn(s, bank, 3).select("sample_id", "rank", "match", "score").collect())) == whole and len(whole) == 270
    assert M.knn(s, bank.limit(0), 3).count() == 0 and M.knn(s.limit(0), bank, 3).count() == 0
    u = np.array([r[3] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    monkeypatch.setattr(V, "_MERGED", 2)
    for r in V.cluster_quality(s, "label", "sample_id", block=4).collect():
        own = u[[k for k, x in enumerate(rows) if x[0] == r.label]]
        sims = (own @ own.T)[np.triu_indices(len(own), 1)]
        assert (r.size, r.pairs) == (len(own), len(sims))
        assert [r.mean_sim, r.min_sim, r.max_sim, r.var_sim] == pytest.approx([sims.mean(), sims.min(), sims.max(), sims.var()])


@pytest.mark.parametrize("block", [7, 1000])
def test_density_clusters_in_blocks(spark, block):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 6))
    v = np.concatenate([centres[k % 4] + 0.25 * rng.normal(size=6) for k in range(60)] + [rng.normal(size=6) for _ in range(20)]).reshape(-1, 6)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 1 - 0.08
    core = near.sum(1) >= 4
    root = np.arange(80)
    for _ in range(80):
        root = np.array([min([root[i], *(root[j] for j in range(80) if near[i, j] and core[j])]) if core[i] else i for i in range(80)])
    for i in np.flatnonzero(~core):
        root[i] = min((root[j] for j in range(80) if near[i, j] and core[j]), default=1000 + i)
    got = {r.sample_id: r.cluster_id for r in C.dbscan(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "sample_id long, embedding array<double>"), "sample_id", 0.08, 4, block).collect()}
    order = {r: n for n, r in enumerate(sorted(set(root.tolist())))}
    assert got == {k: order[r] for k, r in enumerate(root.tolist())}


def test_average_linkage_merges_in_order_of_distance():
    def plain(v, limit):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        d, groups = 1 - u @ u.T, [[k] for k in range(len(v))]
        while len(groups) > 1:
            best = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            if best[0] > limit:
                break
            groups[best[1]] += groups.pop(best[2])
        groups.sort(key=min)
        return [next(g for g, m in enumerate(groups) if k in m) for k in range(len(v))]

    rng = np.random.default_rng(6)
    for n, spread in ((1, 1.0), (2, 1.0), (12, 0.2), (30, 0.5), (40, 1.0)):
        v = rng.normal(size=(4, 5))[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, 5))
        for limit in (0.05, 0.3, 0.8, 2.5):
            assert C.average_linkage(v, limit).tolist() == plain(v, limit)
    assert C.average_linkage(np.zeros((0, 3)), 0.5).tolist() == []


def test_medoid_agrees_with_pairs(samples):
    rows, best = samples.collect(), {}
    u = {r.sample_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in rows}
    for r in rows:
        c = sum(1 - u[r.sample_id] @ u[o.sample_id] for o in rows if o.track_id == r.track_id)
        best[r.track_id] = min(best.get(r.track_id, (math.inf, 0)), (round(c, 9), r.sample_id))
    got = {r.track_id: r.sample_id for r in V.medoids(samples, ["track_id"], "sample_id").collect()}
    assert got == {k: v[1] for k, v in best.items()}
    assert {r.track_id for r in V.representatives(samples, ["track_id"], "sample_id").collect()} == {0, 1, 2}


def test_quality_of_clusters(spark, samples):
    one = spark.createDataFrame([("X", 9, 99, [1.0, 0.0, 0.0, 0.0])], SCHEMA)
    got = {r.label: r for r in V.cluster_quality(samples.unionByName(one), "label", "sample_id").collect()}
    assert got["X"].pairs == 0 and got["X"].mean_sim == 1.0 and got["X"].var_sim == 0.0
    assert got["L0"].pairs == 28 and got["L0"].min_sim > 0.9


def test_purity_and_running_means(spark, samples):
    sims = V.centroid_similarity(samples, ["track_id"]).withColumn("byte_id", F.lit(None).cast("long"))
    got = V.purity(sims, "track_id", "byte_id").collect()
    assert len(got) == 3 and all(r.splits == 3 and r.min_sim <= r.median_sim for r in got)
    run = V.running_centroid(samples.where("track_id = 0"), ["track_id"], "sample_id").orderBy("sample_id").collect()
    own = np.array([r.embedding for r in samples.where("track_id = 0").orderBy("sample_id").collect()])
    assert np.allclose(run[3].centroid, own[:4].mean(0), atol=1e-6)


def test_dbscan(spark, samples):
    noise = spark.createDataFrame([("N", 5, 100, [0.0, 0.0, 0.0, 1.0]), ("N", 5, 101, [-1.0, -1.0, -1.0, 0.2])], SCHEMA)
    got = {r.sample_id: r.cluster_id for r in C.dbscan(samples.unionByName(noise), "sample_id", 0.1, 4).collect()}
    assert [got[k] for k in range(6)] == [0, 1, 2, 0, 1, 2] and {got[100], got[101]} == {3, 4}


def test_linkage_leaders_and_components(spark, samples):
    v = np.array([r.embedding for r in samples.orderBy("sample_id").collect()])
    assert C.average_linkage(v, 0.3).tolist() == [k % 3 for k in range(24)]
    assert C.average_linkage(np.zeros((0, 4)), 0.3).tolist() == []
    assert C.leaders(v, 0.8).tolist() == [k % 3 for k in range(24)]
    both = samples.withColumn("video", F.lit(1))
    assert C.agglomerative(both, ["video"], "sample_id", 0.3).select("cluster_id").distinct().count() == 3
    assert C.leader_clusters(both, ["video"], "sample_id", 0.8, 2).first().identities == 3
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r.root for r in connected(edges).collect()} == {0, 100} == {r.root for r in connected(edges, few=0).collect()}


def test_guard_moves_a_run_of_strangers_to_a_new_identity():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    frames = np.arange(12)
    ids = C.guard(frames, np.array([a] * 4 + [b] * 4 + [b] * 4), min_picks=2, stride=1, consecutive=3, split_below=None)
    assert ids.tolist() == [0] * 4 + [1] * 8
    # one stranger is given back to the same identity once the track recovers
    ids = C.guard(frames, np.array([a] * 4 + [b] + [a] * 7), min_picks=2, stride=1, consecutive=3, recover=2, split_below=None)
    assert set(ids.tolist()) == {0}
    assert C.guard(np.arange(6), np.array([a] * 3 + [b] * 3), min_picks=2, stride=100, split_below=0.5).tolist() == [0, 0, 0, 1, 1, 1]


def test_stitching(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    b = (0.0, 0.0, 10.0, 10.0)
    far = (50.0, 50.0, 60.0, 60.0)
    rows = [("v", 1, 0.0, 10.0, b, b, [1.0, 0.0]), ("v", 2, 12.0, 20.0, b, b, [1.0, 0.1]), ("v", 3, 13.0, 20.0, b, b, [1.0, 0.5]), ("v", 4, 25.0, 30.0, far, far, [1.0, 0.0]), ("v", 5, 22.0, 23.0, b, b, [1.0, 0.0]), ("v", 6, 5000.0, 5001.0, b, b, [1.0, 0.0])]
    t = spark.createDataFrame(rows, f"video string, track_id long, start_ms double, end_ms double, start_box {box}, end_box {box}, embedding array<double>")
    edges = C.stitch_edges(t, ["video"], 100.0, 0.1, 0.45)
    assert {(r.a, r.b) for r in edges.collect()} == {(1, 2), (1, 3), (1, 5), (2, 5), (3, 5)}
    got = {r.track_id: (r.chain_id, r.position) for r in C.stitch_chains(t, edges, ["video"]).collect()}
    assert got == {1: (1, 0), 5: (1, 1), 2: (2, 0), 3: (3, 0), 4: (4, 0), 6: (5, 0)}


ODD = [("L0", 0, 900, None), ("L0", 0, 901, [float("nan")] * 4), ("L1", 1, 902, [1.0]), ("L1", 1, 903, []), ("L2", 7, 904, None), ("L2", 2, 905, [1.0, float("inf"), 0.0, 0.0]), ("L2", 2, 906, [1.0, None, 0.0, 0.0])]


@pytest.fixture(scope="module")
def odd(spark, samples):
    """Whole vectors, and beside them null, empty, short and non-finite ones; track 7 has no other."""
    return spark.createDataFrame([tuple(r) for r in samples.collect()] + ODD, SCHEMA).cache()


def table_of(df, *key):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_unusable_vectors_match_nothing(spark, samples, odd):
    bank = V.facebank(odd)
    assert table_of(bank) == table_of(V.facebank(samples))
    more = spark.createDataFrame([("none", 1, None), ("short", 1, [1.0]), (None, 1, [1.0, 0.0, 0.0, 0.0])], "label string, count long, embedding array<double>")
    for b in (bank, bank.unionByName(more)):
        ranked = M.knn(odd, b, 2)
        own = {s: [(r.rank, r.match, r.score) for r in ranked.where(F.col("sample_id") == s).collect()] for s in (900, 901, 902, 903, 905, 906)}
        assert all(v == [(1, None, None)] for v in own.values())
        assert table_of(ranked.where("sample_id < 900")) == table_of(M.knn(samples, bank, 2))
        got = {r.sample_id: (r.match, r.score) for r in M.best_match(ranked, ["sample_id"], 0.8, 0.05).collect()}
        assert len(got) == 31 and all(got[s] == (None, None) for _, _, s, _ in ODD) and all(got[k][0] == f"L{k % 3}" for k in range(24))
    scores = spark.createDataFrame([(1, 1, "A", float("nan")), (1, 2, "B", 0.1), (2, 1, "A", 0.9), (2, 2, "B", float("nan"))], "s long, rank int, match string, score double")
    assert {r.s: r.match for r in M.best_match(scores, ["s"], 0.8, 0.05).collect()} == {1: None, 2: "A"}


def test_unusable_vectors_are_no_centres(spark, samples, odd):
    for f in (V.medoids, V.representatives):
        assert table_of(f(odd, ["track_id"], "sample_id")) == table_of(f(samples, ["track_id"], "sample_id"))
    sims = {r.sample_id: r.similarity for r in V.centroid_similarity(odd, ["track_id"]).collect()}
    assert len(sims) == 31 and all(sims[s] is None for _, _, s, _ in ODD)
    assert {k: v for k, v in sims.items() if k < 900} == {r.sample_id: r.similarity for r in V.centroid_similarity(samples, ["track_id"]).collect()}
    run = {r.sample_id: r.centroid for r in V.running_centroid(odd, ["track_id"], "sample_id").collect()}
    assert run[904] is None and run[900] == run[901] == run[21] and run[905] == run[23]
    quality, whole = ({r.label: r for r in V.cluster_quality(x, "label", "sample_id").collect()} for x in (odd.withColumn("label", F.when(F.col("track_id") == 7, "Z").otherwise(F.col("label"))), samples))
    assert quality["Z"][1:] == (1, 0, None, None, None, None) or (quality["Z"].size, quality["Z"].pairs, quality["Z"].mean_sim, quality["Z"].var_sim) == (1, 0, None, None)
    for k in whole:
        assert quality[k].size == 10 and [quality[k][c] for c in ("pairs", "mean_sim", "min_sim", "max_sim")] == pytest.approx([whole[k][c] for c in ("pairs", "mean_sim", "min_sim", "max_sim")])


def test_unusable_vectors_are_in_no_cluster(spark, samples, odd):
    bad = {s for _, _, s, _ in ODD}
    for of in (lambda d: C.dbscan(d, "sample_id", 0.1, 4), lambda d: C.agglomerative(d.withColumn("video", F.lit(None).cast("string")), ["video"], "sample_id", 0.3)):
        got = {r.sample_id: r.cluster_id for r in of(odd).collect()}
        assert {s for s, c in got.items() if c is None} == bad
        assert {s: c for s, c in got.items() if s not in bad} == {r.sample_id: r.cluster_id for r in of(samples).collect()}
    lead = {r.track_id: (r.leaders, r.identities) for r in C.leader_clusters(odd, ["track_id"], "sample_id", 0.8, 2).collect()}
    assert lead == {r.track_id: (r.leaders, r.identities) for r in C.leader_clusters(samples, ["track_id"], "sample_id", 0.8, 2).collect()} | {7: (0, 0)}
    frames = lambda d: d.select("track_id", F.col("sample_id").alias("frame_idx"), "embedding")
    ids = {r.frame_idx: r.identity for r in C.identity_guard(frames(odd), ["track_id"], min_picks=2, stride=1).collect()}
    assert {s for s, c in ids.items() if c is None} == bad
    assert {s: c for s, c in ids.items() if s not in bad} == {r.frame_idx: r.identity for r in C.identity_guard(frames(samples), ["track_id"], min_picks=2, stride=1).collect()}


def test_ids_beside_nulls_stay_whole(spark):
    """Numbers above 2^53 beside a null key."""
    big = 9007199254740993
    rows = [(None, big, [1.0, 0.0]), (None, big + 2, [1.0, 0.1]), (big, big + 4, [0.0, 1.0]), (big, None, [0.0, 1.0])]
    d = spark.createDataFrame(rows, "video long, sample_id long, embedding array<double>")
    got = table_of(C.agglomerative(d, ["video"], "sample_id", 0.3))
    assert got == sorted([(None, big, 0), (None, big + 2, 0), (big, big + 4, 0), (big, None, 0)], key=repr)
    boxes = spark.createDataFrame([(None, 1, big, 0.0, 0.0, 1.0, 1.0), (None, 2, None, 0.0, 0.0, 1.0, 1.0), (None, None, 5, 0.0, 0.0, 1.0, 1.0), (None, 3, 6, None, 0.0, 1.0, 1.0)], "video long, frame_idx long, det_idx long, x1 double, y1 double, x2 double, y2 double")
    assert table_of(M.iou_tracks(boxes, ["video"])) == sorted([(None, 1, big, 1), (None, 2, None, 1), (None, None, 5, None), (None, 3, 6, None)], key=repr)


@pytest.mark.parametrize("block", [5, 1000])
def test_linkage_by_components_is_that_of_whole_groups(spark, block):
    rng = np.random.default_rng(12)
    rows = []
    for video in range(3):
        centres = rng.normal(size=(6, 5))
        rows += [(video, 100 * video + k, (centres[k % 6] + 0.3 * rng.normal(size=5)).tolist()) for k in range(40)]
    d = spark.createDataFrame(rows, "video long, sample_id long, embedding array<double>")
    for distance in (0.05, 0.3):
        got = {(r.video, r.sample_id): r.cluster_id for r in C.agglomerative(d, ["video"], "sample_id", distance, block).collect()}
        for video in range(3):
            own = [r for r in rows if r[0] == video]
            assert [got[r[:2]] for r in own] == C.average_linkage(np.array([r[2] for r in own]), distance).tolist()


def test_distant_blocks_are_not_compared(spark):
    """Of tight groups far apart only the blocks of one group are compared."""
    rng = np.random.default_rng(13)
    v = np.repeat(np.eye(8), 50, axis=0) + 0.001 * rng.normal(size=(400, 8))
    rows = spark.createDataFrame([(k, (x / np.linalg.norm(x)).tolist()) for k, x in enumerate(v)], "id long, u array<double>")
    placed, blocks = C.in_blocks(rows, [], 50)
    n = blocks.count()
    assert placed.count() == 400 and n >= 8 and blocks.agg(F.max("n")).first()[0] <= 50
    pairs_ = C.block_pairs(blocks, [])
    assert pairs_.count() == n * (n + 1) // 2 and pairs_.where("near <= 0.1").count() < n * (n + 1) // 4
    # no bound is passed by the vectors themselves
    of = {b: np.array([r.u for r in placed.where(F.col("b") == b).collect()]) for b in [r.b for r in blocks.collect()]}
    for r in pairs_.collect():
        dots, d = of[r.lo] @ of[r.hi].T, np.linalg.norm(of[r.lo][:, None] - of[r.hi][None], axis=2)
        assert r.low <= dots.min() and dots.max() <= r.high and r.near <= d.min() and d.max() <= r.far
    pairs = lambda t: {(r.a, r.b) for r in C.near_links(t, [], 0.99, 50).collect()}
    assert connected(spark.createDataFrame(list(pairs(rows)), "a long, b long")).select("root").distinct().count() == 8


def plain_chains(tracks, edges):
    order = sorted(tracks, key=lambda t: (t[1], t[0]))
    at = {t: k for k, (t, _) in enumerate(order)}
    after = {}
    for a, b, sim in edges:
        after.setdefault(a, []).append((-sim, at[b], b))
    chain, number = {}, 0
    for t, _ in order:
        if t in chain:
            continue
        number, place, now = number + 1, 0, t
        while now is not None:
            chain[now] = (number, place)
            place += 1
            now = next((b for _, _, b in sorted(after.get(now, ())) if b not in chain), None)
    return chain


def test_chains_by_components_are_those_of_whole_videos(spark):
    rng = np.random.default_rng(14)
    tracks, edges, want = [], [], {}
    for video in ("v", None):
        own = [(int(t), float(rng.integers(0, 40))) for t in rng.permutation(60)]
        start = dict(own)
        links = {(int(a), int(b)): round(float(rng.random()), 1) for a, b in rng.integers(0, 60, (70, 2)) if start[int(a)] < start[int(b)]}
        tracks += [(video, t, s) for t, s in own]
        edges += [(video, a, b, s) for (a, b), s in links.items()]
        want |= {(video, t): c for t, c in plain_chains(own, [(a, b, s) for (a, b), s in links.items()]).items()}
    got = C.stitch_chains(spark.createDataFrame(tracks, "video string, track_id long, start_ms double"), spark.createDataFrame(edges, "video string, a long, b long, sim double"), ["video"])
    assert {(r.video, r.track_id): (r.chain_id, r.position) for r in got.collect()} == want
    alone = C.stitch_chains(spark.createDataFrame(tracks, "video string, track_id long, start_ms double"), spark.createDataFrame([], "video string, a long, b long, sim double"), ["video"])
    assert alone.groupBy("video").agg(F.max("chain_id").alias("n")).select("n").distinct().collect()[0].n == 60


def test_edges_of_a_large_video_are_those_of_a_small_one(spark):
    """Whatever the blocks, and without the vectors being sent for each pair; a null, a short and a NaN vector meet nothing."""
    rng = np.random.default_rng(3)
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    rows = []
    for k in range(120):
        a, e, b = float(rng.integers(0, 400)), float(rng.integers(0, 40)), [float(x) for x in rng.integers(0, 40, 4)]
        v = [None, [1.0], [float("nan")] * 4][k] if k < 3 else rng.normal(size=4).tolist()
        rows.append(("x" if k % 3 else "y", k, a, a + e, (b[0], b[1], b[0] + 50, b[1] + 50), (b[2], b[3], b[2] + 50, b[3] + 50), v))
    t = spark.createDataFrame(rows, f"video string, track_id long, start_ms double, end_ms double, start_box {box}, end_box {box}, embedding array<double>")
    want = set()
    for p in rows:
        for q in rows:
            if p[0] == q[0] and p[1] != q[1] and 0 <= q[2] - p[3] <= 100 and len(p[6] or ()) == len(q[6] or ()) == 4:
                (a, b, c, d), (w, x, y, z) = p[5], q[4]
                inter = max(0.0, min(c, y) - max(a, w)) * max(0.0, min(d, z) - max(b, x))
                near = np.dot(p[6], q[6]) / np.linalg.norm(p[6]) / np.linalg.norm(q[6])
                if inter / (5000 - inter) >= 0.3 and 1 - near <= 0.7:
                    want.add((p[1], q[1]))
    for block in (2048, 10):
        edges = C.stitch_edges(t, ["video"], 100.0, 0.3, 0.7, block)
        assert "FlatMapGroupsInArrow" in edges._jdf.queryExecution().executedPlan().toString()
        got = [(r.a, r.b) for r in edges.collect()]
        assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


def test_videos_are_stitched_in_one_task_as_by_their_edges(spark, monkeypatch):
    """Null videos, vectors, starts and boxes, narrow vectors, equal starts and a name given twice; edges are made of large videos only."""
    rng = np.random.default_rng(4)
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    rows = []
    for k in range(240):
        a, e, b = float(rng.integers(0, 60)) * 5, float(rng.integers(0, 40)), [float(x) for x in rng.integers(0, 30, 4)]
        v = rng.choice([-0.5, 0.5, 1.0], 3).tolist() if k % 11 else [None, [1.0], [], [float("nan")] * 3, [0.5, None, 1.0]][k % 5]
        ends = (b[0], b[1], b[0] + 50, b[1] + 50), (b[2], b[3], b[2] + 50, b[3] + 50) if k % 31 else None
        rows.append(("xyz"[k % 3] if k % 8 else None, k - (k % 40 == 39) * 3, a if k % 37 else None, a + e if k % 41 else None, *ends, v))
    t = spark.createDataFrame(rows, f"video string, track_id long, start_ms double, end_ms double, start_box {box}, end_box {box}, embedding array<float>").coalesce(1)
    edges = C.stitch_edges(t, ["video"], 100.0, 0.3, 0.7)
    told = lambda d: sorted((r.video or "", r.track_id, r.chain_id, r.position) for r in d.collect())
    want = told(C.stitch_chains(t, edges, ["video"]))
    assert max(p for *_, p in want) > 3 and told(C.stitched(t, ["video"], 100.0, 0.3, 0.7, 50)) == want  # the null video is small
    assert told(C.stitched(t, ["video"], 100.0, 0.3, 0.7, 29)) == want  # all are large, the null one too
    monkeypatch.delattr(C, "stitch_edges")
    assert told(C.stitched(t, ["video"], 100.0, 0.3, 0.7)) == want


def test_vectors_go_to_pairs_of_tiles_not_of_blocks(spark):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, u array<double>")
    placed, blocks = C.in_blocks(rows, [], 4)
    assert blocks.count() >= 100
    pairs_ = C.block_pairs(blocks, []).select("lo", "hi").localCheckpoint()
    one = lambda first, second, own: pa.table({"rows": [len(first) * (len(first) - 1) // 2 if own else len(first) * len(second)]})
    tasks = C.in_pairs(placed, pairs_, [], one, "rows long", lambda t: pa.table({"rows": [sum(t["rows"].to_pylist())]})).collect()
    most = C.TILES + 1
    assert len(tasks) <= most * (most + 1) // 2 and sum(r.rows for r in tasks) == 400 * 399 // 2
    near = {r.id: r.n for r in C.neighbours(rows, 0.9, 4).collect()}
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert near == {i: n for i, n in enumerate(want.tolist()) if n}
