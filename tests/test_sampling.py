from dwell.operators import sampling as P

SCHEMA = "track_id long, frame_idx long, quality double, sharpness double, frontalness double, area_frac double, tie long"


def cand(spark, rows):
    return spark.createDataFrame([(1, f, q, s, fr, 0.1, i) for i, (f, q, s, fr) in enumerate(rows)], SCHEMA)


def choose(rows, **rules):
    return P.choose(*(list(c) for c in zip(*rows, strict=True)), P.Rules(**rules)) if rows else P.choose([], [], [], [], P.Rules(**rules))


def test_spacing(spark):
    rows = [(0, 0.95, 100.0, 0.9), (2, 0.94, 100.0, 0.9), (10, 0.92, 100.0, 0.9), (20, 0.80, 100.0, 0.9), (30, 0.60, 100.0, 0.9)]
    assert sorted(r.frame_idx for r in P.spaced(cand(spark, rows), ["track_id"], 3, 5, ["tie"]).collect()) == [0, 10, 20]
    picked, _ = choose(rows, samples_per_track=3, samples_min=3, min_gap=5)
    assert [r[0] for r, p in zip(rows, picked, strict=True) if p] == [0, 10, 20]


def test_reasons():
    assert choose([(0, 0.5, 100.0, 0.2)], min_frontalness=0.6) == ([False], ["rejected_frontalness"])
    assert choose([(0, 0.9, 200.0, 0.9), (50, 0.8, 50.0, 0.9)], min_sharpness=100.0)[1] == ["picked", "rejected_sharpness"]
    # blurred ones pass until one may be picked; who is picked is called so, who isn't keeps the reason of the floor
    assert choose([(0, 0.9, 50.0, 0.9), (50, 0.8, 200.0, 0.9)], min_sharpness=100.0) == ([True, True], ["picked", "picked"])
    assert choose([(0, 0.9, 50.0, 0.1), (9, 0.8, 50.0, 0.9), (10, 0.7, 200.0, 0.9)], min_sharpness=100.0, min_frontalness=0.5, profile_quota=1, samples_min=1, samples_per_track=0)[1] == ["profile_pool", "picked_sharpness_floor", "not_selected"]
    assert choose([]) == ([], [])


def test_profile_quota_lets_a_profile_in():
    rows = [(0, 0.9, 100.0, 0.8), (50, 0.8, 100.0, 0.2), (90, 0.7, 100.0, 0.2)]
    assert choose(rows, min_frontalness=0.5, profile_quota=1, profile_floor=0.1, samples_min=1) == ([True, True, False], ["picked", "picked_profile", "profile_pool"])


def test_frontal_quota():
    rows = [(0, 0.95, 100.0, 0.3), (20, 0.94, 100.0, 0.2), (40, 0.93, 100.0, 0.15), (60, 0.5, 100.0, 0.9), (80, 0.4, 100.0, 0.8)]
    picked, reason = choose(rows, samples_per_track=4, samples_min=4, min_gap=5, min_frontal=2, frontal_pct=60.0)
    assert picked == [False, True, True, True, True]  # the best of the others made room
    assert reason == ["picked"] * 5


def test_pool_and_gates(spark):
    c = cand(spark, [(f, 1.0 - f / 10, 10.0 * f, 0.5) for f in range(6)])
    ranked = P.candidate_pool(c, ["track_id"], 4, ["tie"]).collect()
    assert sorted((r.frame_idx, r.reason) for r in ranked if r.reason) == [(4, "rejected_quality"), (5, "rejected_quality")]
    assert P.percentile_gate(c, ["track_id"], "sharpness", 50.0).count() == 3
    assert P.percentile_gate(c, ["track_id"], "sharpness", 50.0, 45.0).count() == 1
    counts = {r.reason: r.n for r in P.reject_counts(P.gate_reasons(c, 0.003, 20.0, 0.1)).collect()}
    assert counts == {"rejected_sharpness": 2}
    assert P.debug_rows(c, ["track_id"], 2, ["tie"]).count() == 2


def test_selection_in_groups(spark):
    c = cand(spark, [(0, 0.95, 100.0, 0.9), (2, 0.94, 100.0, 0.9), (10, 0.92, 100.0, 0.9)])
    got = P.select_samples(c, ["track_id"], 10, ["tie"], samples_per_track=2, samples_min=2, min_gap=5).where("picked").collect()
    assert sorted(r.frame_idx for r in got) == [0, 10]


def test_distinct_top(spark):
    c = spark.createDataFrame([("A", 0.9, [0.0, 0.0], 1), ("A", 0.8, [0.1, 0.1], 2), ("A", 0.7, [9.0, 9.0], 3)], "label string, quality double, v array<double>, tie long")
    assert [r.tie for r in P.top_distinct(c, ["label"], "v", 5, 1.0, ["tie"]).orderBy("rank").collect()] == [1, 3]


def test_distinct_top_walks_all_candidates(spark, sf):
    # copies fill the first places of a hot track; what is distinct comes after them, over several batches
    rows = [("A", 0.9, [0.0, 0.0], k) for k in range(25_000)] + [("A", 0.5 - k / 100, [10.0 * (k + 1), 0.0], k) for k in range(3)] + [("B", 0.1, [0.0, 0.0], 0), (None, 0.1, None, 0)]
    c = spark.createDataFrame(rows, "label string, quality double, v array<double>, tie long")
    got = P.top_distinct(c, ["label"], "v", 3, 1.0, ["tie"]).collect()
    assert sorted((r.label or "", r.rank, r.tie, r.quality) for r in got) == [("", 1, 0, 0.1), ("A", 1, 0, 0.9), ("A", 2, 0, 0.5), ("A", 3, 1, 0.49), ("B", 1, 0, 0.1)]

    from dwell.plans import fixtures, sampling

    tracks = {}
    for r in sorted(fixtures.candidates(spark, sf).collect(), key=lambda r: (-r.quality, r.frame_idx, *(r[t] for t in fixtures.TIES))):
        v, kept = (r.sharpness, r.frontalness * 10, r.area_frac * 1000), tracks.setdefault(r.track_id, [])
        if len(kept) < 10 and all(sum(abs(x - y) for x, y in zip(v, w, strict=True)) / 3 >= 5.0 for w, _ in kept):
            kept.append((v, (r.frame_idx, r.l_linenumber, r.l_partkey)))
    want = {(t, k, *of) for t, kept in tracks.items() for k, (_, of) in enumerate(kept, 1)}
    assert {(r.track_id, r.rank, r.frame_idx, r.l_linenumber, r.l_partkey) for r in sampling.seed_topn_dedup(spark, sf).collect()} == want


def test_montage_takes_rejected_or_all_others(spark):
    rows = [(1, True, "picked", 0.5, 1), (1, False, "rejected_area", 0.4, 2), (1, False, "not_selected", 0.9, 3), (2, False, "not_selected", 0.1, 4), (2, None, None, 0.2, 5), (2, False, "profile_pool", None, 6)]
    s = spark.createDataFrame(rows, "track_id long, picked boolean, reason string, quality double, tie int")
    got = sorted((r.track_id, r.row, r.tile, r.tie) for r in P.montage_rows(s, ["track_id"], 2, ["tie"]).collect())
    assert got == [(1, "picked", 1, 1), (1, "rejected", 1, 2), (2, "rejected", 1, 5), (2, "rejected", 2, 4)]
