from pyspark.sql import functions as F

from dwell.operators import segments as S

K = ["track_id"]


def labels(spark, runs):
    rows = [(1, f, x, 0.9) for lo, hi, x in runs for f in range(lo, hi + 1)]
    return spark.createDataFrame(rows, "track_id long, frame_idx long, label string, score double")


def test_a_gap_within_the_cap_is_bridged(spark):
    got = S.label_runs(labels(spark, [(0, 29, "A"), (35, 59, "A")]), K, 30.0, 500.0, 200.0).collect()
    assert [(r.frames, r.subtrack_id, r.label) for r in got] == [(60, 0, "A")]
    assert abs(got[0].duration_ms - 2000) < 1e-6


def test_a_gap_cap_of_zero_is_no_cap_and_short_runs_are_not_numbered(spark):
    got = S.label_runs(labels(spark, [(0, 9, "A"), (100, 109, "A"), (110, 110, "B"), (111, 130, "A")]), K, 30.0, 0.0, 200.0).orderBy("subtrack_id").collect()
    assert [(r.frames, r.subtrack_id) for r in got] == [(110, 0), (20, 1)]


def test_subtracks_keep_their_order_and_totals_add_up(spark):
    subs = spark.createDataFrame([(1, 0, 0, 29, "A", 0.9), (1, 1, 30, 59, "B", None), (1, 2, 60, 60, "C", 0.1)], "track_id long, subtrack_id int, start_frame int, end_frame int, label string, avg_similarity double")
    seg = S.subtrack_segments(subs, K, 30.0, 100.0)
    got = seg.orderBy("subtrack_id").collect()
    assert [(r.subtrack_id, r.frames, round(r.duration_ms), r.avg_similarity) for r in got] == [(0, 30, 1000, 0.9), (1, 30, 1000, 0.0)]
    assert sum(r.total_ms for r in S.totals(seg).collect()) == sum(r.duration_ms for r in got)


def test_no_frame_rate_gives_no_duration(spark):
    assert S.label_runs(labels(spark, [(0, 9, "A")]), K, 0.0, 0.0, 0.0).first().duration_ms == 0.0


def test_fragments_split_where_a_processed_frame_is_missing(spark):
    obs = spark.createDataFrame([(1, f) for f in (0, 2, 4, 8, 10)], "track_id long, frame_idx long")
    assert [r.fragment_id for r in S.fragments(obs, K, 2).orderBy("frame_idx").collect()] == [0, 0, 0, 1, 1]
    frames = spark.createDataFrame([("v", f) for f in (0, 2, 4, 8, 10)], "video string, frame_idx long")
    got = S.fragments(obs.withColumn("video", F.lit("v")), ["video", "track_id"], frames=frames, video=["video"])
    assert {r.fragment_id for r in got.collect()} == {0}


def test_unknown_and_empty_labels_are_none(spark):
    rows = [(1, 0, "A", 0.5, 1), (1, 0, "UNKNOWN", 0.9, 2), (1, 1, "", 0.9, 3), (1, 0, "B", 0.7, 0)]
    ev = spark.createDataFrame(rows, "track_id long, frame_idx long, label string, score double, tie long")
    assert [(r.frame_idx, r.label) for r in S.last_per_frame(ev, K, "tie").collect()] == [(0, "A")]


def _segments(spark, rows):
    return spark.createDataFrame([(1, i, x, s, e, e - s, 1, 0.5) for i, x, s, e in rows], "track_id long, subtrack_id int, label string, start_ms double, end_ms double, duration_ms double, frames long, avg_similarity double")


def test_missing_labels_and_fallback_merge(spark):
    base = _segments(spark, [(0, "KYLE", 0.0, 1000.0)])
    known = spark.createDataFrame([("LVP",), ("KYLE",), ("EILEEN",)], "label string")
    seen = spark.createDataFrame([("LVP",), ("KYLE",), ("UNKNOWN",), ("OTHER",)], "label string")
    missing = S.missing_labels(seen, known, base)
    assert [r.label for r in missing.collect()] == ["LVP"]
    fallback = _segments(spark, [(0, "LVP", 5.0, 10.0), (1, "LVP", 5.0, 10.0), (2, "KYLE", 2000.0, 3000.0)])
    got = S.merge_with_fallback(base, fallback, missing, K).orderBy("subtrack_id").collect()
    assert [(r.label, r.subtrack_id) for r in got] == [("KYLE", 0), ("LVP", 1)]


def test_timelines(spark):
    seg = _segments(spark, [(0, "A", 500.0, 2100.0), (1, "B", 9000.0, 99000.0), (2, "A", 4000.0, 4000.0)])
    wide = S.timeline_wide(seg, 10, ["A", "B"]).orderBy("second").collect()
    assert [r.A for r in wide] == [1, 1, 1] + [0] * 7 and [r.B for r in wide] == [0] * 9 + [1]
    assert {(r.second, r.label) for r in S.timeline_long(seg, K, 10).collect()} == {(0, "A"), (1, "A"), (2, "A"), (9, "B")}


def test_equal_rounded_segments_are_one(spark):
    seg = _segments(spark, [(0, "A", 0.5, 10.2), (0, "A", 0.4, 9.9), (0, "B", 0.4, 9.9)])
    assert sorted((r.label, r.start_ms) for r in S.dedup_segments(seg, K).collect()) == [("A", 0.4), ("B", 0.4)]


def test_probes_round_half_to_even(spark):
    scenes = spark.createDataFrame([(1, 0, 5), (2, 3, 3)], "scene_idx long, start_frame long, end_frame long")
    got = {(r.scene_idx, r.frame_idx) for r in S.scene_probes(scenes, 1).collect()}
    assert got == {(1, 2), (2, 3)}


def test_reconcile_and_empty_tables(spark):
    seg = _segments(spark, [(0, "A", 0.0, 100.0)])
    claimed = spark.createDataFrame([("A", 100.5), ("B", 7.0)], "label string, total_ms double")
    assert [(r.label, r.diff_ms) for r in S.reconcile(seg, claimed).collect()] == [("B", -7.0)]
    none = labels(spark, [])
    assert S.label_runs(none, K, 30.0, 0.0, 0.0).count() == 0 and S.unsegmented(none, seg, K).count() == 0


def test_chunks_make_the_same_runs(spark):
    df = labels(spark, [(0, 29, "A"), (31, 40, "B"), (60, 75, "B"), (76, 90, "A")])
    whole = sorted(map(tuple, S.islands(df, K, 10).select("first_frame", "last_frame", "label", "n").collect()))
    for size in (1, 7, 30):
        assert sorted(map(tuple, S.islands(df, K, 10, chunk_frames=size).select("first_frame", "last_frame", "label", "n").collect())) == whole
    assert whole == [(0, 29, "A", 30), (31, 40, "B", 10), (60, 75, "B", 16), (76, 90, "A", 15)]


def test_fallback_covers_labels_without_segments(spark):
    rows = [(1, f, "A", 0.5) for f in range(10)] + [(2, f, "B", 0.5) for f in (0, 1)] + [(3, 0, "C", 0.5)]
    labels = spark.createDataFrame(rows, "track_id long, frame_idx long, label string, score double")
    known = spark.createDataFrame([("A",), ("B",), ("Z",)], "label string")
    got = lambda least: sorted((r.track_id, r.subtrack_id, r.label, r.frames) for r in S.covered_segments(None, labels, known, ["track_id"], 1.0, 1000.0, 5000.0, least).collect())
    assert got(0.0) == got(-5.0) == [(1, 0, "A", 10), (2, 0, "B", 2)]  # C isn't known, Z wasn't seen
    assert got(3000.0) == [(1, 0, "A", 10)] == got(9000.0)  # capped at the run's own length
    subs = spark.createDataFrame([(2, 0, 0, 1, "B", None)], "track_id long, subtrack_id int, start_frame long, end_frame long, label string, avg_similarity double")
    found = S.covered_segments(subs, labels, known, ["track_id"], 1.0, 1000.0, 5000.0).collect()
    assert sorted((r.track_id, r.label, r.frames) for r in found) == [(1, "A", 10), (2, "B", 2)]


def test_track_lengths(spark):
    t = spark.createDataFrame([("v", 2), ("v", 4), ("v", 9), ("v", 0), ("w", None)], "video string, duration_frames long")
    assert [tuple(r) for r in S.track_lengths(t, ["video"]).collect()] == [("v", 3, 5.0, 4.0)]
