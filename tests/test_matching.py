import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.functions import geometry as G
from dwell.operators import matching as M
from dwell.operators.segments import fragments

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
FR = ["frame_idx"]


def faces(spark, rows):
    return spark.createDataFrame([(f, i, b, s) for f, i, b, s in rows], f"frame_idx long, face_idx long, face_box {BOX}, score double")


def tracks(spark, rows):
    return spark.createDataFrame(rows, f"frame_idx long, track_idx long, track_id long, track_box {BOX}")


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_boxes(spark):
    a, b = G.box(0, 0, 10, 10), G.box(5, 5, 15, 15)
    assert value(spark, G.iou(a, b)) == pytest.approx(25 / 175)
    assert value(spark, G.iou(a, G.box(20, 20, 30, 30))) == 0.0 and value(spark, G.area(G.box(5, 5, 0, 9))) == 0.0
    assert tuple(value(spark, G.dilate(G.box(10, 10, 20, 20), 0.5, 22.0, 100.0))) == (5.0, 5.0, 22.0, 25.0)
    assert tuple(value(spark, G.dilate(G.box(-5, 0, 999, 1), 0.0, 10.0, 10.0))) == (-5.0, 0.0, 999.0, 1.0)
    assert value(spark, G.center_in(a, G.box(5, 5, 9, 9))) and not value(spark, G.center_in(a, G.box(6, 6, 9, 9)))
    assert not value(spark, G.passes_area(G.box(0, 0, 5, 5), 10000.0, 0.0, 0.0, 0.003))
    assert not value(spark, G.passes_area(G.box(0, 0, 5, 5), 0.0, 0.0, 0.0, 0.0))


def test_quality_grows_with_sharpness(spark):
    q = [value(spark, G.quality(F.lit(s), F.lit(0.5), F.lit(0.03), 20.0, 0.03, (0.5, 0.3, 0.2))) for s in (10.0, 40.0, 80.0)]
    assert q == sorted(q) and q[0] == pytest.approx(0.35) and q[2] == pytest.approx(0.85)


def test_orientation(spark):
    def points(nose):
        return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in (0, 10, nose, 2, 8)))

    assert tuple(value(spark, G.orientation(points(5)))) == ("frontal", 1.0)
    assert value(spark, G.orientation(points(9))).orientation == "profile"
    assert tuple(value(spark, G.orientation(F.array().cast("array<struct<x:float,y:float>>")))) == ("unknown", 0.4)
    assert value(spark, G.frontalness(points(5))) == 1.0 and value(spark, G.frontalness(F.array().cast("array<struct<x:float,y:float>>"))) is None


def test_orientation_keeps_faces_on_the_threshold(spark, sf):
    from dwell.plans import boxes, fixtures

    assert boxes.orientation(spark, sf).count() == fixtures.faces(spark, sf).count()
    # skew is (2 * nose - 10) / 10
    near = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in (0, 10, 7.5 + 1e-12, 2, 8)))
    assert value(spark, G.orientation(near)).orientation == "frontal"


def test_greedy_match_takes_the_best_then_the_first(spark):
    f = faces(spark, [(0, 1, (90.0, 90.0, 120.0, 120.0), 0.9)])
    t = tracks(spark, [(0, 1, 1, (0.0, 0.0, 80.0, 80.0)), (0, 2, 2, (40.0, 40.0, 160.0, 160.0)), (0, 3, 3, (40.0, 40.0, 160.0, 160.0)), (1, 4, 9, (90.0, 90.0, 120.0, 120.0))])
    got = M.greedy_faces(M.pairs(f, t, FR, 0.0, 1000.0, 1000.0, 0.03), FR).collect()
    assert [(r.face_idx, r.track_id) for r in got] == [(1, 2)] and got[0].iou > 0.03


def test_temporal_match_reaches_back(spark):
    f = faces(spark, [(5, 1, (0.0, 0.0, 10.0, 10.0), 0.9), (9, 1, (0.0, 0.0, 10.0, 10.0), 0.9)])
    b, away = (0.0, 0.0, 10.0, 10.0), (50.0, 50.0, 60.0, 60.0)
    t = tracks(spark, [(3, 1, 7, b), (4, 1, 7, away), (5, 1, 7, away), (7, 1, 7, b), (9, 1, 7, away), (5, 2, 8, away)])
    live = fragments(t, ["track_id"])
    got = M.temporal_faces(f, live, "frame_idx", ["track_id", "fragment_id"], 3, 0.0, 100.0, 100.0, 0.1).collect()
    # at 9 the track is back after a frame without it: its box of frame 7 is of another fragment
    assert [(r.frame_idx, r.track_id, r.seen_frame) for r in got] == [(5, 7, 3)]
    # a track that isn't in the frame takes no face there
    gone = fragments(t.where("frame_idx < 5"), ["track_id"])
    assert M.temporal_faces(f, gone, "frame_idx", ["track_id", "fragment_id"], 3, 0.0, 100.0, 100.0, 0.1).count() == 0


def test_assignment_is_optimal():
    rng = np.random.default_rng(5)
    for n, m in [(1, 1), (2, 4), (4, 4), (3, 5), (5, 6)]:
        cost = rng.random((n, m))
        col = M.assignment(cost)
        assert len(set(col)) == n
        assert cost[np.arange(n), col].sum() == pytest.approx(min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n)))


def test_optimal_is_no_worse_than_greedy_and_one_to_one(spark):
    rows = [(0, 1, 1, 11, 0.9), (0, 2, 1, 11, 0.8), (0, 1, 2, 12, 0.7), (0, 2, 2, 12, 0.1), (1, 1, 1, 11, 0.3)]
    m = spark.createDataFrame(rows, "frame_idx long, face_idx long, track_idx long, track_id long, iou double")
    got = {(r.frame_idx, r.face_idx): r.track_id for r in M.optimal_faces(m, FR).collect()}
    assert got == {(0, 1): 12, (0, 2): 11, (1, 1): 11}


def test_center_fallback_needs_exactly_one_free_face(spark):
    two = faces(spark, [(0, 1, (1.0, 1.0, 2.0, 2.0), 1.0), (0, 2, (3.0, 3.0, 4.0, 4.0), 1.0), (1, 1, (1.0, 1.0, 2.0, 2.0), 1.0)])
    t = tracks(spark, [(0, 1, 5, (0.0, 0.0, 10.0, 10.0)), (1, 1, 6, (0.0, 0.0, 10.0, 10.0)), (1, 2, 7, (0.0, 0.0, 10.0, 10.0))])
    assert [(r.frame_idx, r.track_id, r.face_idx) for r in M.center_fallback(two, t, FR).collect()] == [(1, 6, 1)]
    # an earlier track's claim leaves a later one with a single face
    t2 = tracks(spark, [(0, 1, 5, (0.0, 0.0, 2.5, 2.5)), (0, 2, 6, (0.0, 0.0, 10.0, 10.0))])
    assert sorted((r.track_id, r.face_idx) for r in M.center_fallback(two.where("frame_idx = 0"), t2, FR).collect()) == [(5, 1), (6, 2)]


def test_recall_gives_the_first_face_of_a_track_and_rejects_others(spark):
    b = (0.0, 0.0, 10.0, 10.0)
    f = faces(spark, [(0, 1, b, 0.1), (0, 2, b, 0.5), (0, 3, b, 0.6), (0, 4, b, 0.9)])
    t = tracks(spark, [(0, 1, 5, b), (0, 2, 6, b)])
    taken = spark.createDataFrame([(0, 4, 6)], "frame_idx long, face_idx long, track_id long")
    got = {r.face_idx: (r.track_id, r.reason) for r in M.recall_pass(f, t, FR, taken, 0.1, 100.0, 100.0).collect()}
    assert got == {1: (None, "rejected_low_iou"), 2: (5, "recall"), 3: (None, "rejected_low_iou")}


def test_tracker_keeps_ids_and_ages_out(spark):
    rows = [("v", f, 1, 0.0, 0.0, 10.0, 10.0) for f in (0, 1, 2)] + [("v", 50, 1, 0.0, 0.0, 10.0, 10.0), ("v", 1, 2, 100.0, 0.0, 110.0, 10.0)]
    d = spark.createDataFrame(rows, "video_id string, frame_idx int, det_idx int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.frame_idx, r.det_idx): r.track_id for r in M.iou_tracks(d, ["video_id"], 0.3, 30).collect()}
    assert got == {(0, 1): 1, (1, 1): 1, (2, 1): 1, (1, 2): 2, (50, 1): 3}


def test_best_match_threshold_margin_and_override(spark):
    r = spark.createDataFrame([(1, 1, "A", 0.9), (1, 2, "B", 0.88), (2, 1, "A", 0.9), (2, 2, "B", 0.5), (3, 1, "B", 0.7), (4, 1, "C", 0.7)], "s long, rank int, match string, score double")
    got = {x.s: x.match for x in M.best_match(r, ["s"], 0.8, 0.05, {"C": 0.6}).collect()}
    assert got == {1: None, 2: "A", 3: None, 4: "C"}


def test_embedder_is_injected(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "id long, crop string")
    got = M.embed(df, lambda: lambda xs: [[float(len(x)), 1.0] for x in xs], "crop").orderBy("id").collect()
    assert [list(r.embedding) for r in got] == [[2.0, 1.0], [1.0, 1.0]]


def plain_tracks(rows, least, buffer):
    """(frame, det) to track: each detection, in order, to the first live track that overlaps, else to a new one."""
    live, out, following = [], {}, 1
    for frame in sorted({r[0] for r in rows}):
        live, used = [t for t in live if frame - t[2] <= buffer], set()
        for _, det, *box in sorted(r for r in rows if r[0] == frame):
            found = next((t for t in live if t[0] not in used and M._iou(t[1], box) > least), None)
            if found is None:
                found = [following, box, frame]
                following += 1
                live.append(found)
            found[1], found[2] = box, frame
            used.add(found[0])
            out[frame, det] = found[0]
    return out


@pytest.mark.parametrize("spell", [1, 7, 200])
def test_videos_are_cut_where_no_track_is_live(spark, spell):
    """Spells of 1, of 7 and of all frames give the numbers that a whole video gives."""
    rng = random.Random(spell)
    rows, frame = [], -5
    for k in range(200):
        frame += 1 if k % spell else rng.choice([4, 5, 11])
        rows += [(frame, d, x := float(rng.randint(0, 6) * 5), 0.0, x + 10, 10.0) for d in range(rng.randint(1, 3))]
    d = spark.createDataFrame([(v, *r) for v in ("a", None) for r in rows], "video_id string, frame_idx int, det_idx int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.video_id, r.frame_idx, r.det_idx): r.track_id for r in M.iou_tracks(d, ["video_id"], 0.3, 3).collect()}
    want = plain_tracks(rows, 0.3, 3)
    assert got == {(v, *k): t for v in ("a", None) for k, t in want.items()}
    spells = M._spells(d, ["video_id"], 3).where("video_id = 'a'").select("spell").distinct().count()
    assert spells == -(-200 // spell)


def test_contested_and_plain_frames_get_the_same_matching(spark):
    """Every matching of small frames, tried one by one."""
    rng = random.Random(7)
    rows = [(f, face, track, 100 + track, rng.choice((0.2, 0.5, rng.random()))) for f in range(60) for face in range(rng.randint(1, 3)) for track in range(rng.randint(1, 3)) if rng.random() < 0.8]
    rows += [(99, 0, 0, 100, 0.5), (99, 0, 0, 100, 0.7), (99, 1, 0, 100, 0.6)]  # an overlap given twice
    got = {}
    for r in M.optimal_faces(spark.createDataFrame(rows, "frame_idx long, face_idx long, track_idx long, track_id long, iou double").repartition(3), FR).collect():
        got.setdefault(r.frame_idx, {})[r.face_idx] = r.track_id - 100
    for f in {r[0] for r in rows}:
        own = {}
        for _, face, track, _, iou in (r for r in rows if r[0] == f):
            own[face, track] = max(iou, own.get((face, track), 0))
        faces_, tracks_ = sorted({k[0] for k in own}), sorted({k[1] for k in own})
        best = None
        for chosen in permutations([*tracks_, *[None] * len(faces_)], len(faces_)):
            pairs = [(a, b) for a, b in zip(faces_, chosen, strict=True) if b is not None]
            if all(p in own for p in pairs):
                key = (-len(pairs), round(-sum(own[p] for p in pairs), 9), sum((faces_.index(a) + 1) * (tracks_.index(b) + 1) ** 2 for a, b in pairs))
                best = min(best or (key, pairs), (key, pairs))
        assert got[f] == dict(best[1]), f


def test_totals_equal_at_eight_digits_go_by_weight(spark):
    rows = [(0, 1, 1, 1, 0.5), (0, 1, 2, 2, 0.5), (0, 2, 1, 1, 0.499999998), (0, 2, 2, 2, 0.5)]
    rows += [(1, 1, 1, 1, 0.5), (1, 1, 2, 2, 0.5), (1, 2, 1, 1, 0.49999998), (1, 2, 2, 2, 0.5)]
    m = spark.createDataFrame(rows, "frame_idx long, face_idx long, track_idx long, track_id long, iou double")
    got = {(r.frame_idx, r.face_idx): r.track_id for r in M.optimal_faces(m, FR).collect()}
    assert got == {(0, 1): 2, (0, 2): 1, (1, 1): 1, (1, 2): 2}


def test_searched_matchings_are_those_tried():
    rng = random.Random(5)
    for k in range(300):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        values = [[0.5, 0.500000001, 0.499999998], [0.1 + i / 7 for i in range(6)], [0.3]][k % 3]
        pairs = sorted({(rng.randrange(n), rng.randrange(m)): rng.choice(values) for _ in range(rng.randint(1, n * m))}.items())
        faces = sorted({f for (f, _), _ in pairs})
        options = [[(p, t, v) for p, ((g, t), v) in enumerate(pairs) if g == f] for f in faces]
        score = lambda chosen: (len(chosen), M._unit(sum((pairs[p][1] for p in sorted(chosen)), 0.0)), -sum((faces.index(pairs[p][0][0]) + 1) * (pairs[p][0][1] + 1) ** 2 for p in chosen))  # noqa: B023, E731
        a, b = M._tried(options), M._searched(options)
        assert len({pairs[p][0][1] for p in b}) == len(b) and score(a) == score(b)


def test_totals_at_a_half_are_rounded_as_they_are_summed():
    """Faces 5 and 11 are alike; their overlaps in one order sum up to just over a half of the eighth digit, in the other to
    just below it."""
    rows = [(1, 2, 0.057001772), (1, 10, 0.050468346), (1, 12, 0.055454154), (3, 4, 0.095445923), (3, 6, 0.093035438), (3, 8, 0.111989883), (3, 12, 0.126110193), (5, 2, 0.103824656), (5, 4, 0.069871896)]
    rows += [(5, 6, 0.089436027), (5, 8, 0.081983025), (5, 10, 0.058498415), (5, 12, 0.10100578), (9, 4, 0.109602974), (9, 6, 0.077126955), (9, 8, 0.128600823), (9, 12, 0.101387973), (11, 2, 0.103824656)]
    rows += [(11, 6, 0.089436027), (11, 10, 0.081167441), (11, 12, 0.0646815)]
    faces, tracks, iou = (list(x) for x in zip(*rows, strict=True))
    assert [rows[k][:2] for k in M.best_matching(faces, tracks, iou)] == [(1, 10), (3, 12), (5, 6), (9, 8), (11, 2)]
    total = 0.0
    for _ in range(41):
        total += 0.123456785
    assert M._largest([[(t, 0.123456785) for t in range(41)]] * 41, 41) == total  # all alike
    rng = random.Random(3)
    for _ in range(200):
        n, m = rng.randint(2, 4), rng.randint(2, 4)
        pairs = [(f, t, v) for f in range(n) for t, v in enumerate(rng.choice([(0.103824656, 0.089436027, 0.058498415, 0.05), (0.1, 0.2, 0.123456785, 0.05)])[:m])]
        options = [[(p, t, v) for p, (g, t, v) in enumerate(pairs) if g == f] for f in range(n)]
        assert M._searched(options) == M._tried(options)


def test_matchings_equal_in_all_go_by_their_last_faces():
    """What the SQL leaves open: the earlier end, then the later track of the last face, whichever way it is searched."""
    ends = [(1, 2, 0.2), (3, 2, 0.1), (1, 4, 0.1), (3, 4, 0.1), (5, 2, 0.3), (5, 4, 0.3), (5, 10, 0.2), (9, 4, 0.1), (11, 2, 0.2), (11, 4, 0.1)]
    last = [(f, t, v) for f, x, y in ((1, 0.125570052, 0.151186343), (3, 0.050468346, 0.060763889), (7, 0.125570052, 0.151186343)) for t, v in ((2, x), (6, y), (10, x))]
    last += [(5, 4, 0.089436027), (9, 4, 0.122170782), (9, 8, 0.100522834)]
    for rows, want in ((ends, [(1, 2), (3, 4), (5, 10)]), (last, [(1, 10), (3, 2), (5, 4), (7, 6), (9, 8)])):
        rows = sorted(rows)
        faces, tracks = sorted({f for f, _, _ in rows}), sorted({t for _, t, _ in rows})
        options = [[(k, tracks.index(t), v) for k, (f, t, v) in enumerate(rows) if f == face] for face in faces]
        for way in (M._tried, M._searched):
            assert sorted(rows[k][:2] for k in way(options)) == want


def test_overlaps_are_divided_once(spark):
    """A formula that is put into each filter on it makes the join's code too long for the JVM to compile."""
    from dwell.functions.numbers import nearest

    f = spark.range(3).select(F.lit(1).alias("frame_idx"), F.col("id").alias("face_idx"), G.box(0, 0, 10, 10).alias("face_box")).repartition(2)
    t = spark.range(2).select(F.lit(1).alias("frame_idx"), F.col("id").alias("track_idx"), F.col("id").alias("track_id"), G.box(0, 0, 10, 20).alias("track_box")).repartition(2)
    p = M.pairs(f, t, ["frame_idx"], 0.1, 100.0, 100.0, 0.1).withColumn("iou", nearest(F.col("iou"), 9)).where("iou >= 0.2")
    assert "Generate explode" in p._jdf.queryExecution().optimizedPlan().toString()
    assert [r.iou for r in p.collect()] == [pytest.approx(100 / 242)] * 6


def test_pairs_of_one_table_are_those_of_a_join(spark, sf):
    from dwell.plans import boxes

    rng = random.Random(7)
    side = lambda: float(rng.randint(0, 60))
    rows = [(rng.choice([None, 1, 2, 3]), k, rng.choice(["face", "person"]), k % 4, (x := side(), y := side(), x + side(), y + side()), 0.1 * k) for k in range(60)]
    rows += [(4, 60, "face", 0, (0.0, 0.0, 9.0, 9.0), 0.5), (5, 61, "person", 0, (0.0, 0.0, 9.0, 9.0), 0.5), (6, 62, "face", 0, (0.0, 0.0, 9.0, 9.0), 0.5), (6, 63, "person", 0, None, 0.5), (6, 64, "face", 0, None, 0.5)]
    d = spark.createDataFrame(rows, f"frame_idx long, det_idx int, kind string, track_id long, bbox {BOX}, score double")
    f = d.where("kind = 'face'").select("frame_idx", F.col("det_idx").alias("face_idx"), F.col("bbox").alias("face_box"), "score")
    t = d.where("kind = 'person'").select("frame_idx", F.col("det_idx").alias("track_idx"), "track_id", F.col("bbox").alias("track_box"))
    joined, within = M.pairs(f, t, FR, 0.1, 100.0, 100.0, 0.05), M.pairs_within(d, FR, F.col("kind") == "face", 0.1, 100.0, 100.0, 0.05)
    assert joined.columns == within.columns and sorted(joined.collect()) == sorted(within.collect()) and within.count() > 20
    # detections are read, sorted and numbered once, where a join would do it for faces and again for tracks
    plan = boxes.face_tiebreak(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("row_number()") == 1 and "Join" not in plan
