import json
import os
import random

import pytest
from pyspark.sql import functions as F

from dwell.functions import text as T
from dwell.operators import review as R
from dwell.sources import readers, sinks

K = ["track_id"]


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_names(spark):
    assert one(spark, T.normalize_label(F.lit("  lisa  van-p! "))) == "LISA_VAN-P"
    assert one(spark, T.normalize_label(F.lit(" !! "))) is None
    assert one(spark, T.frame_of(F.lit("a_f00123.jpg"))) == 123 and one(spark, T.frame_of(F.lit("a.jpg"))) == -1
    assert one(spark, T.track_of(F.lit("x/track_0012/y.jpg"))) == 12 and one(spark, T.track_of(F.lit("x"))) == -1
    assert one(spark, T.relative_to_track(F.lit("/a/b/track_1/c.jpg"))) == "track_1/c.jpg" and one(spark, T.relative_to_track(F.lit("c.jpg"))) == "c.jpg"
    status = [one(spark, T.assignment_status(F.lit(a), F.lit(p))) for a, p in ((0, 3), (3, 3), (1, 3), (1, 0), (None, 2))]
    assert status == ["Unassigned", "Assigned", "Partially", "Partially", "Unassigned"]
    assert one(spark, T.truthy(F.lit(" Yes"))) and not one(spark, T.truthy(F.lit("no")))


def test_summary_of_missing_parts(spark):
    manifest = spark.createDataFrame([(1, 5), (2, 7)], "track_id long, duration_frames long")
    samples = spark.createDataFrame([(2, True, 0.5), (2, False, 0.7), (3, True, None)], "track_id long, picked boolean, quality double")
    assigned = spark.createDataFrame([(2, 1)], "track_id long, assigned long")
    got = {r.track_id: r for r in R.track_summary(manifest, R.sample_summary(samples, K), assigned, K).collect()}
    assert got[1].n_samples == 0 and got[1].status == "Unassigned" and got[2].status == "Assigned" and got[2].median_quality == pytest.approx(0.6) and got[3].duration_frames is None
    both = R.track_summary(manifest, R.sample_summary(samples, K), assigned, K)
    assert [r.track_id for r in R.filter_tracks(both, min_picked=1, search="2|9").collect()] == [2]
    assert [r.track_id for r in R.table_order(both, "samples").collect()] == [2, 3, 1]


def test_assignments_and_edits(spark):
    log = spark.createDataFrame([(1, "B", 2, [("s2", "d")]), (1, "A", 1, [("s1", "d"), ("s2", "e")]), (1, "C", 3, None)], "track_id long, person string, when long, files array<struct<source:string,dest:string>>")
    r = R.assignment_index(log, K).first()
    assert r.persons == ["A", "B", "C"] and r.sources == ["s1", "s2"] and r.destinations == ["d", "e"] and r.source_person == {"s1": "A", "s2": "A"}
    ask = spark.createDataFrame([("s1", "x"), ("s3", "y"), ("s4", "y")], "source string, dest string")
    done = spark.createDataFrame([("s1",)], "source string")
    assert {x.source: x.skipped for x in R.new_assignments(ask, done).collect()} == {"s1": "already_assigned", "s3": None, "s4": "duplicate_destination"}
    samples = spark.createDataFrame([(1, k, f"/a/p{k}.jpg", True, "picked") for k in range(6)] + [(2, 0, "/a/p0.jpg", True, None)], "track_id long, frame_idx long, path string, picked boolean, reason string")
    edits = [(1, 1, 0, "x", "delete", None), (2, 1, 1, "x", "unassign", None), (3, 1, 2, "x", "path_update", "q"), (4, 9, 9, "file:///a/./b/../p3.jpg", "unassign", "r"), (5, 9, None, "elsewhere/p4.jpg", "delete", None), (6, 1, 2, "x", "delete", None), (7, 9, 9, "none", "delete", None)]
    edits = spark.createDataFrame(edits, "edit_id long, track_id long, frame_idx long, original_path string, action string, new_path string")
    got = {(x.track_id, x.frame_idx, x.path, x.picked, x.reason) for x in R.edit_samples(samples, edits).collect()}
    assert got == {(1, 1, "/a/p1.jpg", False, "manual_unassigned"), (1, 3, "r", False, "manual_unassigned"), (1, 5, "/a/p5.jpg", True, "picked"), (2, 0, "/a/p0.jpg", True, None)}
    assert R.edit_samples(samples, edits.limit(0)).count() == 7 and R.edit_samples(samples.limit(0), edits).count() == 0


def test_clusters(spark):
    c = spark.createDataFrame([(0, 1), (1, 1), (1, 2), (2, 3)], "cluster_id int, track_id long")
    assert {(r.cluster_id, r.track_id) for r in R.move_track(c, 1, 2).collect()} == {(1, 2), (2, 3), (2, 1)}
    kept, flagged = R.reindex_clusters(c, 2)
    assert {(r.cluster_id, r.new_id) for r in kept.collect()} == {(1, 0)} and {r.cluster_id for r in flagged.collect()} == {0, 2}
    s = spark.createDataFrame([(1, True, False, 60.0, 0.06), (1, True, False, 10.0, 0.06), (2, True, False, 60.0, 0.01)], "track_id long, picked boolean, is_debug boolean, sharpness double, area_frac double")
    assert [(r.track_id, r.kept) for r in R.cluster_inputs(s, 50.0, 0.05, 1).collect()] == [(1, 1)]


def test_cluster_queries_see_every_line(spark, sf):
    from dwell.plans import review

    pairs = {(r.l_suppkey, r.l_orderkey) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_orderkey").collect()}
    assert {tuple(r) for r in review.cluster_move(spark, sf).collect()} == {p for p in pairs if p[1] != 42} | {(3, 42)}
    again = review.cluster_reindex(spark, sf).collect()
    assert {(r.cluster_id, r.track_id) for r in again} == pairs and len(again) == len(pairs)


def test_review_queries_see_whole_tables(spark, sf):
    from dwell.plans import review

    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").collect()
    lines, orders, customers = read("lineitem"), read("orders"), read("customer")
    track = {o.o_orderkey: o.o_custkey % 50 for o in orders}
    dests = {}
    for r in lines:
        dests.setdefault(track[r.l_orderkey], set()).add(r.l_suppkey)
    assert {r.track_id: r.n_dest for r in review.assignment_index(spark, sf).collect() if r.n_dest > 0} == {t: len(d) for t, d in dests.items()}

    got = review.track_summary(spark, sf).collect()
    assert sum(r.n_samples for r in got) == len(lines) and {r.track_id for r in got} >= {c.c_custkey for c in customers}
    assert sum(r.assigned for r in got) == sum(o.o_orderstatus == "P" for o in orders)
    assert review.review_queue(spark, sf).count() == len(got) and any(r.n_samples == 0 for r in got)

    samples = [f"track_{r.l_suppkey}/f{r.l_orderkey}" for r in lines]
    images = {f"track_{o.o_custkey}/f{o.o_orderkey}" for o in orders}
    checked = review.validation_summary(spark, sf).collect()
    assert sum(r.n_samples for r in checked) == len(lines) and sum(r.extra for r in checked) == len(images - set(samples))
    assert sum(r.missing for r in checked) == sum(p not in images for p in samples)
    assert {tuple(r) for r in review.missing_vs_disk(spark, sf).collect()} == {(p, "left") for p in set(samples) - images} | {(p, "right") for p in images - set(samples)}


def test_validation_and_exit_status(spark):
    samples = spark.createDataFrame([(1, "a", True, 0.5), (1, "b", False, 0.6)], "track_id long, path string, picked boolean, quality double")
    images = spark.createDataFrame([(1, "a"), (2, "z")], "track_id long, path string")
    v = R.validation(samples, images, K)
    got = {r.track_id: (r.n_samples, r.missing, r.extra) for r in v.collect()}
    assert got == {1: (2, 1, 0), 2: (0, 0, 1)}
    assert R.exit_status(v) == 1 and R.exit_status(v, allow_extra=True, allow_empty=True) == 0
    assert R.exit_status(v, True, True, True) == 1 and R.exit_status(v, allow_extra=True, allow_empty=True, max_tracks=1) == 1


def test_validation_of_a_manifest(spark, tmp_path):
    sample = "struct<path:string,quality:double,sharpness:double,frontalness:double,score:double>"
    m = [(1, 5, 10, 0.0, 1500.0, [("a", 0.5, 1.0, None, 0.9), ("b", 0.7, 3.0, 0.5, None), (None, 9.0, 9.0, 9.0, 9.0)]), (2, None, None, None, None, None), (3, 6, 1, 2.0, None, [])]
    manifest = spark.createDataFrame(m, f"track_id long, byte_track_id long, total_frames int, first_ts_ms double, last_ts_ms double, samples array<{sample}>")
    images = spark.createDataFrame([(1, "a"), (1, "z"), (9, "y"), (1, "a")], "track_id long, path string")
    per = {r.track_id: r for r in R.validation_report(manifest, images).collect()}
    assert (per[1].sample_count, per[1].missing_samples, per[1].directory_images, per[1].duration_seconds) == (3, 2, 2, 1.5)
    assert (per[1].avg_quality, per[1].median_quality, per[1].avg_sharpness, per[1].avg_frontalness, per[1].avg_score) == pytest.approx((0.6, 0.6, 2.0, 0.5, 0.9))
    assert per[2].sample_count == 0 == per[3].missing_samples and per[3].avg_quality is None and len(per[1]) == 13
    totals = {r.metric: r.value for r in R.validation_totals(manifest, images).collect()}
    want = dict(total_tracks=3, total_samples=3, samples_per_track_mean=1.0, samples_per_track_median=0.0, quality_mean=0.6, referenced_files=2, existing_files=1, extra_images=2, extra_track_dirs=1, missing_track_dirs=2, score_mean=0.9)
    assert {k: totals[k] for k in want} == pytest.approx(want)
    sinks.reports(R.validation_report(manifest, images), R.validation_totals(manifest, images), str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "tracks.csv")).count() == 3
    assert spark.read.json(str(tmp_path / "metrics.json")).select("metrics.extra_images").first()[0] == 2.0
    assert R.validation_report(manifest.limit(0), images).count() == 0


def test_tracks_find_their_clusters(spark):
    t, c = spark.createDataFrame([(1,), (2,), (3,)], "track_id long"), spark.createDataFrame([(4, 1), (2, 1), (0, 3)], "cluster_id int, track_id long")
    assert sorted((r.track_id, r.cluster_id) for r in R.track_clusters(t, c).where("cluster_id is not null").collect()) == [(1, 2), (3, 0)]
    assert [r.track_id for r in R.track_clusters(t, c, 0).collect()] == [3] and R.track_clusters(t, c).count() == 3


def test_files_round_trip(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    tracks = spark.createDataFrame([(1, 7)], "track_id long, byte_track_id long")
    samples = spark.createDataFrame([(1, 9, "p9", True), (1, 3, "p3", False)], "track_id long, frame_idx int, path string, picked boolean")
    sinks.manifest(tracks, samples, K, at("manifest.json"))
    back = readers.samples_of_manifest(readers.manifest_or_fallback(spark, at("manifest.json"), False)).collect()
    assert [(r.track_id, r.frame_idx, r.path) for r in back] == [(1, 3, "p3"), (1, 9, "p9")]
    (tmp_path / "lenient.json").write_text('[{"track_id": "12", "avg_conf": "0.5", "total_frames": "many", "samples": []}, {"track_id": 3, "byte_track_id": 4.0}]')
    assert [(r.track_id, r.byte_track_id, r.avg_conf, r.total_frames) for r in readers.manifest(spark, at("lenient.json")).collect()] == [(12, None, 0.5, None), (3, 4, None, None)]
    assert readers.manifest_or_fallback(spark, at("none.json"), True).first().track_id == 1
    assert readers.manifest_or_fallback(spark, at("none.json"), False).count() == 0

    (tmp_path / "s.csv").write_text("track_id,path,picked,sharpness\n1,a,YES,x\n2,b,0,50.5\n3,c,,1\n")
    got = {r.track_id: (r.picked, r.sharpness, r.quality) for r in readers.selected_samples(spark, at("s.csv")).collect()}
    assert got == {1: (True, None, None), 2: (False, 50.5, None), 3: (True, 1.0, None)}

    members = spark.createDataFrame([(2, 5), (2, 4), (2, 5)], "cluster_id int, track_id int")
    sinks.clusters(members, at("clusters.json"))
    assert {(r.cluster_id, r.track_id) for r in readers.clusters(spark, at("clusters.json")).collect()} == {(2, 4), (2, 5)}

    (tmp_path / "log.jsonl").write_text('{"stem":"e","harvest_id":1,"byte_track_id":2,"person":"A","files":[{"source":"s","dest":"d"}],"when":"2024-05-01T10:00:00Z"}\n\nnot json\n')
    log = readers.assignments(spark, at("log.jsonl"))
    assert [(r.person, r.when.year) for r in log.collect()] == [("A", 2024)]
    sinks.append_assignments(log, at("log2"))
    sinks.append_assignments(log, at("log2"))
    assert readers.assignments(spark, at("log2")).count() == 2

    (tmp_path / "a.json").write_text(json.dumps({"frame_annotations": {"7": [{"track_id": 1, "bbox": [0, 0, 1, 1], "label": "A", "score": 0.5}, {"track_id": 1, "bbox": [0, 0, 2, 2], "label": "B", "score": 0.6}]}}))
    (tmp_path / "debug.json").write_text(json.dumps({"reject_counts": {"x": 1}, "frame_events": {"3": [{"track_id": 1, "bbox": [0, 0, 1, 1], "reason": "picked"}]}}))
    (tmp_path / "run.json").write_text(json.dumps({"video": "v", "frame_annotations": [{"frame_idx": 5, "tracks": [{"track_id": 2, "bbox": [0, 0, 1, 1], "label": "A", "score": 0.5}, {"track_id": 3, "bbox": None}]}, {"tracks": [{"track_id": 9, "bbox": [0, 0, 1, 1]}]}]}))
    events = lambda log, **how: [(r.frame_idx, r.track_id, r.reason) for r in readers.events_or_annotations(spark, at(log), at("run.json"), **how).collect()]
    assert events("debug.json") == [(3, 1, "picked")] and events("none.json") == [(5, 2, "track")] == events("debug.json", use_annotations=True)
    (tmp_path / "progress.json").write_text('{"frames_done": 40, "frames_total": "100", "percent": "40.0", "tracks": null}')
    assert [tuple(r)[:4] for r in readers.progress(spark, at("progress.json")).collect()] == [(100, 40, 40.0, 0)]
    r = readers.annotation_index(spark, at("a.json")).first()
    assert (r.frame_idx, r.label, r.bbox.x2) == (7, "B", 2.0)


def test_image_listings(spark, tmp_path):
    for p in ("bank/KIM/1.jpg", "bank/KIM/2.txt", "bank/LVP/3.PNG", "h/track_0004/x_f00012.jpg", "h/track_0004/debug/x_f00013.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    assert sorted(r.label for r in readers.facebank_images(spark, str(tmp_path / "bank")).collect()) == ["KIM", "LVP"]
    scanned = readers.scanned_tracks(spark, str(tmp_path / "h"))
    assert sorted((r.track_id, r.frame_idx, r.picked) for r in scanned.collect()) == [(4, 12, True), (4, 13, False)]
    s = spark.createDataFrame([("/old/place/track_0004/x_f00012.jpg",), ("track_0004/none.jpg",)], "path string")
    got = {r.path: r.resolved for r in readers.resolve_paths(s, scanned, str(tmp_path / "h")).collect()}
    assert got["/old/place/track_0004/x_f00012.jpg"].endswith("h/track_0004/x_f00012.jpg") and got["track_0004/none.jpg"] is None


def test_facebank_and_tracker_files(spark, tmp_path):
    bank = spark.createDataFrame([("A", 2, [1.0, 0.0])], "label string, count long, embedding array<double>")
    sinks.facebank(bank, spark.createDataFrame([("A", "p")], "label string, path string"), str(tmp_path))
    assert readers.facebank(spark, str(tmp_path / "facebank.parquet")).first().embedding == [1.0, 0.0]
    seg = spark.createDataFrame([(1, 0, "A", 0.0, 1500.0, 1500.0)], "track_id long, subtrack_id int, label string, start_ms double, end_ms double, duration_ms double")
    sinks.tracker_outputs(seg, K, 3, ["A"], str(tmp_path / "out"))
    assert readers.totals(spark, str(tmp_path / "out/totals.json")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "out/timeline.csv")).count() == 3
    nested = spark.createDataFrame([([[1.0, 2.0]],)], "embedding array<array<double>>")
    assert readers.normalize_embeddings(nested).first().embedding == [1.0, 2.0]


def test_samples_file_as_it_is_written(spark, tmp_path):
    """The fixed header, the frame by its name, text numbers, and what missing columns become."""
    header = "track_id,byte_track_id,frame,quality,sharpness,frontalness,area_frac,picked,reason,path,association_iou,match_mode,frame_offset,identity_cosine,similarity_to_centroid,provider,recall_only"
    (tmp_path / "s.csv").write_text(header + "\n1,9007199254740993,40,0.5,80,0.9,0.02,True,picked,t/a.jpg,0.7,iou,-2,0.8,0.91,arc,False\n2,,7.0,nan,x,,,0,rejected_area,t/b.jpg,,,,,,,yes\nnone,,,,,,,,,t/c.jpg,,,,,,,\n")
    rows = readers.selected_samples(spark, str(tmp_path / "s.csv")).orderBy("path").collect()
    assert rows[0][:17] == (1, 9007199254740993, 40, 0.5, 80.0, 0.9, 0.02, True, "picked", "t/a.jpg", 0.7, "iou", -2, 0.8, 0.91, "arc", False) and rows[0].is_debug is False
    assert rows[1][:11] == (2, 2, 7, None, None, None, None, False, "rejected_area", "t/b.jpg", None) and rows[1].recall_only is True
    assert rows[2][:3] == (-1, -1, None) and rows[2].picked is True
    (tmp_path / "bare.csv").write_text("track_id,path\n3,t/x_f00012.jpg\n4,t/y.jpg\n")
    bare = {r.track_id: (r.byte_track_id, r.frame_idx, r.picked, r.reason) for r in readers.selected_samples(spark, str(tmp_path / "bare.csv")).collect()}
    assert bare == {3: (3, 12, True, "picked"), 4: (4, None, True, "picked")}
    s = spark.createDataFrame([(1, 7, 40, 0.5, True, "picked", "p", 0.25, "iou", 3, 0.5, 0.75, "arc", True), (1, 7, 41, 0.4, False, "x", "q", None, None, None, None, None, None, None)], "track_id long, byte_track_id long, frame_idx int, quality double, picked boolean, reason string, path string, association_iou double, match_mode string, frame_offset int, identity_cosine double, similarity_to_centroid double, provider string, recall_only boolean")
    sinks.selected_samples(s, K, str(tmp_path / "out.csv"))
    back = readers.selected_samples(spark, str(tmp_path / "out.csv"))
    assert sorted(map(tuple, back.select(s.columns).collect())) == sorted(map(tuple, s.collect()))


def test_progress_and_manifest_numbers(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    for name, text, want in (("a", '{"frames_total": 7.9, "percent": "x"}', (7, 0, None, 0)), ("b", "{}", (0, 0, None, 0)), ("c", '{"frames_total": "many", "tracks": "3"}', (0, 0, None, 3))):
        (tmp_path / name).write_text(text)
        got = readers.progress(spark, at(name)).collect()
        assert [tuple(r)[:4] for r in got] == [want] and got[0].raw == text
    for name, text in (("d", "not json"), ("e", ""), ("f", "[1]")):
        (tmp_path / name).write_text(text)
        assert readers.progress(spark, at(name)).count() == 0
    assert readers.progress(spark, at("missing")).count() == 0
    (tmp_path / "m.json").write_text('[{"track_id": "9007199254740993", "byte_track_id": 9007199254740995, "avg_conf": "nan", "samples": []}]')
    assert [(r.track_id, r.byte_track_id, r.avg_conf) for r in readers.manifest(spark, at("m.json")).collect()] == [(9007199254740993, 9007199254740995, None)]


def test_assignments_as_they_are_written(spark, tmp_path):
    lines = [
        '{"stem":"e","harvest_id":"1","byte_track_id":" 2 ","person":"A","files":[{"src":"s1","destination":"d1"},{"path":"s2","target":"d2"},"plain/d3",{"source":"","dest":null}],"when":"2024-05-01T10:00:00Z"}',
        "", "[1, 2]", '{"harvest_id":1.0,"byte_track_id":"x","person":"B"}', "{broken",
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    got = {(r.stem, r.harvest_id, r.byte_track_id): [tuple(f) for f in r.files] for r in readers.assignments(spark, str(tmp_path / "log.jsonl")).where("person IS NOT NULL").collect()}
    assert got == {("e", 1, 2): [("s1", "d1"), ("s2", "d2"), (None, "plain/d3"), (None, None)], ("", 1, -1): []}
    index = {r.stem: r for r in R.assignment_index(readers.assignments(spark, str(tmp_path / "log.jsonl")), ["stem"]).collect()}
    assert index["e"].sources == ["s1", "s2"] and index["e"].destinations == ["d1", "d2", "plain/d3"] and index["e"].destination_person["plain/d3"] == "A" and index[""].persons == ["B"] and index[""].sources is None


def test_appends_are_written_once(spark, tmp_path):
    log = spark.createDataFrame([("e", 1, 2, "A", "x"), ("e", 1, 2, "A", "x"), ("e", 1, 3, "B", "y")], "stem string, harvest_id int, byte_track_id int, person string, entry_id string").selectExpr("*", "timestamp'2024-05-01 10:00:00' AS when")
    at = str(tmp_path / "log")
    assert sinks.append_assignments(log, at).count() == 2 and sinks.append_assignments(log, at).count() == 0
    more = log.limit(1).withColumn("entry_id", F.lit("z"))
    assert sinks.append_assignments(more.unionByName(log), at).count() == 1 and readers.assignments(spark, at).count() == 3


def plain_edits(samples, edits):
    """All edits in order, each of what it meets in the table as given."""
    clean = lambda p: os.path.normpath(p.removeprefix("file://"))
    out = {k: dict(s) for k, s in enumerate(samples)}
    for e in sorted(edits, key=lambda e: e["edit_id"]):
        ways = [lambda s: s["track_id"] == e["track_id"] and e["frame_idx"] in (None, s["frame_idx"]), lambda s: clean(s["path"]) == clean(e["original_path"]), lambda s: s["path"].endswith(e["original_path"].rpartition("/")[2])]
        met = next((m for w in ways if (m := [k for k, s in enumerate(samples) if w(s)])), [])
        for k in met:
            if e["action"] == "delete":
                out.pop(k, None)
            elif k in out:
                if e["action"] == "unassign":
                    out[k]["picked"], out[k]["reason"] = False, "manual_unassigned"
                out[k]["path"] = e["new_path"] or out[k]["path"]
    return sorted((tuple(s.values()) for s in out.values()), key=repr)


def test_edits_act_one_after_another(spark):
    rng = random.Random(3)
    for _ in range(4):
        samples = [dict(track_id=t, frame_idx=f, path=f"/h/track_{t}/{rng.choice(['', 'b'])}f{f}.jpg", picked=True, reason="picked") for t in range(4) for f in range(5)]
        edits = []
        for k in range(14):
            s = rng.choice(samples)
            edits.append(dict(edit_id=k, track_id=rng.choice((s["track_id"], 99, 98)), frame_idx=rng.choice((s["frame_idx"], s["frame_idx"], None)), original_path=rng.choice((s["path"], "file:///h/./x/.." + s["path"][2:], f"/gone/{s['path'].rpartition('/')[2]}")), action=rng.choice(("delete", "unassign", "path_update", "path_update")), new_path=rng.choice((None, f"new{k}"))))
        d = spark.createDataFrame(samples, "track_id long, frame_idx long, path string, picked boolean, reason string")
        e = spark.createDataFrame(edits, "edit_id long, track_id long, frame_idx long, original_path string, action string, new_path string")
        assert sorted(map(tuple, R.edit_samples(d, e).collect()), key=repr) == plain_edits(samples, edits)


def test_edits_meet_samples_by_exchanges(spark, tmp_path, monkeypatch):
    """The file is small enough to be broadcast; its rows by key are not, so no side may go through the driver."""
    spark.range(20000).selectExpr("id AS track_id", "id AS frame_idx", "concat('/s/t', id, '.jpg') AS path", "true AS picked", "'p' AS reason").write.parquet(str(tmp_path / "s"))
    samples = spark.read.parquet(str(tmp_path / "s"))
    edits = samples.selectExpr("frame_idx AS edit_id", "track_id", "frame_idx", "path AS original_path", "'unassign' AS action", "CAST(NULL AS STRING) AS new_path").where("edit_id % 3 = 0")
    plans, plain = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    out = R.edit_samples(samples, edits)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert "SortMergeJoin" in "".join(plans) and "BroadcastHashJoin" not in "".join(plans)
    assert out.where("reason = 'manual_unassigned'").count() == 6667


def test_edits_in_place_rewrite_their_buckets_alone(spark, tmp_path):
    at = str(tmp_path / "samples")
    d = spark.createDataFrame([(t, f, f"/h/track_{t}/f{f}.jpg", True, "picked") for t in range(40) for f in range(3)], "track_id long, frame_idx long, path string, picked boolean, reason string")
    sinks.samples_table(d, at, 16)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "samples").rglob("*.parquet")}
    of = {r.track_id: r.bucket for r in spark.read.parquet(at).collect()}
    alone = next(t for t in of if list(of.values()).count(of[t]) == 1) if any(list(of.values()).count(b) == 1 for b in of.values()) else None
    edits = [(1, 7, 1, "x", "delete", None), (2, 7, 2, "x", "path_update", "q"), (3, 7, 2, "x", "unassign", None)] + ([(4, alone, None, "x", "delete", None)] if alone is not None and alone != 7 else [])
    e = spark.createDataFrame(edits, "edit_id long, track_id long, frame_idx long, original_path string, action string, new_path string")
    before = files()
    changed = sinks.edit_table(spark, at, e)
    after = files()
    assert set(changed) == {of[x[1]] for x in edits}
    assert {p: t for p, t in before.items() if not any(f"bucket={b}/" in p for b in changed)} == {p: t for p, t in after.items() if not any(f"bucket={b}/" in p for b in changed)}
    want = sorted(map(tuple, R.edit_samples(d, e).collect()))
    read = lambda: sorted(map(tuple, spark.read.parquet(at).select(d.columns).collect()))
    assert read() == want
    again = sinks.edit_table(spark, at, e.where("edit_id > 1 AND edit_id < 4"))
    assert again == [of[7]] and read() == want
    assert sinks.edit_table(spark, at, e.limit(0)) == []


def test_path_cascade(spark, tmp_path):
    root = tmp_path / "h"
    for p in ("track_0004/x_f00012.jpg", "candidates/track_0005/F000007.png", "candidates/track_0006/F000008.jpg", "track_0007/debug/d.jpg", "odd%s/track_0001/z.jpg"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b"x")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).select("path")
    rows = [(4, 1, str(root / "track_0004/x_f00012.jpg"), 0), (4, 1, "track_0004/x_f00012.jpg", 0), (4, 1, "/old/track_0004/x_f00012.jpg", 0), (5, 7, "gone.png", "candidates/track_0005/F000007.png"), (6, 8, "gone.png", "candidates/track_0006/F000008.jpg"), (7, 3, "y/d.jpg", "track_0007/debug/d.jpg"), (7, None, "y/d.jpg", None), (None, 3, None, None)]
    s = spark.createDataFrame([(k, t, f, p) for k, (t, f, p, _) in enumerate(rows)], "k int, track_id long, frame_idx long, path string")
    got = {r.k: r.resolved for r in readers.resolve_paths(s, files, str(root)).collect()}
    assert got == {k: None if w is None else str(root / (w or "track_0004/x_f00012.jpg")) for k, (_, _, _, w) in enumerate(rows)}


def test_nested_paths_scene_and_preview_files(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    (tmp_path / "m.json").write_text(json.dumps([{"track_id": 1, "samples": [{"path": "/data/h/ep/track_0001/a.jpg"}, {"path": "track_0001/b.jpg"}, {"path": "/x/c.jpg"}, {"path": ""}, {"path": None}]}, {"track_id": 2}]))
    got = readers.samples_of_manifest(readers.relative_paths(readers.manifest(spark, at("m.json")))).orderBy("track_id").collect()
    assert [r.path for r in got] == ["track_0001/a.jpg", "track_0001/b.jpg", "c.jpg", "", None, None]
    sinks.scenes(spark.createDataFrame([(0, 0, 9), (1, 10, 30)], "scene_idx int, start_frame int, end_frame int"), at("scenes"))
    assert sorted(map(tuple, readers.scenes(spark, at("scenes")).collect())) == [(0, 0, 9), (1, 10, 30)]
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    faces = [(0, 5, 0, (0.5, 1.5, 20.4, 30.0), 0.9), (-1, 6, 1, (-5.0, 0.0, 20.0, 20.0), None), (1, 7, 0, (3.0, 3.0, 3.2, 9.0), 0.5), (1, -1, 0, (0.0, 0.0, 9.0, 9.0), 0.5), (1, 8, 0, (0.0, 0.0, 2.0, 2.0), 0.5), (1, 9, 0, (200.0, 0.0, 240.0, 40.0), 0.5)]
    sinks.candidates(spark.createDataFrame(faces, f"scene_idx int, frame_idx int, det_idx int, bbox {box}, score double"), at("cand"), 100.0, 100.0, 0.003)
    assert sorted(map(tuple, readers.candidates(spark, at("cand")).collect())) == [(-1, 6, -5, 0, 20, 20, 1.0, "candidates/noscenes/F000006_C01.jpg"), (0, 5, 0, 2, 20, 30, 0.9, "candidates/scene_0000/F000005_C00.jpg")]
    members = spark.createDataFrame([(0, 1, 5, "c/a.jpg"), (2, 1, 6, "c/b.jpg"), (-1, 2, 7, "c/d.jpg"), (-1, 1, 9, "c/e.jpg")], "cluster_id int, scene_idx int, frame_idx int, rel_path string")
    sinks.preview(members, "/out", at("preview"))
    got = sorted(map(tuple, readers.preview(spark, at("preview")).collect()))
    assert got == [(-1, 3, 1, 9, "c/e.jpg", "clusters/noise/e.jpg", "/out/clusters/noise/e.jpg", ""), (-1, 4, 2, 7, "c/d.jpg", "clusters/noise/d.jpg", "/out/clusters/noise/d.jpg", ""), (0, 0, 1, 5, "c/a.jpg", "clusters/cluster_0000/a.jpg", "/out/clusters/cluster_0000/a.jpg", ""), (2, 2, 1, 6, "c/b.jpg", "clusters/cluster_0002/b.jpg", "/out/clusters/cluster_0002/b.jpg", "")]


def test_first_appearances_are_found_without_sorting_entries(spark):
    entries = [(1, "A", 5, [("s", "d"), ("s", None)]), (1, "B", None, [("t", "e")]), (1, None, -3, [("u", "f"), ("s", "")]), (1, "", 7, None), (2, "C", 2**62, [("s", "d")]), (2, "D", -(2**62), [("s", "e"), ("s", "d")])]
    log = spark.createDataFrame(entries, "track_id long, person string, when long, files array<struct<source:string,dest:string>>")
    for kind, when in (("number", F.col("when")), ("time", F.timestamp_micros(F.col("when") % 10**15)), ("text", F.format_string("%020d", F.col("when") + 10))):
        index = R.assignment_index(log.withColumn("when", F.when(F.col("when").isNotNull(), when)), K)
        one = index.where("track_id = 1").first()
        assert one.persons == ["B", "A"] and one.sources == ["t", "u", "s"] and one.destinations == ["e", "f", "d"]
        assert one.source_person == {"s": "A", "t": "B"} and one.destination_person == {"d": "A", "e": "B"}
        lines = index._jdf.queryExecution().executedPlan().toString().splitlines()
        above = lines[next(k for k, x in enumerate(lines) if "Generate explode(" in x) - 2]
        assert ("HashAggregate" in above) == (kind != "text")
    two = R.assignment_index(log, K).where("track_id = 2").first()
    assert two.persons == ["D", "C"] and two.destinations == ["e", "d"] and two.destination_person == {"e": "D", "d": "D"}


def test_logs_of_boxes_are_packed(spark, tmp_path):
    import random

    rng = random.Random(6)
    rows = [(k // 4, k % 4, [rng.random() * 600 for _ in range(4)], "face", "picked", rng.random()) for k in range(4000)]
    d = spark.createDataFrame(rows, "frame_idx long, track_id int, bbox array<double>, label string, reason string, score double")
    log, notes = str(tmp_path / "log"), str(tmp_path / "notes")
    sinks.frame_events(d, log)
    sinks.annotations(d.drop("reason"), notes)
    d.write.json(str(tmp_path / "plain"))
    size = lambda p: sum(f.stat().st_size for f in (tmp_path / p).glob("part-*"))
    assert 0 < size("log") < size("plain") * 0.6 and 0 < size("notes/frames") < size("plain") * 0.6
    want = sorted((f, t, *b, s) for f, t, b, _, _, s in rows)
    for got in (readers.frame_events(spark, log), readers.annotated_events(spark, f"{notes}/frames")):
        assert sorted((r.frame_idx, r.track_id, *r.bbox, r.score) for r in got.collect()) == want
