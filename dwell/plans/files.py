"""Names and files: what is written is read back, by the engine's own writers and readers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from dwell import schemas
from dwell.functions import text as T
from dwell.operators.graph import fresh_folder
from dwell.plans import fixtures as X
from dwell.plans.base import query, rounded, table
from dwell.sources import readers, sinks


def _fresh(spark, name: str) -> str:
    return f"{fresh_folder(spark, 'files')}/{name}"


@query("""SELECT c_custkey, c_custkey AS track, CASE WHEN c_nationkey < 20 THEN c_custkey ELSE -1 END AS frame, c_nationkey % 4 < 3 AS picked, 'track_' || c_custkey || '/' || 'a' || CASE WHEN c_nationkey < 20 THEN '_f' || c_custkey ELSE '' END || '.jpg' AS relative,
'ep_' || substr(sha1('/root/track_' || c_custkey || '/' || 'a' || CASE WHEN c_nationkey < 20 THEN '_f' || c_custkey ELSE '' END || '.jpg'), 1, 12) AS key FROM customer""")
def name_parsing(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("a"), F.when(F.col("c_nationkey") < 20, F.concat(F.lit("_f"), F.col("c_custkey").cast("string"))).otherwise(""), F.lit(".jpg"))
    path = F.concat(F.lit("/root/track_"), F.col("c_custkey").cast("string"), F.lit("/"), name)
    said = F.element_at(F.array(*map(F.lit, ("TRUE", " yes", "1", "no"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return c.select(
        "c_custkey", T.track_of(path).alias("track"), T.frame_of(name).alias("frame"), T.truthy(said).alias("picked"), T.relative_to_track(path).alias("relative"), T.cache_key(path, F.lit("ep")).alias("key")
    )


_COLOURS = ", ".join(f"('{k}', {b}, {g}, {r})" for k, (b, g, r) in T.REASON_COLOURS.items())


@query(f"""WITH {X.CAND}, k(reason, b, g, r) AS (VALUES {_COLOURS}), x AS (SELECT track_id, frame_idx, l_linenumber, l_partkey, CASE WHEN round(area_frac, 9) < 0.003 THEN 'rejected_area' WHEN sharpness < 20 THEN 'rejected_sharpness' WHEN round(frontalness, 9) < 0.15 THEN 'rejected_frontalness' WHEN l_linenumber = 1 THEN 'picked' ELSE 'other' END AS reason FROM cand)
SELECT track_id, frame_idx, l_linenumber, l_partkey, reason, coalesce(b, 255) AS b, coalesce(g, 255) AS g, coalesce(r, 255) AS r FROM x LEFT JOIN k USING (reason)""")
def reason_colours(spark, sf_dir):
    from dwell.operators import sampling as P

    gated = P.gate_reasons(rounded(X.candidates(spark, sf_dir), 9, "area_frac", "frontalness"), 0.003, 20.0, 0.15)
    named = gated.withColumn("reason", F.coalesce("reason", F.when(F.col("l_linenumber") == 1, "picked").otherwise("other")))
    return named.select("track_id", "frame_idx", "l_linenumber", "l_partkey", "reason", T.reason_colour(F.col("reason")).alias("c")).select("track_id", "frame_idx", "l_linenumber", "l_partkey", "reason", "c.*")


@query(f"""WITH {X.RANKED} SELECT s_suppkey AS track_id, CASE WHEN s_nationkey < 12 THEN s_nationkey END AS byte_track_id, s_suppkey * 3 AS total_frames, round(s_acctbal, 2) AS avg_conf, frame_idx, path, round(quality, 9) AS quality
FROM supplier LEFT JOIN (SELECT track_id, frame_idx, 'p' || frame_idx || '_' || l_linenumber || '_' || l_partkey || '_' || rank AS path, quality FROM ranked) ON track_id = s_suppkey""")
def manifest_files(spark, sf_dir):
    """Numbers are written as text, some of them as no numbers."""
    s = table(spark, sf_dir, "supplier")
    tracks = s.select(
        F.col("s_suppkey").cast("string").alias("track_id"), F.when(F.col("s_nationkey") < 12, F.col("s_nationkey").cast("string")).otherwise("n/a").alias("byte_track_id"), (F.col("s_suppkey") * 3).cast("string").alias("total_frames"), F.col("s_acctbal").cast("string").alias("avg_conf")
    )
    path = F.concat_ws("_", F.concat(F.lit("p"), F.col("frame_idx").cast("string")), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("rank").cast("string"))
    samples = X.ranked(spark, sf_dir).select(F.col("track_id").cast("string").alias("track_id"), F.col("frame_idx").cast("int").alias("frame_idx"), path.alias("path"), "quality")
    at = _fresh(spark, "manifest.json")
    sinks.manifest(tracks, samples, ["track_id"], at)
    back = readers.manifest_or_fallback(spark, at, False)
    own = readers.samples_of_manifest(back).select("track_id", "byte_track_id", "frame_idx", "path", F.round("quality", 9).alias("quality"))
    return own.join(back.select("track_id", "total_frames", F.round("avg_conf", 2).alias("avg_conf")), "track_id").select("track_id", "byte_track_id", "total_frames", "avg_conf", "frame_idx", "path", "quality")


_SELECTED = """track_id, CASE WHEN l_linenumber = 1 THEN track_id ELSE l_linenumber END AS byte_track_id, CAST(frame_idx AS INT) AS frame_idx, round(quality, 9) AS quality, round(sharpness, 6) AS sharpness, round(frontalness, 6) AS frontalness,
round(area_frac, 6) AS area_frac, picked, CASE WHEN picked THEN 'picked' ELSE 'rejected_quality' END AS reason, 'track_' || track_id || '/f' || frame_idx || '_' || l_linenumber || '_' || l_partkey || '.jpg' AS path, CASE WHEN l_linenumber < 5 THEN round(l_quantity / 64.0::DOUBLE, 6) END AS association_iou,
l_returnflag AS match_mode, CAST(l_linenumber - 3 AS INT) AS frame_offset, round(l_quantity / 50.0::DOUBLE, 6) AS identity_cosine, round(l_quantity / 51.0::DOUBLE, 6) AS similarity_to_centroid, l_linestatus AS provider, l_linenumber = 2 AS recall_only, false AS is_debug"""


@query(f"""WITH {X.RANKED} SELECT {_SELECTED} FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY {X.ORDER}) AS place FROM ranked) WHERE place <= 20
UNION ALL SELECT track_id, NULL, NULL, NULL, NULL, NULL, NULL, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM ranked WHERE rank > 20""")
def selected_sample_files(spark, sf_dir):
    """The best of each track through a CSV file, all its columns, with the others as debug samples beside them; a line's
    tracker id is missing where it is that of the track."""
    n = F.col("l_linenumber")
    part = lambda c: F.col(c).cast("string")
    s = X.ranked(spark, sf_dir).withColumns({
        "byte_track_id": F.when(n > 1, n), "frame_idx": F.col("frame_idx").cast("int"), "reason": F.when(F.col("picked"), "picked").otherwise("rejected_quality"), "association_iou": F.when(n < 5, F.col("l_quantity") / 64),
        "path": F.concat(F.lit("track_"), part("track_id"), F.lit("/f"), part("frame_idx"), F.lit("_"), part("l_linenumber"), F.lit("_"), part("l_partkey"), F.lit(".jpg")),
        "match_mode": F.col("l_returnflag"), "frame_offset": (n - 3).cast("int"), "identity_cosine": F.col("l_quantity") / 50, "similarity_to_centroid": F.col("l_quantity") / 51, "provider": F.col("l_linestatus"), "recall_only": n == 2,
    })
    at = _fresh(spark, "selected_samples.csv")
    sinks.selected_samples(s, ["track_id"], at, ties=X.TIES)
    back = readers.selected_samples(spark, at).drop("orientation")
    rest = X.ranked(spark, sf_dir).where("rank > 20").select("track_id", F.lit(False).alias("picked"))
    both = rounded(readers.all_samples(back, rest), 9, "quality")
    return rounded(both, 6, "sharpness", "frontalness", "area_frac", "association_iou", "identity_cosine", "similarity_to_centroid")


@query("""SELECT cluster_id, CAST(unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS INT) AS track_id, len(t) AS n FROM
(SELECT coalesce(cluster_id, 0) AS cluster_id, coalesce(t, []) AS t FROM (SELECT 0 AS z) FULL JOIN (SELECT s_nationkey AS cluster_id, list_sort(list(DISTINCT s_suppkey)) AS t FROM supplier WHERE s_nationkey > 0 GROUP BY s_nationkey) ON cluster_id = z)""")
def cluster_files(spark, sf_dir):
    """Bucket 0 comes back although nothing is in it."""
    m = table(spark, sf_dir, "supplier").where("s_nationkey > 0").select(F.col("s_nationkey").cast("int").alias("cluster_id"), F.col("s_suppkey").cast("int").alias("track_id"))
    at = _fresh(spark, "clusters.json")
    sinks.clusters(m, at)
    lists = readers.cluster_lists(spark, at)
    return lists.select("cluster_id", F.explode_outer("tracks").alias("track_id"), F.size("tracks").cast("long").alias("n"))


_BOXES = "round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2"


@query(f"""WITH {X.DET} SELECT 'debug' AS source, frame_idx, track_id, kind AS label, CASE WHEN kind = 'face' THEN 'rejected_area' ELSE 'picked' END AS reason, round(score, 6) AS score, {_BOXES} FROM det
UNION ALL SELECT 'tracks', frame_idx, track_id, kind, 'track', round(score, 6), {_BOXES} FROM det""")
def event_files(spark, sf_dir):
    """Events through the debug log; and, as another run has none, through its annotations."""
    b = F.col("bbox")
    d = X.detections(spark, sf_dir).select("frame_idx", "track_id", F.array(b.x1, b.y1, b.x2, b.y2).alias("bbox"), F.col("kind").alias("label"), F.when(F.col("kind") == "face", "rejected_area").otherwise("picked").alias("reason"), "score")
    log, notes = _fresh(spark, "harvest_debug.json"), _fresh(spark, "annotations")
    sinks.frame_events(d, log)
    sinks.annotations(d.drop("reason"), notes)
    found = [readers.events_or_annotations(spark, x, f"{notes}/frames").withColumn("source", F.lit(n)) for n, x in (("debug", log), ("tracks", log + ".none"))]
    both = found[0].unionByName(found[1]).select("source", "frame_idx", "track_id", "label", "reason", "score", "bbox.*")
    return rounded(both, 6, "score", "x1", "y1", "x2", "y2")


@query(f"WITH {X.SEG} SELECT track_id, subtrack_id, label, frames, CAST(trunc(start_ms / 1000 * 30.0::DOUBLE) AS BIGINT) AS start_frame, CAST(trunc(end_ms / 1000 * 30.0::DOUBLE) AS BIGINT) AS end_frame, round(avg_similarity, 6) AS avg_similarity FROM seg")
def annotation_segment_files(spark, sf_dir):
    at = _fresh(spark, "annotations")
    seg = X.segments(spark, sf_dir)
    frames = X.obs(spark, sf_dir).select("frame_idx", "track_id", F.array().cast("array<double>").alias("bbox"), "label", "score")
    sinks.annotations(frames, at, seg, 30.0)
    back = spark.read.schema("track_id long, subtrack_id int, label string, frames long, start_frame long, end_frame long, avg_similarity double").json(f"{at}/segments")
    return rounded(back, 6, "avg_similarity")


@query("""SELECT l_orderkey AS frame_idx, l_suppkey AS track_id, upper(l_returnflag) AS label, l_tax AS score FROM lineitem WHERE upper(l_returnflag) IN ('A', 'R') AND l_tax >= 0.04""")
def lowconf_files(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame_idx"), F.col("l_suppkey").alias("track_id"), F.lower("l_returnflag").alias("label"), F.col("l_tax").alias("score"))
    at = _fresh(spark, "lowconf.csv")
    sinks.csv(li, at)
    return readers.low_confidence(spark, at, ["A", "R"], 0.04)


@query(f"WITH {X.SEG} SELECT label, round(sum(duration_ms), 3) AS duration_ms FROM seg GROUP BY label")
def totals_files(spark, sf_dir):
    """Totals from JSON to CSV and back."""
    from dwell.operators import segments as S

    json, csv = _fresh(spark, "totals.json"), _fresh(spark, "totals.csv")
    S.totals(X.segments(spark, sf_dir)).withColumnRenamed("total_ms", "duration_ms").write.json(json)
    sinks.totals_json_to_csv(readers.totals(spark, json), csv)
    return rounded(spark.read.schema("label string, duration_ms double").option("header", True).csv(csv), 3, "duration_ms")


@query(f"WITH {X.DET} SELECT frame_idx, det_idx, kind, round(score, 6) AS score, {_BOXES} FROM det WHERE frame_idx % 3 = 0")
def detection_files(spark, sf_dir):
    """Detections through Parquet, every third frame read."""
    at = _fresh(spark, "detections")
    X.detections(spark, sf_dir).select(F.lit("v").alias("video_id"), F.col("frame_idx").cast("int").alias("frame_idx"), "det_idx", "kind", "bbox", "score").write.parquet(at)
    read = readers.detections(spark, at, 3).select("frame_idx", "det_idx", "kind", "score", "bbox.*")
    return rounded(read.withColumn("frame_idx", F.col("frame_idx").cast("long")), 6, "score", "x1", "y1", "x2", "y2")


@query(f"""WITH {X.BANK} SELECT 'bank' AS part, label, n AS count, pos, round(CAST(x AS FLOAT), 5) AS x FROM (SELECT label, n, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS pos FROM bank)
UNION ALL SELECT 'samples', label, count(*), NULL, NULL FROM vec GROUP BY label UNION ALL SELECT 'meta', label, n, NULL, NULL FROM bank UNION ALL SELECT 'labels', NULL, count(*), NULL, NULL FROM bank""")
def facebank_files(spark, sf_dir):
    """A bank, its samples and its summary, written and read back."""
    from dwell.operators import vectors as V

    v = X.vectors(spark, sf_dir).withColumn("path", F.concat(F.lit("p"), F.col("sample_id").cast("string")))
    at = _fresh(spark, "bank")
    sinks.facebank(V.facebank(v), v, at)
    none = lambda t: F.lit(None).cast(t)
    row = lambda df, part, label, n, pos=None, x=None: df.select(F.lit(part).alias("part"), label.alias("label"), n.cast("long").alias("count"), (none("int") if pos is None else pos).alias("pos"), (none("double") if x is None else x).alias("x"))
    bank = readers.facebank(spark, f"{at}/facebank.parquet").select("label", "count", F.posexplode("embedding").alias("pos", "x"))
    samples = spark.read.option("header", True).csv(f"{at}/samples.csv").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    meta = readers.facebank_meta(spark, f"{at}/facebank_meta.json")
    each = meta.select(F.explode("counts").alias("label", "n"))
    out = row(bank, "bank", F.col("label"), F.col("count"), F.col("pos"), F.round(F.col("x").cast("double"), 5))
    for more in (row(samples, "samples", F.col("label"), F.col("n")), row(each, "meta", F.col("label"), F.col("n")), row(meta, "labels", none("string"), F.col("num_labels"))):
        out = out.unionByName(more)
    return out


@query("""WITH l AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, list('s' || l_linenumber || '_' || l_partkey || '>' || 'd' || l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS f FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT 'ep' AS stem, CASE WHEN o_orderstatus = 'O' THEN -1 ELSE o_custkey % 7 END AS harvest_id, o_custkey AS byte_track_id, o_orderpriority AS person, array_to_string(f, ',') AS files FROM l""")
def assignment_files(spark, sf_dir):
    """A log of orders with ids as text, appended twice by entry: what is read back is there once."""
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("k")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("k")).alias("k"))
    s = lambda *c: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in c))
    listed = files.select("l_orderkey", F.transform("k", lambda x: F.struct(s("s", x.l_linenumber.cast("string"), "_", x.l_partkey.cast("string")).alias("source"), s("d", x.l_suppkey.cast("string")).alias("dest"))).alias("files"))
    o = table(spark, sf_dir, "orders").join(listed, F.col("l_orderkey") == F.col("o_orderkey"))
    log = o.select(
        F.lit("ep").alias("stem"), F.when(F.col("o_orderstatus") == "O", "none").otherwise((F.col("o_custkey") % 7).cast("string")).alias("harvest_id"), F.col("o_custkey").cast("string").alias("byte_track_id"), F.col("o_orderpriority").alias("person"), "files",
        F.col("o_orderdate").cast("timestamp").alias("when"), F.col("o_orderkey").cast("string").alias("entry_id"),
    )
    at = _fresh(spark, "assignments.jsonl")
    sinks.append_assignments(log, at)
    sinks.append_assignments(log, at)
    back = readers.assignments(spark, at)
    return back.select("stem", "harvest_id", "byte_track_id", "person", F.array_join(F.transform("files", lambda f: s(f.source, ">", f.dest)), ",").alias("files"))


@query("SELECT c_custkey AS frames_total, c_custkey // 3 AS frames_done, CASE WHEN c_nationkey < 20 THEN round(c_acctbal, 2) END AS percent, CASE WHEN c_nationkey < 12 THEN c_nationkey ELSE 0 END AS tracks FROM customer")
def progress_files(spark, sf_dir):
    """A document a customer, numbers as text, some missing or none."""
    c = table(spark, sf_dir, "customer")
    text = lambda x: x.cast("string")
    docs = c.select(text(F.col("c_custkey")).alias("frames_total"), (F.col("c_custkey") / 3).alias("frames_done"), F.when(F.col("c_nationkey") < 20, text(F.round("c_acctbal", 2))).otherwise("soon").alias("percent"), F.when(F.col("c_nationkey") < 12, F.col("c_nationkey")).alias("tracks"))
    at = _fresh(spark, "progress")
    docs.write.json(at)
    return readers.progress(spark, at).drop("raw")


@query(f"""WITH {X.SEG_FAST}, n AS (SELECT count(*) AS n, round(sum(duration_ms), 3) AS s FROM seg), t AS (SELECT label, round(sum(duration_ms), 3) AS s, count(*) AS n FROM seg GROUP BY label)
SELECT 'totals' AS part, label, 0 AS n, s FROM t UNION ALL SELECT 'totals_json', label, 0, s FROM t UNION ALL SELECT 'segments', label, n, s FROM t UNION ALL SELECT 'tracks', label, n, s FROM t
UNION ALL SELECT 'timeline', NULL, 8784, 0 UNION ALL SELECT 'track_timeline', label, count(*), 0 FROM (SELECT label, unnest(generate_series(greatest(CAST(floor(start_ms / 1000) AS BIGINT), 0), least(CAST(ceil(end_ms / 1000) AS BIGINT), 8784) - 1)) FROM seg) GROUP BY label""")
def tracker_files(spark, sf_dir):
    """All files of a tracker run, each counted by label."""
    seg = X.segments(spark, sf_dir, X.FAST)
    at = _fresh(spark, "run")
    sinks.tracker_outputs(seg, ["track_id", "subtrack_id"], 8784, X.LABELS, at)
    csv = lambda n: spark.read.option("header", True).csv(f"{at}/{n}.csv")
    ms = lambda c: F.round(F.sum(F.col(c).cast("double")), 3)
    zero, count = F.lit(0).cast("long"), F.count(F.lit(1))
    parts = [
        csv("totals").groupBy("label").agg(zero.alias("n"), ms("total_ms").alias("s")), spark.read.schema("label string, total_ms double").json(f"{at}/totals.json").groupBy("label").agg(zero.alias("n"), ms("total_ms").alias("s")),
        csv("segments").groupBy("label").agg(count.alias("n"), ms("duration_ms").alias("s")), csv("tracks").groupBy("label").agg(count.alias("n"), ms("duration_ms").alias("s")),
        csv("timeline").select(F.lit(None).cast("string").alias("label")).groupBy("label").agg(count.alias("n"), F.lit(0.0).alias("s")), csv("track_timeline").groupBy("label").agg(count.alias("n"), F.lit(0.0).alias("s")),
    ]
    named = [p.withColumn("part", F.lit(n)) for p, n in zip(parts, ("totals", "totals_json", "segments", "tracks", "timeline", "track_timeline"), strict=True)]
    out = named[0]
    for more in named[1:]:
        out = out.unionByName(more)
    return out


@query(f"WITH {X.DET} SELECT frame_idx, track_id, kind AS label, round(score, 6) AS score, {_BOXES} FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx, track_id ORDER BY det_idx DESC) AS rn FROM det) WHERE rn = 1")
def annotation_index_files(spark, sf_dir):
    """Annotations by frame: of several of a track the last."""
    b = F.col("bbox")
    d = X.detections(spark, sf_dir).select("frame_idx", F.struct("det_idx", "track_id", F.array(b.x1, b.y1, b.x2, b.y2).alias("bbox"), F.col("kind").alias("label"), "score").alias("a"))
    lists = d.groupBy("frame_idx").agg(F.transform(F.array_sort(F.collect_list("a")), lambda a: a.dropFields("det_idx")).alias("list"))
    at = _fresh(spark, "annotations.json")
    lists.select(F.create_map(F.col("frame_idx").cast("string"), "list").alias("frame_annotations")).write.json(at)
    i = readers.annotation_index(spark, at)
    return rounded(i.select(F.col("frame_idx").cast("long").alias("frame_idx"), "track_id", "label", "score", "bbox.*"), 6, "score", "x1", "y1", "x2", "y2")


@query("""WITH s AS (SELECT o_orderkey AS k, o_custkey AS t, CASE o_orderkey % 6 WHEN 0 THEN '/h/track_' || o_custkey || '/f' || o_orderkey || '.png' WHEN 1 THEN 'track_' || o_custkey || '/f' || o_orderkey || '.png' WHEN 2 THEN '/old/h/track_' || o_custkey || '/f' || o_orderkey || '.png' ELSE 'gone/f' || o_orderkey || '.png' END AS path FROM orders)
SELECT k, path, CASE WHEN k % 6 < 3 THEN '/h/track_' || t || '/f' || k || '.png' WHEN k % 6 = 3 THEN '/h/candidates/track_' || printf('%04d', t) || '/F' || printf('%06d', k) || '.jpg' WHEN k % 6 = 4 THEN '/h/track_' || printf('%04d', t) || '/debug/f' || k || '.png' END AS resolved FROM s""")
def path_cascade(spark, sf_dir):
    """Paths of orders against a listing of all of them: as they are, below the harvest, by their track, as candidate or
    debug crop, and not there."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_idx"), F.col("o_custkey").alias("track_id"))
    k, t = F.col("frame_idx").cast("string"), F.col("track_id").cast("string")
    own, kind = F.concat(F.lit("track_"), t, F.lit("/f"), k, F.lit(".png")), F.col("frame_idx") % 6
    path = F.when(kind == 0, F.concat(F.lit("/h/"), own)).when(kind == 1, own).when(kind == 2, F.concat(F.lit("/old/h/"), own)).otherwise(F.concat(F.lit("gone/f"), k, F.lit(".png")))
    there = F.when(kind < 3, F.concat(F.lit("file:/h/"), own)).when(kind == 3, F.format_string("file:/h/candidates/track_%04d/F%06d.jpg", "track_id", "frame_idx")).when(kind == 4, F.concat(F.format_string("file:/h/track_%04d/debug/f", "track_id"), k, F.lit(".png")))
    found = readers.resolve_paths(o.withColumn("path", path), o.select(there.alias("path")).where("path IS NOT NULL"), "/h")
    return found.select(F.col("frame_idx").alias("k"), "path", "resolved")


@query(f"""WITH sc AS (SELECT c_custkey AS s, c_custkey * 10 AS a, c_custkey * 10 + c_nationkey AS b FROM customer), {X.DET}, f AS (SELECT frame_idx, det_idx, round_even(x1, 0) AS x1, round_even(y1, 0) AS y1, round_even(x2, 0) AS x2, round_even(y2, 0) AS y2, score FROM det WHERE kind = 'face')
SELECT 'scene' AS part, s AS scene_idx, a AS frame_idx, b AS x2, NULL AS conf, NULL AS rel_path FROM sc UNION ALL
SELECT 'face', frame_idx % 9 - 1, frame_idx, CAST(x2 AS BIGINT), round(score, 6), 'candidates/' || CASE WHEN frame_idx % 9 = 0 THEN 'noscenes' ELSE 'scene_' || printf('%04d', frame_idx % 9 - 1) END || '/F' || printf('%06d', frame_idx) || '_C' || printf('%02d', det_idx) || '.jpg' FROM f
  WHERE (x2 - x1) * (y2 - y1) / (640 * 480) >= 0.02 AND least(x2, 640) > greatest(x1, 0) AND least(y2, 480) > greatest(y1, 0)""")
def scene_files(spark, sf_dir):
    """Scenes and candidates through their files."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scene_idx"), (F.col("c_custkey") * 10).alias("start_frame"), (F.col("c_custkey") * 10 + F.col("c_nationkey")).alias("end_frame"))
    faces = X.detections(spark, sf_dir).where("kind = 'face'").withColumn("scene_idx", F.col("frame_idx") % 9 - 1)
    scenes, found = _fresh(spark, "scenes.csv"), _fresh(spark, "candidates.csv")
    sinks.scenes(c, scenes)
    sinks.candidates(faces, found, X.WIDTH, X.HEIGHT, 0.02)
    long = lambda c: F.col(c).cast("long")
    a = readers.scenes(spark, scenes).select(F.lit("scene").alias("part"), long("scene_idx").alias("scene_idx"), long("start_frame").alias("frame_idx"), long("end_frame").alias("x2"), F.lit(None).cast("double").alias("conf"), F.lit(None).cast("string").alias("rel_path"))
    b = readers.candidates(spark, found).select(F.lit("face").alias("part"), long("scene_idx").alias("scene_idx"), long("frame_idx").alias("frame_idx"), long("x2").alias("x2"), F.round("conf", 6).alias("conf"), "rel_path")
    return a.unionByName(b)


@query("""SELECT s_nationkey - 3 AS cluster_id, CASE WHEN s_nationkey >= 3 THEN s_nationkey - 3 ELSE (SELECT max(s_nationkey) - 3 FROM supplier) + row_number() OVER (PARTITION BY s_nationkey < 3 ORDER BY s_suppkey) END AS track_id, s_suppkey AS frame_idx,
'clusters/' || CASE WHEN s_nationkey >= 3 THEN 'cluster_' || printf('%04d', s_nationkey - 3) ELSE 'noise' END || '/f' || s_suppkey || '.jpg' AS cluster_rel_path FROM supplier""")
def preview_files(spark, sf_dir):
    """Clusters of a preview through their file; suppliers of the first nations are noise."""
    m = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") - 3).alias("cluster_id"), F.lit(0).alias("scene_idx"), F.col("s_suppkey").alias("frame_idx"), F.concat(F.lit("candidates/f"), F.col("s_suppkey").cast("string"), F.lit(".jpg")).alias("rel_path"))
    at = _fresh(spark, "clusters.parquet")
    sinks.preview(m, "/out", at)
    return readers.preview(spark, at).select(F.col("cluster_id").cast("long").alias("cluster_id"), "track_id", F.col("frame_idx").cast("long").alias("frame_idx"), "cluster_rel_path")


@query(f"""WITH {X.RANKED} SELECT track_id, 'track_' || track_id || '/f' || frame_idx || '_' || rank || '.jpg' AS path FROM ranked WHERE l_linenumber < 6 UNION ALL SELECT track_id, 'f' || frame_idx || '_' || rank || '.jpg' FROM ranked WHERE l_linenumber >= 6""")
def nested_paths(spark, sf_dir):
    """A manifest with paths of another place, written, read and made relative to its tracks."""
    s = X.ranked(spark, sf_dir)
    name = F.concat(F.lit("f"), F.col("frame_idx").cast("string"), F.lit("_"), F.col("rank").cast("string"), F.lit(".jpg"))
    track = F.concat(F.when(F.col("l_linenumber") < 3, "").otherwise("/data/harvest/ep/"), F.lit("track_"), F.col("track_id").cast("string"), F.lit("/"))
    path = F.concat(F.when(F.col("l_linenumber") < 6, track).otherwise("/elsewhere/"), name)
    samples = s.select("track_id", F.col("frame_idx").cast("int").alias("frame_idx"), path.alias("path"))
    at = _fresh(spark, "manifest.json")
    sinks.manifest(samples.select("track_id").distinct(), samples, ["track_id"], at)
    return readers.samples_of_manifest(readers.relative_paths(readers.manifest(spark, at))).select("track_id", "path")


@query(f"WITH {X.DET} SELECT frame_idx, det_idx, kind, round(score, 6) AS score, {_BOXES} FROM det WHERE frame_idx % 3 = 0 AND frame_idx >= 900 AND track_id % 3 <> 1")
def detection_source(spark, sf_dir):
    """The same through the data source by frames, from a frame on and of two classes."""
    from dwell.sources import folders, frames

    at = _fresh(spark, "detections")
    d = X.detections(spark, sf_dir).withColumn("video_id", F.lit("v")).withColumn("frame_idx", F.col("frame_idx").cast("int")).withColumn("class_id", (F.col("track_id") % 3).cast("int"))
    own = T_.StructType.fromDDL(schemas.DETECTIONS)
    # files of neighbouring frames, so that a range of frames is in few of them
    d = d.repartitionByRange("frame_idx").sortWithinPartitions("frame_idx")
    d.select(*((F.col(f.name) if f.name in d.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in own)).write.parquet(at)
    frames.register(spark)
    read = spark.read.format(frames.NAME).options(**{"path": folders.qualified(spark, at), "stride": 3, "from": 900, "classes": "0,2"}).load()
    return rounded(read.select(F.col("frame_idx").cast("long").alias("frame_idx"), "det_idx", "kind", "score", "bbox.*"), 6, "score", "x1", "y1", "x2", "y2")
