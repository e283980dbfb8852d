"""Summaries, assignments, validation and cluster bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.functions import text as T
from dwell.operators import review as R
from dwell.plans import fixtures as X
from dwell.plans.base import query, rounded, table

_K = ["track_id"]
_SUM = f"""{X.RANKED}, sm AS (SELECT track_id, count(*) AS n_samples, count(*) FILTER (WHERE picked) AS picked, count(*) FILTER (WHERE NOT picked) AS rejected, avg(quality) AS avg_quality, median(quality) AS median_quality, max(quality) AS max_quality
  FROM ranked GROUP BY track_id),
mf AS (SELECT c_custkey AS track_id, c_nationkey AS cluster_id, CAST(round_even(c_acctbal, 0) AS BIGINT) % 100 AS duration_frames FROM customer), asg AS (SELECT o_custkey AS track_id, count(*) AS assigned FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL),
ts AS (SELECT track_id, cluster_id, duration_frames, coalesce(n_samples, 0) AS n_samples, coalesce(picked, 0) AS picked, coalesce(rejected, 0) AS rejected, avg_quality, median_quality, max_quality, coalesce(assigned, 0) AS assigned
  FROM (mf FULL JOIN sm USING (track_id)) LEFT JOIN asg USING (track_id)),
st AS (SELECT *, CASE WHEN assigned = 0 THEN 'Unassigned' WHEN picked > 0 AND assigned >= picked THEN 'Assigned' ELSE 'Partially' END AS status FROM ts)"""
_Q = ["avg_quality", "median_quality", "max_quality"]
_STATUS = "track_id, cluster_id, duration_frames, n_samples, picked, rejected, assigned, status, " + ", ".join(f"round({q}, 6) AS {q}" for q in _Q)


def _summary(spark, sf_dir):
    """A manifest of customers with the samples of suppliers: most customers have no samples, as their keys go further."""
    manifest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track_id"), F.col("c_nationkey").alias("cluster_id"), (F.bround("c_acctbal", 0).cast("long") % 100).alias("duration_frames"))
    assigned = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("track_id")).agg(F.count(F.lit(1)).alias("assigned"))
    return R.track_summary(manifest, R.sample_summary(X.ranked(spark, sf_dir), _K), assigned, _K)


@query(f"WITH {_SUM} SELECT {_STATUS} FROM st")
def track_summary(spark, sf_dir):
    return rounded(_summary(spark, sf_dir), 6, *_Q)


@query(f"WITH {_SUM} SELECT {_STATUS} FROM st WHERE picked >= 5 AND coalesce(duration_frames, 0) >= 10 AND coalesce(max_quality, 0) >= 0.5 AND regexp_matches(CAST(track_id AS VARCHAR), '1|3')")
def status_filter(spark, sf_dir):
    return rounded(R.filter_tracks(_summary(spark, sf_dir), 5, 10, 0.5, "1|3"), 6, *_Q)


@query(f"WITH {X.RANKED} SELECT track_id, frame_idx, l_linenumber, l_partkey, picked FROM ranked WHERE track_id = 7")
def samples_for_track(spark, sf_dir):
    s = X.ranked(spark, sf_dir).withColumn("is_debug", F.lit(False))
    return R.samples_of(s, _K, {"track_id": 7}).select("track_id", "frame_idx", "l_linenumber", "l_partkey", "picked")


@query("SELECT user_id AS track_id, event_type AS byte_id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1")
def modal_ids(spark, sf_dir):
    return R.mode(table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("event_type").alias("byte_id")), _K, "byte_id")


@query(f"""WITH {X.DET} SELECT track_id, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, max(frame_idx) - min(frame_idx) + 1 AS duration_frames, round(avg(score), 6) AS avg_score, round(avg((x2 - x1) * (y2 - y1)), 4) AS avg_area,
min(frame_idx) * 40.0::DOUBLE AS first_ts, max(frame_idx) * 40.0::DOUBLE AS last_ts FROM det WHERE kind = 'person' GROUP BY track_id""")
def track_stats(spark, sf_dir):
    from dwell.functions import geometry as G

    o = X.detections(spark, sf_dir).where("kind = 'person'").select("track_id", "frame_idx", "score", G.area(F.col("bbox")).alias("area"), (F.col("frame_idx") * 40.0).alias("ts_ms"))
    return rounded(rounded(R.track_stats(o, _K), 6, "avg_score"), 4, "avg_area")


def _log(spark, sf_dir):
    """An assignment log: an order is an entry, its lines are files."""
    src = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", F.concat(F.lit("s"), (F.col("l_partkey") % 40).cast("string")).alias("source"), F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("dest")).alias("f"))
    files = src.groupBy("o_orderkey").agg(F.transform(F.array_sort(F.collect_set("f")), lambda f: F.struct(f.source.alias("source"), f.dest.alias("dest"))).alias("files"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("track_id"), F.col("o_orderpriority").alias("person"))
    return o.join(files, "o_orderkey", "left").select("track_id", "person", F.col("o_orderkey").alias("when"), "files")


_LOG = """fl AS (SELECT DISTINCT l_orderkey, l_linenumber, 's' || (l_partkey % 40) AS source, 'd' || l_suppkey AS dest FROM lineitem),
fe AS (SELECT l_orderkey, source, dest, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, source, dest) - 1 AS pos FROM fl),
lg AS (SELECT o_custkey % 50 AS track_id, o_orderpriority AS person, o_orderkey AS t, pos, source, dest FROM orders LEFT JOIN fe ON l_orderkey = o_orderkey)"""


@query(f"""WITH {_LOG}, p AS (SELECT track_id, string_agg(person, ',' ORDER BY k) AS persons FROM (SELECT track_id, person, min(t) AS k FROM lg GROUP BY ALL) GROUP BY track_id),
s AS (SELECT track_id, string_agg(source, ',' ORDER BY k, pos) AS sources FROM (SELECT track_id, source, t AS k, pos, row_number() OVER (PARTITION BY track_id, source ORDER BY t, pos) AS rn FROM lg WHERE source IS NOT NULL) WHERE rn = 1 GROUP BY track_id),
d AS (SELECT track_id, count(DISTINCT dest) AS n_dest FROM lg GROUP BY track_id),
w AS (SELECT track_id, string_agg(source || '=' || person, ',' ORDER BY source) AS owners FROM (SELECT track_id, source, person, row_number() OVER (PARTITION BY track_id, source ORDER BY t, pos) AS rn FROM lg WHERE source IS NOT NULL) WHERE rn = 1 GROUP BY track_id)
SELECT track_id, persons, sources, n_dest, owners FROM p LEFT JOIN s USING (track_id) LEFT JOIN d USING (track_id) LEFT JOIN w USING (track_id)""")
def assignment_index(spark, sf_dir):
    i = R.assignment_index(_log(spark, sf_dir), _K)
    owners = F.array_join(F.transform(F.array_sort(F.map_entries("source_person")), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    return i.select("track_id", F.array_join("persons", ",").alias("persons"), F.array_join("sources", ",").alias("sources"), F.size("destinations").cast("long").alias("n_dest"), owners.alias("owners"))


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(upper(trim({x})), '\\s+', '_', 'g'), '[^A-Z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g'))"


@query(f"SELECT c_custkey AS id, {_NORM.format(x='c_name')} AS label FROM customer UNION ALL SELECT p_partkey + 1000000, {_NORM.format(x='p_name')} FROM part UNION ALL SELECT s_suppkey + 2000000, {_NORM.format(x='s_name')} FROM supplier")
def label_normalize(spark, sf_dir):
    names = [table(spark, sf_dir, t).select((F.col(f"{t[0]}_{k}") + o).alias("id"), F.col(f"{t[0]}_name").alias("n")) for t, k, o in (("customer", "custkey", 0), ("part", "partkey", 1000000), ("supplier", "suppkey", 2000000))]
    return names[0].unionByName(names[1]).unionByName(names[2]).select("id", T.normalize_label(F.col("n")).alias("label"))


@query("""SELECT c_custkey, 'ep_H' || printf('%04d', c_custkey % 300) || '_B' || printf('%04d', c_nationkey) || '_F' || c_custkey || '_' || substr(sha1('x/' || c_name || '_f' || c_custkey || '.jpg'), 1, 8) || '.jpg' AS name FROM customer""")
def destination_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("path", F.concat(F.lit("x/"), "c_name", F.lit("_f"), F.col("c_custkey").cast("string"), F.lit(".jpg")))
    return c.select("c_custkey", T.destination_name(F.lit("ep"), F.col("c_custkey") % 300, F.col("c_nationkey"), T.frame_of(F.col("path")).cast("string"), F.col("path"), F.lit(".jpg")).alias("name"))


@query("SELECT c_custkey, CAST('0x' || substr(md5(c_name), 1, 2) AS INT) AS b, CAST('0x' || substr(md5(c_name), 3, 2) AS INT) AS g, CAST('0x' || substr(md5(c_name), 5, 2) AS INT) AS r FROM customer")
def label_colours(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.label_colour(F.col("c_name")).alias("c")).select("c_custkey", "c.*")


@query("""WITH rq AS (SELECT o_orderkey AS source, o_custkey AS dest FROM orders), dn AS (SELECT o_orderkey AS source FROM orders WHERE o_orderstatus = 'P')
SELECT source, dest, CASE WHEN source IN (SELECT source FROM dn) THEN 'already_assigned' WHEN row_number() OVER (PARTITION BY dest ORDER BY source) > 1 THEN 'duplicate_destination' END AS skipped FROM rq""")
def already_assigned(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return R.new_assignments(o.select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("dest")), o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("source")))


def _files(spark, sf_dir):
    """All samples, by supplier, and an image for each order, by customer: few of their paths are the same."""
    p = lambda c: F.concat(F.lit("track_"), F.col("track_id").cast("string"), F.lit("/f"), c.cast("string"))
    samples = X.ranked(spark, sf_dir).withColumn("path", p(F.col("frame_idx")))
    images = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("frame_idx"))
    return samples, images.select("track_id", p(F.col("frame_idx")).alias("path")).distinct()


_FILES = f"""{X.RANKED}, sp AS (SELECT *, 'track_' || track_id || '/f' || frame_idx AS path FROM ranked),
im AS (SELECT DISTINCT o_custkey AS track_id, 'track_' || o_custkey || '/f' || o_orderkey AS path FROM orders)"""


@query(f"""WITH {_FILES}, o AS (SELECT track_id, count(*) AS n_samples, count(*) FILTER (WHERE picked) AS picked, avg(quality) AS avg_quality FROM sp GROUP BY track_id),
mi AS (SELECT track_id, count(*) AS missing FROM sp WHERE path NOT IN (SELECT path FROM im) GROUP BY track_id), ex AS (SELECT track_id, count(*) AS extra FROM im WHERE path NOT IN (SELECT path FROM sp) GROUP BY track_id)
SELECT track_id, coalesce(n_samples, 0) AS n_samples, coalesce(picked, 0) AS picked, round(avg_quality, 6) AS avg_quality, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra FROM (o LEFT JOIN mi USING (track_id)) FULL JOIN ex USING (track_id)""")
def validation_summary(spark, sf_dir):
    v = R.validation(*_files(spark, sf_dir), _K)
    return rounded(v.select("track_id", "n_samples", "picked", "avg_quality", "missing", "extra"), 6, "avg_quality")


@query(f"""WITH {_FILES}, a AS (SELECT DISTINCT path FROM sp), b AS (SELECT path FROM im)
SELECT path, 'left' AS side FROM a WHERE path NOT IN (SELECT path FROM b) UNION ALL SELECT path, 'right' FROM b WHERE path NOT IN (SELECT path FROM a)""")
def missing_vs_disk(spark, sf_dir):
    samples, images = _files(spark, sf_dir)
    return R.symmetric_difference(samples.select("path"), images.select("path"))


_CL = "cl AS (SELECT DISTINCT l_suppkey AS cluster_id, l_orderkey AS track_id FROM lineitem)"


def _clusters(spark, sf_dir):
    """A cluster for each supplier and a track for each order, of all lines."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster_id"), F.col("l_orderkey").alias("track_id")).distinct()


@query(f"WITH {_CL} SELECT cluster_id, track_id FROM cl WHERE track_id <> 42 UNION SELECT 3, 42")
def cluster_move(spark, sf_dir):
    return R.move_track(_clusters(spark, sf_dir), 42, 3)


@query(f"""WITH {_CL}, s AS (SELECT cluster_id FROM cl GROUP BY cluster_id HAVING count(*) >= 15), n AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS new_id FROM s)
SELECT cluster_id, track_id, new_id FROM cl LEFT JOIN n USING (cluster_id)""")
def cluster_reindex(spark, sf_dir):
    kept, flagged = R.reindex_clusters(_clusters(spark, sf_dir), 15)
    return kept.select("cluster_id", "track_id", "new_id").unionByName(flagged.select("cluster_id", "track_id"), allowMissingColumns=True)


@query(f"""WITH {X.RANKED}, g AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS kept FROM ranked WHERE picked AND sharpness >= 90 AND round(area_frac, 9) >= 0.01) SELECT track_id, frame_idx, l_linenumber, l_partkey, kept FROM g WHERE kept >= 3""")
def cluster_inputs(spark, sf_dir):
    s = rounded(X.ranked(spark, sf_dir), 9, "area_frac").withColumn("is_debug", F.lit(False))
    return R.cluster_inputs(s, 90.0, 0.01, 3).select("track_id", "frame_idx", "l_linenumber", "l_partkey", "kept")


@query(f"WITH {_SUM} SELECT track_id, status FROM st")
def review_queue(spark, sf_dir):
    return R.review_order(_summary(spark, sf_dir)).select("track_id", "status")


@query("""WITH sc AS (SELECT c_custkey AS scene_idx, c_custkey * 10 AS s, c_custkey * 10 + c_nationkey % 10 AS e FROM customer), f AS (SELECT scene_idx, unnest(generate_series(s, e)) AS frame_idx FROM sc),
n AS (SELECT l_orderkey AS frame_idx, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT scene_idx, CAST(coalesce(sum(c), 0) AS BIGINT) AS n FROM f LEFT JOIN n USING (frame_idx) GROUP BY scene_idx""")
def scene_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scene_idx"), (F.col("c_custkey") * 10).alias("start_frame"), (F.col("c_custkey") * 10 + F.col("c_nationkey") % 10).alias("end_frame"))
    return R.scene_counts(c, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame_idx")))


@query("""SELECT l_suppkey AS cluster_id, count(*) AS n, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS scenes, min(l_orderkey) AS first_frame, max(l_orderkey) AS last_frame FROM lineitem GROUP BY l_suppkey""")
def cluster_preview(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster_id"), F.col("l_linenumber").alias("scene_idx"), F.col("l_orderkey").alias("frame_idx"))
    return R.cluster_preview(m).withColumn("scenes", F.array_join(F.transform("scenes", lambda x: x.cast("string")), ","))


@query("""WITH lc AS (SELECT l_orderkey AS frame_idx, l_suppkey AS track_id, l_returnflag AS label, max(l_tax) AS score FROM lineitem WHERE upper(l_returnflag) IN ('A', 'R') AND l_tax >= 0.04 GROUP BY ALL),
an AS (SELECT DISTINCT l_orderkey AS frame_idx, l_suppkey + CASE WHEN l_discount > 0.02 THEN 0 ELSE 1 END AS track_id FROM lineitem) SELECT frame_idx, track_id, label, score FROM lc JOIN an USING (frame_idx, track_id)""")
def seed_candidates(spark, sf_dir):
    from dwell.functions.geometry import box

    li = table(spark, sf_dir, "lineitem")
    lc = li.select(F.col("l_orderkey").alias("frame_idx"), F.col("l_suppkey").alias("track_id"), F.col("l_returnflag").alias("label"), F.col("l_tax").alias("score"))
    # annotations of all lines, those of a small discount under another track
    an = li.select(F.col("l_orderkey").alias("frame_idx"), (F.col("l_suppkey") + F.when(F.col("l_discount") > 0.02, 0).otherwise(1)).alias("track_id")).distinct().withColumn("bbox", box(0, 0, 10, 10))
    return R.seed_candidates(lc, an, ["A", "R"], 0.04).drop("bbox")


_REPORT = f"""{X.RANKED}, im AS (SELECT DISTINCT o_custkey AS track_id, 'track_' || o_custkey || '/f' || o_orderkey AS path FROM orders),
mf AS (SELECT s_suppkey AS track_id, s_nationkey AS byte_track_id, CAST(s_nationkey AS VARCHAR) AS label, s_suppkey * 10 AS total_frames, s_suppkey * 40.0::DOUBLE AS first_ts_ms, s_suppkey * 40.0::DOUBLE + s_nationkey * 500 AS last_ts_ms FROM supplier),
sp AS (SELECT track_id, CASE WHEN l_linenumber < 7 THEN 'track_' || track_id || '/f' || frame_idx END AS path, quality, sharpness, frontalness, l_quantity AS score FROM ranked),
ok AS (SELECT sp.*, coalesce(path IN (SELECT path FROM im), false) AS there FROM sp), wp AS (SELECT * FROM ok WHERE path IS NOT NULL)"""


def _manifest(spark, sf_dir):
    """A manifest of suppliers with all samples nested, those of a last line without a path, and the images on disk."""
    path = F.when(F.col("l_linenumber") < 7, F.concat(F.lit("track_"), F.col("track_id").cast("string"), F.lit("/f"), F.col("frame_idx").cast("string")))
    s = X.candidates(spark, sf_dir).select("track_id", F.struct(path.alias("path"), "quality", "sharpness", "frontalness", F.col("l_quantity").alias("score")).alias("s"))
    nested = s.groupBy("track_id").agg(F.collect_list("s").alias("samples"))
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    tracks = table(spark, sf_dir, "supplier").select(
        k.alias("track_id"), n.alias("byte_track_id"), n.cast("string").alias("label"), (k * 10).alias("total_frames"), (k * 40.0).alias("first_ts_ms"), (k * 40.0 + n * 500).alias("last_ts_ms")
    )
    return tracks.join(nested, "track_id", "left"), _files(spark, sf_dir)[1]


@query(f"""WITH {_REPORT}, per AS (SELECT track_id, count(*) AS sample_count, count(*) FILTER (WHERE NOT there) AS missing_samples FROM ok GROUP BY track_id),
q AS (SELECT track_id, avg(quality) AS q, median(quality) AS m, avg(sharpness) AS s, avg(frontalness) AS f, avg(score) AS c FROM wp GROUP BY track_id), d AS (SELECT track_id, count(*) AS directory_images FROM im GROUP BY track_id)
SELECT track_id, byte_track_id, label, coalesce(sample_count, 0) AS sample_count, coalesce(missing_samples, 0) AS missing_samples, coalesce(directory_images, 0) AS directory_images, (last_ts_ms - first_ts_ms) / 1000 AS duration_seconds, total_frames,
round(q, 6) AS avg_quality, round(m, 6) AS median_quality, round(s, 6) AS avg_sharpness, round(f, 6) AS avg_frontalness, round(c, 6) AS avg_score FROM mf LEFT JOIN per USING (track_id) LEFT JOIN q USING (track_id) LEFT JOIN d USING (track_id)""")
def validation_report(spark, sf_dir):
    return rounded(R.validation_report(*_manifest(spark, sf_dir)), 6, "avg_quality", "median_quality", "avg_sharpness", "avg_frontalness", "avg_score")


@query(f"""WITH {_REPORT}, z AS (SELECT mf.track_id, count(sp.track_id) AS n FROM mf LEFT JOIN sp USING (track_id) GROUP BY mf.track_id)
SELECT metric, round(value, 6) AS value FROM (
SELECT unnest([{{'metric': 'total_tracks', 'value': count(*)::DOUBLE}}, {{'metric': 'total_samples', 'value': sum(n)::DOUBLE}}, {{'metric': 'samples_per_track_mean', 'value': avg(n)}}, {{'metric': 'samples_per_track_median', 'value': median(n)}}], recursive := true) FROM z
UNION ALL SELECT unnest([{{'metric': 'quality_mean', 'value': avg(quality)}}, {{'metric': 'quality_median', 'value': median(quality)}}, {{'metric': 'sharpness_mean', 'value': avg(sharpness)}}, {{'metric': 'frontalness_mean', 'value': avg(frontalness)}},
  {{'metric': 'score_mean', 'value': avg(score)}}, {{'metric': 'referenced_files', 'value': count(*)::DOUBLE}}, {{'metric': 'existing_files', 'value': (count(*) FILTER (WHERE there))::DOUBLE}}], recursive := true) FROM wp
UNION ALL SELECT 'extra_images', count(*) FROM im WHERE path NOT IN (SELECT path FROM wp)
UNION ALL SELECT 'extra_track_dirs', count(DISTINCT track_id) FROM im WHERE track_id NOT IN (SELECT track_id FROM mf) UNION ALL SELECT 'missing_track_dirs', count(*) FROM mf WHERE track_id NOT IN (SELECT track_id FROM im))""")
def validation_totals(spark, sf_dir):
    return rounded(R.validation_totals(*_manifest(spark, sf_dir)), 6, "value")


@query(f"""WITH {X.DET}, t AS (SELECT track_id, frame_idx // 1000 AS video, max(frame_idx) - min(frame_idx) + 1 AS n FROM det GROUP BY ALL) SELECT video, count(*) AS tracks, round(avg(n), 6) AS mean_frames, median(n)::DOUBLE AS median_frames FROM t GROUP BY video""")
def track_lengths(spark, sf_dir):
    from dwell.operators import segments as S

    d = X.detections(spark, sf_dir).withColumn("video", F.floor(F.col("frame_idx") / 1000)).groupBy("video", "track_id").agg((F.max("frame_idx") - F.min("frame_idx") + 1).alias("duration_frames"))
    return rounded(S.track_lengths(d, ["video"]), 6, "mean_frames")


@query("""WITH c AS (SELECT l_orderkey AS track_id, min(l_suppkey) AS cluster_id FROM lineitem GROUP BY ALL) SELECT o_orderkey AS track_id, cluster_id FROM orders LEFT JOIN c ON c.track_id = o_orderkey""")
def track_cluster_map(spark, sf_dir):
    return R.track_clusters(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("track_id")), _clusters(spark, sf_dir))


@query("""WITH s AS (SELECT o_orderkey AS frame_idx, o_custkey AS track_id, '/old/track_' || o_custkey || '/f' || o_orderkey || '.jpg' AS path FROM orders),
e AS (SELECT *, CASE WHEN frame_idx % 7 = 0 THEN 'delete' WHEN frame_idx % 7 = 1 THEN 'unassign' WHEN frame_idx % 7 = 2 THEN 'path_update' END AS a FROM s)
SELECT track_id, frame_idx, CASE WHEN a = 'path_update' THEN 'new/' || frame_idx ELSE path END AS path, coalesce(a, '') <> 'unassign' AS picked, CASE WHEN a = 'unassign' THEN 'manual_unassigned' ELSE 'picked' END AS reason FROM e WHERE coalesce(a, '') <> 'delete'""")
def sample_edits(spark, sf_dir):
    """Edits by track and frame, by a path written in another way, and by file name."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_idx"), F.col("o_custkey").alias("track_id"))
    name = F.concat(F.lit("f"), F.col("frame_idx").cast("string"), F.lit(".jpg"))
    folder = F.concat(F.lit("/old/track_"), F.col("track_id").cast("string"), F.lit("/"))
    samples = o.select("track_id", "frame_idx", F.concat(folder, name).alias("path"), F.lit(True).alias("picked"), F.lit("picked").alias("reason"))
    kind = F.col("frame_idx") % 7
    edits = o.where(kind <= 2).select(
        F.col("frame_idx").alias("edit_id"), F.when(kind == 0, F.col("track_id")).otherwise(-1).alias("track_id"), "frame_idx",
        F.when(kind == 1, F.concat(F.lit("file://"), folder, F.lit("./x/..//"), name)).otherwise(F.concat(F.lit("elsewhere/"), name)).alias("original_path"),
        F.element_at(F.array(F.lit("delete"), F.lit("unassign"), F.lit("path_update")), (kind + 1).cast("int")).alias("action"), F.when(kind == 2, F.concat(F.lit("new/"), F.col("frame_idx").cast("string"))).alias("new_path"),
    )
    return R.edit_samples(samples, edits)
