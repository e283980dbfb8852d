"""Vectors: centroids, nearest identities, medoids and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.operators import clustering as C
from dwell.operators import matching as M
from dwell.operators import vectors as V
from dwell.plans import fixtures as X
from dwell.plans.base import query, rounded

_RANK = f"""{X.BANK}, sc AS (SELECT s.sample_id, s.label, s.track_id, b.label AS match, list_dot_product(s.u, b.c) AS score FROM uv s, bank b),
rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, match) AS rank FROM sc)"""


@query(f"WITH {X.BANK} SELECT label, n AS count, pos, round(x, 6) AS x FROM (SELECT label, n, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS pos FROM bank)")
def facebank_centroids(spark, sf_dir):
    bank = V.facebank(X.vectors(spark, sf_dir))
    return rounded(bank.select("label", "count", F.posexplode("embedding").alias("pos", "x")), 6, "x")


def _ranked(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    return M.knn(v, V.facebank(v), 3)


@query(f"WITH {_RANK} SELECT sample_id, label, track_id, rank, match, round(score, 6) AS score FROM rk WHERE rank <= 3")
def knn_top3(spark, sf_dir):
    return rounded(_ranked(spark, sf_dir), 6, "score")


@query(f"""WITH {_RANK}, t AS (SELECT a.sample_id, a.match, a.score, b.score AS second FROM rk a LEFT JOIN rk b ON b.sample_id = a.sample_id AND b.rank = 2 WHERE a.rank = 1)
SELECT sample_id, CASE WHEN round(score, 6) >= CASE WHEN match = '3' THEN 0.25 ELSE 0.2 END AND round(score - second, 6) >= 0.02 THEN match END AS match, round(score, 6) AS score FROM t""")
def best_match(spark, sf_dir):
    return M.best_match(rounded(_ranked(spark, sf_dir), 6, "score").withColumn("score", F.round("score", 6)), ["sample_id"], 0.2, 0.02 - 1e-9, {"3": 0.25})


@query(f"WITH {_RANK} SELECT sample_id, match, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY rank) AS k FROM rk WHERE rank <= 3 AND match IN ('1', '4')) WHERE k = 1")
def lowconf_watch(spark, sf_dir):
    return rounded(M.watched(_ranked(spark, sf_dir), ["sample_id"], ["1", "4"]), 6, "score")


@query(f"""WITH {X.VEC}, c AS (SELECT a.track_id, a.sample_id, round(sum(1 - list_dot_product(a.u, b.u)), 9) AS cost FROM uv a JOIN uv b USING (track_id) GROUP BY a.track_id, a.sample_id)
SELECT track_id, sample_id, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY cost, sample_id) AS rn FROM c) WHERE rn = 1""")
def medoids(spark, sf_dir):
    return rounded(V.medoids(X.vectors(spark, sf_dir), ["track_id"], "sample_id"), 6, "cost")


@query(f"""WITH {X.VEC}, {X.mean_sql('tm', 'uv', 'track_id', 'u')}, c AS (SELECT u.track_id, sample_id, round(list_dot_product(u, m) / sqrt(list_dot_product(m, m)), 9) AS sim FROM uv u JOIN tm USING (track_id))
SELECT track_id, sample_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY sim DESC, sample_id) AS rn FROM c) WHERE rn = 1""")
def representatives(spark, sf_dir):
    return rounded(V.representatives(X.vectors(spark, sf_dir), ["track_id"], "sample_id"), 6, "sim")


_SIM = f"{X.VEC}, {X.mean_sql('vm', 'vec', 'track_id', 'v')}, sim AS (SELECT vec.track_id, sample_id, label, list_dot_product(v, m) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(m, m)) + 1e-9) AS similarity FROM vec JOIN vm USING (track_id))"


@query(f"WITH {_SIM} SELECT track_id, sample_id, label, round(similarity, 6) AS similarity FROM sim")
def centroid_similarity(spark, sf_dir):
    return rounded(V.centroid_similarity(X.vectors(spark, sf_dir), ["track_id"]), 6, "similarity")


@query(f"""WITH {X.VEC}, e AS (SELECT track_id, sample_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vec),
r AS (SELECT track_id, sample_id, pos, avg(x) OVER (PARTITION BY track_id, pos ORDER BY sample_id ROWS UNBOUNDED PRECEDING) AS x FROM e) SELECT track_id, sample_id, round(sum(x * pos), 6) AS weighed FROM r GROUP BY ALL""")
def running_centroids(spark, sf_dir):
    run = V.running_centroid(X.vectors(spark, sf_dir), ["track_id"], "sample_id")
    weighed = F.aggregate(F.transform("centroid", lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x)
    return rounded(run.select("track_id", "sample_id", weighed.alias("weighed")), 6, "weighed")


@query(f"""WITH {_SIM}, p AS (SELECT track_id, track_id // 4 AS byte_id, min(similarity) AS min_sim, median(similarity) AS median_sim, avg(similarity) AS mean_sim, count(similarity) AS n FROM sim GROUP BY track_id)
SELECT track_id, byte_id, round(min_sim, 6) AS min_sim, round(median_sim, 6) AS median_sim, round(mean_sim, 6) AS mean_sim, n, count(*) OVER (PARTITION BY byte_id) AS splits FROM p""")
def purity_report(spark, sf_dir):
    sims = V.centroid_similarity(X.vectors(spark, sf_dir), ["track_id"]).withColumn("byte_id", F.floor(F.col("track_id") / 4))
    return rounded(V.purity(sims, "track_id", "byte_id"), 6, "min_sim", "median_sim", "mean_sim")


@query(f"""WITH {X.VEC}, q AS (SELECT a.label, list_dot_product(a.u, b.u) AS s FROM uv a JOIN uv b ON a.label = b.label AND a.sample_id < b.sample_id),
st AS (SELECT label, count(*) AS pairs, avg(s) AS mean_sim, min(s) AS min_sim, max(s) AS max_sim, var_pop(s) AS var_sim FROM q GROUP BY label)
SELECT label, z.size, coalesce(pairs, 0) AS pairs, round(coalesce(mean_sim, 1), 6) AS mean_sim, round(coalesce(min_sim, 1), 6) AS min_sim, round(coalesce(max_sim, 1), 6) AS max_sim, round(coalesce(var_sim, 0), 6) AS var_sim
FROM (SELECT label, count(*) AS size FROM vec GROUP BY label) z LEFT JOIN st USING (label)""")
def cluster_qc(spark, sf_dir):
    return rounded(V.cluster_quality(X.vectors(spark, sf_dir), "label", "sample_id"), 6, "mean_sim", "min_sim", "max_sim", "var_sim")


@query(f"""WITH {_SIM}, c AS (SELECT track_id, count(*) FILTER (WHERE round(similarity, 6) >= 0.3) AS near, count(*) FILTER (WHERE round(similarity, 6) < 0.3) AS far FROM sim GROUP BY track_id) SELECT track_id, near, far, near >= 2 AND far >= 2 AS mixed FROM c""")
def multi_identity_flags(spark, sf_dir):
    from dwell.operators import review as R

    return R.mixed_tracks(rounded(V.centroid_similarity(X.vectors(spark, sf_dir), ["track_id"]), 6, "similarity"), ["track_id"], 0.7, 2)


@query(f"""WITH RECURSIVE {X.VEC}, pr AS (SELECT a.sample_id AS a, b.sample_id AS b FROM uv a JOIN uv b ON a.sample_id <> b.sample_id AND list_dot_product(a.u, b.u) >= 1 - 0.7),
core AS (SELECT a AS id FROM pr GROUP BY a HAVING count(*) + 1 >= 4), ce AS (SELECT a, b FROM pr WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS root FROM core UNION SELECT ce.b, reach.root FROM reach JOIN ce ON ce.a = reach.id),
own AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
placed AS (SELECT * FROM own UNION ALL SELECT pr.a, min(own.root) FROM pr JOIN own ON own.id = pr.b WHERE pr.a NOT IN (SELECT id FROM core) GROUP BY pr.a),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster_id FROM (SELECT DISTINCT root FROM own)),
named AS (SELECT id, cluster_id FROM placed JOIN num USING (root)),
noise AS (SELECT sample_id AS id, row_number() OVER (ORDER BY sample_id) + (SELECT coalesce(max(cluster_id), -1) FROM num) AS cluster_id FROM vec WHERE sample_id NOT IN (SELECT id FROM named))
SELECT id AS sample_id, cluster_id FROM named UNION ALL SELECT id, cluster_id FROM noise""")
def dbscan_clusters(spark, sf_dir):
    return C.dbscan(X.vectors(spark, sf_dir), "sample_id", 0.7, 4)


@query(f"""WITH RECURSIVE {X.VEC}, o AS (SELECT track_id // 10 AS video_id, track_id, sample_id, u, row_number() OVER (PARTITION BY track_id // 10 ORDER BY sample_id) AS i FROM uv),
pr AS (SELECT a.video_id, a.i, b.i AS j, 1 - list_dot_product(a.u, b.u) AS d FROM o a JOIN o b ON a.video_id = b.video_id AND a.i < b.i),
st AS (SELECT video_id, list(i ORDER BY i) AS own, 0 AS step FROM o GROUP BY video_id
UNION ALL SELECT video_id, list_transform(own, lambda x: CASE WHEN x = near.hi THEN near.lo ELSE x END), step + 1
  FROM (SELECT video_id, any_value(own) AS own, any_value(step) AS step, arg_min({{'lo': lo, 'hi': hi}}, d) AS near, min(d) AS d
    FROM (SELECT st.video_id, own, step, least(own[i], own[j]) AS lo, greatest(own[i], own[j]) AS hi, avg(d) AS d FROM st JOIN pr ON pr.video_id = st.video_id WHERE own[i] <> own[j] GROUP BY ALL) GROUP BY video_id) WHERE d <= 0.8),
fin AS (SELECT video_id, arg_max(own, step) AS own FROM st GROUP BY video_id)
SELECT o.video_id, sample_id, dense_rank() OVER (PARTITION BY o.video_id ORDER BY own[i]) - 1 AS cluster_id FROM o JOIN fin ON fin.video_id = o.video_id""")
def agglomerative_clusters(spark, sf_dir):
    v = X.vectors(spark, sf_dir).withColumn("video_id", F.floor(F.col("track_id") / 10))
    return C.agglomerative(v, ["video_id"], "sample_id", 0.8)


_ADD = "list_transform(list_zip({a}, {b}), lambda z: z[1] + z[2])"
_NORM = "greatest(sqrt(list_dot_product({x}, {x})), 1e-12::DOUBLE)"


@query(f"""WITH RECURSIVE {X.VEC}, o AS (SELECT track_id, list_transform(v, lambda e: e / {_NORM.format(x='v')}) AS u, row_number() OVER (PARTITION BY track_id ORDER BY sample_id) AS k FROM vec),
st AS (SELECT DISTINCT track_id, 0::BIGINT AS k, []::DOUBLE[][] AS sums, []::INT[] AS sizes FROM o
UNION ALL SELECT track_id, k, CASE WHEN fits THEN list_transform(sums, lambda s, i: CASE WHEN i = pos THEN {_ADD.format(a='s', b='u')} ELSE s END) ELSE list_append(sums, u) END,
    CASE WHEN fits THEN list_transform(sizes, lambda n, i: CASE WHEN i = pos THEN n + 1 ELSE n END) ELSE list_append(sizes, 1) END
  FROM (SELECT *, list_position(sims, list_max(sims)) AS pos, coalesce(list_max(sims) >= 0.2, false) AS fits
    FROM (SELECT st.track_id, o.k, sums, sizes, o.u, list_transform(sums, lambda s: list_dot_product(s, o.u) / {_NORM.format(x='s')}) AS sims FROM st JOIN o ON o.track_id = st.track_id AND o.k = st.k + 1)))
SELECT track_id, len(sizes) AS leaders, CASE WHEN len(list_filter(sizes, lambda n: n >= 2)) > 0 THEN len(list_filter(sizes, lambda n: n >= 2)) ELSE len(sizes) END AS identities
FROM (SELECT track_id, arg_max(sizes, k) AS sizes FROM st GROUP BY track_id)""")
def leader_clusters(spark, sf_dir):
    return C.leader_clusters(X.vectors(spark, sf_dir), ["track_id"], "sample_id", 0.2, 2)


_NEAR_NOW = "CASE WHEN sizes[{n}] >= 3 THEN list_dot_product({c}, v) / (sqrt(list_dot_product({c}, {c})) * sqrt(list_dot_product(v, v)) + 1e-9) END"
_MEAN = "list_transform(sums[now], lambda e: e / sizes[now])"
_TOTAL = "list_reduce(list_transform({x}, lambda p: p.v), lambda a, b: " + _ADD.format(a="a", b="b") + ")"
_SET = "list_transform({l}, lambda e, i: CASE WHEN i = {at} THEN {x} ELSE e END)"
_HELD = "STRUCT(f BIGINT, v DOUBLE[])"
_OUT = "STRUCT(f BIGINT, n BIGINT)"


# the steps of a frame, one below the other: whether its similarity is taken; what it does to the quarantine; what is
# let out of that, to whom; and last the frame itself, unless it waits
@query(f"""WITH RECURSIVE {X.VEC}, o AS (SELECT sample_id // 200 AS byte_id, sample_id AS f, v, row_number() OVER (PARTITION BY sample_id // 200 ORDER BY sample_id) AS k FROM vec),
st AS (SELECT byte_id, 0::BIGINT AS k, 1 AS now, [list_transform(any_value(v), lambda e: 0.0::DOUBLE)] AS sums, [0] AS sizes, [-16]::BIGINT[] AS last, []::{_HELD}[] AS held, 0 AS streak, 0 AS back, []::{_OUT}[] AS done FROM o GROUP BY byte_id
UNION ALL SELECT byte_id, k, now, sums, sizes, last, held, streak, back, done FROM (
  SELECT *EXCLUDE (now, sums, sizes, last, done), CASE WHEN splits THEN len(sums) + 1 ELSE now END AS now,
    CASE WHEN waits THEN sums WHEN splits THEN list_append(sums, list_transform(v, lambda e: e * 2)) ELSE {_SET.format(l='sums', at='now', x=_ADD.format(a='e', b='v'))} END AS sums,
    CASE WHEN waits THEN sizes WHEN splits THEN list_append(sizes, 2) ELSE {_SET.format(l='sizes', at='now', x='e + 1')} END AS sizes,
    CASE WHEN splits THEN list_append(last, -16) ELSE last END AS last, CASE WHEN waits THEN done ELSE list_append(done, struct_pack(f := f, n := CASE WHEN splits THEN len(sums) ELSE now - 1 END)) END AS done
  FROM (SELECT *, NOT waits AND coalesce(coalesce(sim, {_NEAR_NOW.format(n='now', c=_MEAN)}) < 0.0, false) AS splits FROM (
    SELECT *EXCLUDE (sums, sizes, done, held, freed), CASE WHEN len(freed) = 0 THEN sums ELSE {_SET.format(l='sums', at='now', x=_ADD.format(a='e', b=_TOTAL.format(x='freed')))} END AS sums,
      {_SET.format(l='sizes', at='now', x='e + len(freed)')} AS sizes, list_concat(done, list_transform(freed, lambda p: struct_pack(f := p.f, n := now - 1)::{_OUT})) AS done, CASE WHEN len(freed) > 0 THEN []::{_HELD}[] ELSE held END AS held
    FROM (SELECT *EXCLUDE (now, sums, sizes, last, back), CASE WHEN opens THEN len(sums) + 1 ELSE now END AS now, CASE WHEN opens THEN list_append(sums, list_transform(v, lambda e: 0.0::DOUBLE)) ELSE sums END AS sums,
        CASE WHEN opens THEN list_append(sizes, 0) ELSE sizes END AS sizes, CASE WHEN opens THEN list_append(last, f) ELSE last END AS last, CASE WHEN opens OR NOT asked OR (waits AND NOT far AND back >= 2) THEN 0 ELSE back END AS back,
        CASE WHEN opens OR NOT asked OR (waits AND NOT far AND back >= 2) THEN held ELSE []::{_HELD}[] END AS freed
      FROM (SELECT *EXCLUDE (streak), far AND streak >= 3 AS opens, CASE WHEN far AND streak >= 3 THEN 0 ELSE streak END AS streak FROM (
        SELECT *EXCLUDE (held, streak, back, last), far OR (asked AND len(held) > 0) AS waits, CASE WHEN far OR (asked AND len(held) > 0) THEN list_append(held, struct_pack(f := f, v := v)::{_HELD}) ELSE held END AS held, CASE WHEN far THEN streak + 1 ELSE 0 END AS streak,
          CASE WHEN far THEN 0 WHEN asked AND len(held) > 0 THEN CASE WHEN sim IS NULL THEN 2 WHEN sim >= 0.1 THEN back + 1 ELSE 0 END ELSE back END AS back, CASE WHEN asked THEN {_SET.format(l='last', at='now', x='f')} ELSE last END AS last
        FROM (SELECT *, coalesce(sim < 0.05, false) AS far FROM (SELECT *, CASE WHEN asked THEN {_NEAR_NOW.format(n='now', c=_MEAN)} END AS sim FROM (
          SELECT st.*EXCLUDE (k), o.k, o.f, o.v, sizes[now] < 3 OR o.f - last[now] >= 16 AS asked FROM st JOIN o ON o.byte_id = st.byte_id AND o.k = st.k + 1)))))))))),
fin AS (SELECT byte_id, arg_max(list_concat(done, list_transform(held, lambda p: struct_pack(f := p.f, n := now - 1)::{_OUT})), k) AS done FROM st GROUP BY byte_id)
SELECT byte_id, d.f AS frame_idx, d.n AS identity FROM (SELECT byte_id, unnest(done) AS d FROM fin)""")
def identity_guard(spark, sf_dir):
    v = X.vectors(spark, sf_dir).select(F.floor(F.col("sample_id") / 200).alias("byte_id"), F.col("sample_id").alias("frame_idx"), "embedding")
    return C.identity_guard(v, ["byte_id"], min_picks=3, stride=16, consecutive=3, reject=0.05, margin=0.05, recover=2, split_below=0.0)


_STITCH = 20 * 86400000.0
_EDGE = f"""{X.PIECES}, b2 AS (SELECT *, s AS x1, s AS y1, s + 50 AS x2, s + 50 AS y2 FROM pieces), a2 AS (SELECT *, e AS x1, e AS y1, e + 50 AS x2, e + 50 AS y2 FROM pieces),
ed AS (SELECT a2.video_id, a2.piece AS a, b2.piece AS b, {X.iou_sql('a2', 'b2')} AS iou, list_dot_product(a2.u, b2.u) AS sim, b2.start_ms - a2.end_ms AS gap_ms FROM a2 JOIN b2 ON a2.video_id = b2.video_id AND a2.piece <> b2.piece
  AND b2.start_ms >= a2.end_ms AND b2.start_ms - a2.end_ms <= {_STITCH})"""


@query(f"WITH {_EDGE} SELECT video_id, a, b, round(iou, 6) AS iou, round(sim, 6) AS sim, round(gap_ms, 3) AS gap_ms FROM ed WHERE iou >= 0.1 AND 1 - sim <= 0.98")
def stitch_edges(spark, sf_dir):
    e = C.stitch_edges(X.pieces(spark, sf_dir), ["video_id"], _STITCH, 0.1, 0.98)
    return rounded(rounded(e, 6, "iou", "sim"), 3, "gap_ms")


@query(f"""{'WITH RECURSIVE ' + _EDGE}, e2 AS (SELECT video_id, a, b, sim FROM ed WHERE iou >= 0.1 AND 1 - sim <= 0.98), od AS (SELECT video_id, list(piece ORDER BY start_ms, piece) AS ps FROM pieces GROUP BY video_id),
nx AS (SELECT e2.video_id, a, list(b ORDER BY sim DESC, start_ms, b) AS bs FROM e2 JOIN pieces p ON p.video_id = e2.video_id AND p.piece = e2.b GROUP BY e2.video_id, a),
st AS (SELECT video_id, 1 AS k, ps[1] AS now, 1 AS chain_id, 0 AS position, [ps[1]] AS used FROM od
UNION ALL SELECT video_id, k + 1, coalesce(follows, fresh), CASE WHEN follows IS NULL THEN chain_id + 1 ELSE chain_id END, CASE WHEN follows IS NULL THEN 0 ELSE position + 1 END, list_append(used, coalesce(follows, fresh))
  FROM (SELECT st.*, list_filter(coalesce(bs, []), lambda x: NOT list_contains(used, x))[1] AS follows, list_filter(ps, lambda x: NOT list_contains(used, x))[1] AS fresh
    FROM st JOIN od ON od.video_id = st.video_id LEFT JOIN nx ON nx.video_id = st.video_id AND nx.a = st.now WHERE k < len(ps)))
SELECT video_id, now AS track_id, chain_id, position FROM st""")
def stitch_chains(spark, sf_dir):
    return C.stitched(X.pieces(spark, sf_dir), ["video_id"], _STITCH, 0.1, 0.98)
