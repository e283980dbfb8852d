"""Sample candidates: gates, pools, spacing and full selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.operators import sampling as P
from dwell.plans import fixtures as X
from dwell.plans.base import query, rounded

_K = ["track_id"]
_COLS = ["track_id", "frame_idx", "l_linenumber", "l_partkey", "rank", "quality"]
_OUT = "track_id, frame_idx, l_linenumber, l_partkey, rank, quality"


@query(f"WITH {X.RANKED} SELECT {_OUT}, CASE WHEN rank > 24 THEN 'rejected_quality' END AS reason FROM ranked")
def candidate_pool(spark, sf_dir):
    return P.candidate_pool(X.candidates(spark, sf_dir), _K, 24, X.TIES).select(*_COLS, "reason")


@query(f"WITH {X.RANKED} SELECT {_OUT} FROM ranked WHERE rank <= 20")
def debug_top20(spark, sf_dir):
    return P.debug_rows(X.candidates(spark, sf_dir), _K, 20, X.TIES).select(*_COLS)


@query(f"""WITH {X.CAND}, g AS (SELECT track_id, greatest(quantile_cont(sharpness, 0.4), 60.0) AS gate FROM cand GROUP BY track_id)
SELECT track_id, frame_idx, l_linenumber, l_partkey, round(sharpness, 6) AS sharpness, round(gate, 6) AS gate FROM cand JOIN g USING (track_id) WHERE sharpness >= gate""")
def sharpness_gate(spark, sf_dir):
    return rounded(P.percentile_gate(X.candidates(spark, sf_dir), _K, "sharpness", 40.0, 60.0).select("track_id", "frame_idx", "l_linenumber", "l_partkey", "sharpness", "gate"), 6, "sharpness", "gate")


@query(f"""WITH {X.CAND}, g AS (SELECT track_id, quantile_cont(frontalness, 0.75) AS gate FROM cand GROUP BY track_id)
SELECT track_id, count(*) AS n, round(min(gate), 6) AS gate FROM cand JOIN g USING (track_id) WHERE round(frontalness, 9) >= round(gate, 9) GROUP BY track_id""")
def percentile_filter(spark, sf_dir):
    kept = P.percentile_gate(rounded(X.candidates(spark, sf_dir), 9, "frontalness"), _K, "frontalness", 75.0)
    return rounded(kept.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.min("gate").alias("gate")), 6, "gate")


@query(f"""WITH {X.RANKED}, a AS (SELECT track_id, list(frame_idx ORDER BY rank) AS fs FROM ranked GROUP BY track_id),
k AS (SELECT track_id, list_reduce(list_transform(fs, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) < 8 AND len(list_filter(acc, lambda f: abs(f - x[1]) < 400)) = 0 THEN list_append(acc, x[1]) ELSE acc END) AS kept FROM a)
SELECT track_id, unnest(kept) AS frame_idx FROM k""")
def spaced_samples(spark, sf_dir):
    return P.spaced(X.candidates(spark, sf_dir), _K, 8, 400, X.TIES)


@query(f"""WITH {X.CAND}, r AS (SELECT CASE WHEN round(area_frac, 9) < 0.003 THEN 'rejected_area' WHEN sharpness < 20 THEN 'rejected_sharpness' WHEN round(frontalness, 9) < 0.15 THEN 'rejected_frontalness' END AS reason FROM cand)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def reject_counts(spark, sf_dir):
    return P.reject_counts(P.gate_reasons(rounded(X.candidates(spark, sf_dir), 9, "area_frac", "frontalness"), 0.003, 20.0, 0.15))


def _spaced(start: str, items: str, room: str) -> str:
    """Items (structs with f, a frame) taken in order while there is room, 200 frames from all before."""
    return f"list_reduce(list_transform({items}, lambda x: [x]), lambda acc, x: CASE WHEN {room} AND len(list_filter(acc, lambda y: abs(y.f - x[1].f) < 200)) = 0 THEN list_append(acc, x[1]) ELSE acc END, {start})"


def _topped(start: str, items: str) -> str:
    return f"list_concat({start}, list_filter({items}, lambda x: NOT list_contains({start}, x))[1:greatest(least_ - len({start}), 0)])"


_NONE = "[]::STRUCT(i BIGINT, f BIGINT, q DOUBLE, s DOUBLE, p DOUBLE)[]"


@query(f"""WITH {X.RANKED}, c AS (SELECT track_id, rank, frame_idx, quality, sharpness, frontalness, struct_pack(i := rank, f := frame_idx, q := quality, s := sharpness, p := frontalness) AS x FROM ranked WHERE rank <= 24),
g AS (SELECT track_id, greatest(quantile_cont(sharpness, 0.3), 20.0) AS gate, min(rank) FILTER (WHERE frontalness >= 0.2) AS first FROM c GROUP BY track_id),
d AS (SELECT c.*, gate, first, CASE WHEN sharpness < gate AND rank > first THEN 'rejected_sharpness' WHEN frontalness >= 0.2 THEN 'frontal' WHEN frontalness >= 0.1 THEN 'profile' ELSE 'rejected_frontalness' END AS kind FROM c JOIN g USING (track_id)),
t0 AS (SELECT track_id, coalesce(list(x ORDER BY rank) FILTER (WHERE kind = 'frontal'), {_NONE}) AS el, coalesce(list(x ORDER BY quality DESC, sharpness DESC, rank) FILTER (WHERE kind = 'profile'), {_NONE}) AS pr, quantile_cont(frontalness, 0.6) FILTER (WHERE kind = 'frontal') AS level FROM d GROUP BY track_id),
t1 AS (SELECT *, least(8, len(el) + least(2, len(pr))) AS wanted, least(4, 8, len(el) + least(2, len(pr))) AS least_ FROM t0),
t2 AS (SELECT *, {_spaced(_NONE, 'el', 'len(acc) < wanted')} AS s1 FROM t1), t3 AS (SELECT *, {_topped('s1', 'el')} AS s2 FROM t2),
t4 AS (SELECT *, {_spaced('s2', 'pr', 'len(acc) < wanted AND len(acc) - len(s2) < least(2, len(pr))')} AS s3 FROM t3), t5 AS (SELECT *, {_topped('s3', 'pr')} AS s4 FROM t4),
t6 AS (SELECT *, list_reduce(list_transform(list_filter(el, lambda e: e.p >= level), lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.p >= level)) >= 3 OR list_contains(acc, x[1]) THEN acc
  WHEN len(acc) < 8 THEN list_append(acc, x[1]) WHEN len(list_filter(acc, lambda y: y.p < level)) = 0 THEN acc
  ELSE list_append(list_filter(acc, lambda z: z.i <> list_sort(list_transform(list_filter(acc, lambda y: y.p < level), lambda y: {{'q': -y.q, 'i': -y.i, 'n': y.i}}))[1].n), x[1]) END, s4) AS s5 FROM t5)
SELECT track_id, frame_idx, quality, round(sharpness, 9) AS sharpness, round(frontalness, 9) AS frontalness, rank, list_contains(s5, x) AS picked,
  CASE WHEN kind LIKE 'rejected%' THEN kind WHEN list_contains(s2, x) THEN 'picked' WHEN list_contains(s4, x) THEN 'picked_profile' WHEN list_contains(s5, x) THEN 'picked' WHEN kind = 'profile' THEN 'profile_pool'
    WHEN sharpness < gate THEN 'picked_sharpness_floor' ELSE 'not_selected' END AS reason FROM d JOIN t6 USING (track_id)""")
def full_sample_selection(spark, sf_dir):
    got = P.select_samples(X.candidates(spark, sf_dir), _K, 24, X.TIES, sharpness_pct=30.0, min_sharpness=20.0, min_frontalness=0.2, profile_quota=2, profile_floor=0.1, min_frontal=3, min_gap=200)
    return rounded(got, 9, "sharpness", "frontalness")


_TIES = ", ".join(X.TIES)


@query(f"""WITH RECURSIVE {X.CAND}, o AS (SELECT track_id, frame_idx, l_linenumber, l_partkey, quality, [sharpness, frontalness * 10, area_frac * 1000] AS v,
  row_number() OVER (PARTITION BY track_id ORDER BY quality DESC, frame_idx, {_TIES}, [sharpness, frontalness * 10, area_frac * 1000]) AS k FROM cand),
st AS (SELECT DISTINCT track_id, 0::BIGINT AS k, []::DOUBLE[][] AS taken, false AS hit FROM o
UNION ALL SELECT track_id, k, CASE WHEN hit THEN list_append(taken, v) ELSE taken END, hit
  FROM (SELECT st.track_id, o.k, o.v, taken, len(list_filter(taken, lambda t: (abs(t[1] - o.v[1]) + abs(t[2] - o.v[2]) + abs(t[3] - o.v[3])) / 3 < 5)) = 0 AS hit FROM st JOIN o ON o.track_id = st.track_id AND o.k = st.k + 1 WHERE len(taken) < 10))
SELECT track_id, len(taken) AS rank, frame_idx, l_linenumber, l_partkey, round(quality, 6) AS quality FROM st JOIN o USING (track_id, k) WHERE hit""")
def seed_topn_dedup(spark, sf_dir):
    c = X.candidates(spark, sf_dir).withColumn("feature", F.array("sharpness", F.col("frontalness") * 10, F.col("area_frac") * 1000))
    return rounded(P.top_distinct(c, _K, "feature", 10, 5.0, ["frame_idx", *X.TIES]).select("track_id", "rank", "frame_idx", "l_linenumber", "l_partkey", "quality"), 6, "quality")


@query(f"""WITH {X.RANKED}, r AS (SELECT *, rank <= 3 AS p, CASE WHEN rank > 3 AND track_id % 2 = 0 AND sharpness < 100 THEN 'rejected_sharpness' ELSE 'not_selected' END AS reason FROM ranked),
m AS (SELECT *, max(NOT p AND reason LIKE 'rejected%') OVER (PARTITION BY track_id) AS any_ FROM r), w AS (SELECT *, CASE WHEN p THEN 'picked' WHEN reason LIKE 'rejected%' OR NOT any_ THEN 'rejected' END AS row FROM m)
SELECT track_id, row, tile, frame_idx, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY track_id, row ORDER BY {X.ORDER}) AS tile FROM w WHERE row IS NOT NULL) WHERE tile <= 5""")
def montage_rows(spark, sf_dir):
    """Tracks of odd numbers have no reason of rejection, so that their other samples stand in."""
    blurred = (F.col("rank") > 3) & (F.col("track_id") % 2 == 0) & (F.col("sharpness") < 100)
    s = X.ranked(spark, sf_dir).withColumn("picked", F.col("rank") <= 3).withColumn("reason", F.when(blurred, "rejected_sharpness").otherwise("not_selected"))
    return P.montage_rows(s, _K, 5, ["frame_idx", *X.TIES]).select("track_id", "row", "tile", "frame_idx", "l_linenumber", "l_partkey")
