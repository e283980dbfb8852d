"""The engine's inputs, made from the given tables; each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwell.functions import geometry as G
from dwell.functions.numbers import nearest
from dwell.functions.vectors import doubles
from dwell.operators import segments as S
from dwell.plans.base import table

LABELS = ["click", "error", "purchase", "signup", "view"]
SLOW, FAST = 1 / 60, 60.0  # frames a second: a minute each, or 60 of them a second
GAP = 720
WIDTH, HEIGHT = 640.0, 480.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label event a row; a frame is a minute."""
    minute = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 60000000)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), minute.alias("frame_idx"), F.col("event_type").alias("label"), (F.col("value") / 500).alias("score"), "event_id")


EVENTS = """ev AS (SELECT user_id AS track_id, CAST(floor((epoch_us(ts) - 1704067200000000) / 60000000) AS BIGINT) AS frame_idx,
  event_type AS label, value / 500 AS score, event_id FROM events)"""


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_per_frame(events(spark, sf_dir), ["track_id"], "event_id")


OBS = f"""{EVENTS}, obs AS (SELECT track_id, frame_idx, label, score FROM
  (SELECT *, row_number() OVER (PARTITION BY track_id, frame_idx ORDER BY event_id DESC) AS rn FROM ev) WHERE rn = 1)"""


def segments(spark: SparkSession, sf_dir: str, fps: float = SLOW, min_frames: int = 2) -> DataFrame:
    return S.label_runs(obs(spark, sf_dir), ["track_id"], fps, GAP / fps * 1000, min_frames / fps * 1000)


def segments_sql(fps: str, min_frames: int = 2, name: str = "seg", labels: str = "obs") -> str:
    return f"""{name}_m AS (SELECT *, CASE WHEN lag(label) OVER w = label AND frame_idx - lag(frame_idx) OVER w <= {GAP} THEN 0 ELSE 1 END AS new
  FROM {labels} WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)),
{name}_r AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS run FROM {name}_m),
{name}_g AS (SELECT track_id, run, min(label) AS label, min(frame_idx) AS f0, max(frame_idx) AS f1, avg(score) AS s FROM {name}_r GROUP BY ALL),
{name} AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY f0) - 1 AS subtrack_id, label, f0 / ({fps}) * 1000 AS start_ms,
  f0 / ({fps}) * 1000 + (f1 - f0 + 1) / ({fps}) * 1000 AS end_ms, (f1 - f0 + 1) / ({fps}) * 1000 AS duration_ms, f1 - f0 + 1 AS frames, s AS avg_similarity
  FROM {name}_g WHERE f1 - f0 + 1 >= {min_frames})"""


SEG = f"{OBS}, {segments_sql('1.0::DOUBLE / 60')}"
SEG_FAST = f"{OBS}, {segments_sql('60.0::DOUBLE')}"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.subtracks_from_runs(obs(spark, sf_dir), ["track_id"])


RUNS = f"""{OBS}, rm AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS new FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)),
rr AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS run FROM rm),
runs AS (SELECT track_id, run - 1 AS subtrack_id, min(label) AS label, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, avg(score) AS avg_similarity, count(*) AS n_scores FROM rr GROUP BY track_id, run)"""

_TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces and persons by turns, in frames of an order each."""
    det = table(spark, sf_dir, "lineitem").withColumn("det_idx", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_TIES)))
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    face = F.col("det_idx") % 2 == 1
    x1, y1 = F.when(face, q * 8).otherwise(q * 6), F.when(face, d * 2000).otherwise(d * 1500)
    w, h = F.when(face, t * 1000 + 40).otherwise(t * 800 + 200), F.when(face, t * 500 + 60).otherwise(t * 600 + 240)
    return det.select(
        F.col("l_orderkey").alias("frame_idx"), "det_idx", F.when(face, "face").otherwise("person").alias("kind"), (F.col("l_suppkey") % 20).alias("track_id"), G.box(x1, y1, x1 + w, y1 + h).alias("bbox"), (d * 5 + 0.2).alias("score")
    )


DET = f"""det0 AS (SELECT l_orderkey AS frame_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_TIES)}) AS det_idx, l_suppkey % 20 AS track_id,
  l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem),
det1 AS (SELECT *, CASE WHEN det_idx % 2 = 1 THEN 'face' ELSE 'person' END AS kind, CASE WHEN det_idx % 2 = 1 THEN q * 8 ELSE q * 6 END AS x1,
  CASE WHEN det_idx % 2 = 1 THEN d * 2000 ELSE d * 1500 END AS y1, CASE WHEN det_idx % 2 = 1 THEN t * 1000 + 40 ELSE t * 800 + 200 END AS w,
  CASE WHEN det_idx % 2 = 1 THEN t * 500 + 60 ELSE t * 600 + 240 END AS h, d * 5 + 0.2::DOUBLE AS score FROM det0),
det AS (SELECT frame_idx, det_idx, track_id, kind, x1, y1, x1 + w AS x2, y1 + h AS y2, score FROM det1),
face AS (SELECT frame_idx, det_idx AS face_idx, x1, y1, x2, y2, score FROM det WHERE kind = 'face'),
person AS (SELECT frame_idx, det_idx AS track_idx, track_id, x1, y1, x2, y2 FROM det WHERE kind = 'person')"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where("kind = 'face'").select("frame_idx", F.col("det_idx").alias("face_idx"), F.col("bbox").alias("face_box"), "score")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where("kind = 'person'").select("frame_idx", F.col("det_idx").alias("track_idx"), "track_id", F.col("bbox").alias("track_box"))


def iou_sql(a: str, b: str, dilate: float = 0.0) -> str:
    """IoU of a's and b's box, b's grown and clipped."""
    grow = lambda e, side: e
    if dilate:
        own = {"x1": f"greatest(0.0, {b}.x1 - ({b}.x2 - {b}.x1) * {dilate})", "y1": f"greatest(0.0, {b}.y1 - ({b}.y2 - {b}.y1) * {dilate})", "x2": f"least({WIDTH}, {b}.x2 + ({b}.x2 - {b}.x1) * {dilate})", "y2": f"least({HEIGHT}, {b}.y2 + ({b}.y2 - {b}.y1) * {dilate})"}
        grow = lambda e, side: own[side]
    bx1, by1, bx2, by2 = (grow(f"{b}.{s}", s) for s in ("x1", "y1", "x2", "y2"))
    w, h = f"greatest(0.0, least({a}.x2, {bx2}) - greatest({a}.x1, {bx1}))", f"greatest(0.0, least({a}.y2, {by2}) - greatest({a}.y1, {by1}))"
    union = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({bx2} - {bx1}) * ({by2} - {by1}) - {w} * {h})"
    return f"(CASE WHEN {w} * {h} > 0 AND {union} > 0 THEN {w} * {h} / {union} ELSE 0 END)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("label"), F.floor(F.col("vec_id") / 10).alias("track_id"), doubles(F.col("embedding")).alias("embedding"))


VEC = """vec AS (SELECT vec_id AS sample_id, CAST(label AS VARCHAR) AS label, vec_id // 10 AS track_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
uv AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vec)"""


def mean_sql(name: str, source: str, key: str, column: str) -> str:
    return f"""{name} AS (SELECT {key}, list(x ORDER BY pos) AS m, max(n) AS n FROM (SELECT {key}, pos, avg(x) AS x, count(*) AS n FROM
  (SELECT {key}, unnest({column}) AS x, generate_subscripts({column}, 1) AS pos FROM {source}) GROUP BY {key}, pos) GROUP BY {key})"""


BANK = f"""{VEC}, {mean_sql('lm', 'vec', 'label', 'v')}, bank AS (SELECT label, n, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM lm)"""

TIES = ["l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus"]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample candidates: a track for each supplier, frames by order."""
    c = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("track_id"), F.col("l_orderkey").alias("frame_idx"), (F.col("l_extendedprice") / 500).alias("sharpness"), (F.col("l_discount") * 10).alias("frontalness"), (F.col("l_tax") / 4).alias("area_frac"), *TIES
    )
    return c.withColumn("quality", nearest(G.quality(F.col("sharpness"), F.col("frontalness"), F.col("area_frac"), 20.0, 0.01, (0.5, 0.3, 0.2)), 9))


CAND = f"""c0 AS (SELECT l_suppkey AS track_id, l_orderkey AS frame_idx, l_extendedprice / 500 AS sharpness, l_discount * 10 AS frontalness, l_tax / 4 AS area_frac, {', '.join(TIES)} FROM lineitem),
cand AS (SELECT *, round(greatest(0.0, least(1.0, 0.5 * greatest(0.0, least(1.0, (sharpness - 20.0) / 60.0)) + 0.3 * greatest(0.0, least(1.0, frontalness))
  + 0.2 * greatest(0.0, least(1.0, 1 - abs(area_frac - 0.01) / 0.01)))), 9) AS quality FROM c0)"""
ORDER = "quality DESC, frame_idx, " + ", ".join(TIES)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their place in the track; the first 12 of each are picked."""
    w = Window.partitionBy("track_id").orderBy(F.desc("quality"), "frame_idx", *TIES)
    return candidates(spark, sf_dir).withColumn("rank", F.row_number().over(w)).withColumn("picked", F.col("rank") <= 12)


RANKED = f"{CAND}, ranked AS (SELECT *, rank <= 12 AS picked FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY {ORDER}) AS rank FROM cand))"


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks to stitch: a user's segments, with a vector and boxes by arithmetic."""
    seg = segments(spark, sf_dir, SLOW, 1).withColumn("piece", F.col("track_id") * 10000 + F.col("subtrack_id"))
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), "embedding")  # as given, so that an exchange holds no wider numbers
    s, e = (F.col("subtrack_id") % 4) * 10.0, ((F.col("subtrack_id") + 1) % 4) * 10.0
    # all vectors are used, however many there are
    seg = seg.join(F.broadcast(vec.agg(F.count(F.lit(1)).alias("vectors"))), F.lit(True)).withColumn("k", (F.col("track_id") * 7 + F.col("subtrack_id")) % F.col("vectors"))
    return seg.join(vec, "k").select(F.col("track_id").alias("video_id"), F.col("piece").alias("track_id"), "start_ms", "end_ms", G.box(s, s, s + 50, s + 50).alias("start_box"), G.box(e, e, e + 50, e + 50).alias("end_box"), "embedding")


PIECES = f"""{OBS}, {segments_sql('1.0::DOUBLE / 60', 1)}, {VEC},
pieces AS (SELECT track_id AS video_id, track_id * 10000 + subtrack_id AS piece, start_ms, end_ms, (subtrack_id % 4) * 10.0 AS s, ((subtrack_id + 1) % 4) * 10.0 AS e, uv.u
  FROM (SELECT *, (track_id * 7 + subtrack_id) % (SELECT count(*) FROM embeddings) AS k FROM seg) p JOIN (SELECT sample_id, u FROM uv) uv ON uv.sample_id = p.k)"""
