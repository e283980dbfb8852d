"""Streams run to their end: the events table as files, which a stream reads some at a time, and what its sink then has."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.operators.graph import fresh_folder
from dwell.plans.base import query, rounded, table
from dwell.streaming import twins

_GAP_MS, _HOUR_MS = 43_200_000, 3_600_000
#: Longer than all events take, so that files may come in any order.
_LATENESS = "400 days"
_FORGET_MS = 30 * 86_400_000
#: States that tracks share by a hash.
_BUCKETS = 4096


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("track_id"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("label"), (F.col("value") / 500).alias("score"), F.col("event_id").alias("tie"))


def _ended(spark: SparkSession, rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Writes the rows in three parts by a hash, and after them one of a time that all others are late for; runs the
    stream over the files until there are no more, and reads its sink. Checkpoint and sink lie in the shared folder."""
    at = fresh_folder(spark, "stream")
    for part in range(3):
        rows.where(F.pmod(F.xxhash64("tie"), F.lit(3)) == part).write.mode("append").parquet(f"{at}/in")
    last = rows.agg(F.max("ts").alias("ts"))
    for days in (2000, 2001):
        far = last.select(*(F.lit(-1).cast(f.dataType).alias(f.name) if f.name in ("track_id", "tie") else (F.col("ts") + F.expr(f"interval {days} days")).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema))
        far.where("ts IS NOT NULL").write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(f"{at}/in")
    out = make(stream)
    run = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


_TS = "epoch_us(ts) // 1000"
_SEEN = f"""e AS (SELECT user_id AS track_id, event_type AS label, value / 500 AS score, event_id AS tie, {_TS} AS ms FROM events)"""


def _runs_sql(by: str, new: str) -> str:
    return f"""{_SEEN}, m AS (SELECT *, CASE WHEN {new} THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY {by} ORDER BY ms, tie)),
r AS (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY ms, tie ROWS UNBOUNDED PRECEDING) AS run FROM m)"""


@query(f"""WITH {_runs_sql('track_id', f'lag(label) OVER w IS DISTINCT FROM label OR ms - lag(ms) OVER w > {_GAP_MS}')}
SELECT track_id, min(label) AS label, min(ms) AS first_ms, max(ms) AS last_ms, round(avg(score), 6) AS avg_similarity, count(*) AS n FROM r GROUP BY track_id, run""")
def stream_label_runs(spark, sf_dir):
    got = _ended(spark, _labels(spark, sf_dir), lambda s: twins.label_runs(s, ["track_id"], _GAP_MS, _LATENESS, _BUCKETS))
    return rounded(got.where("track_id >= 0"), 6, "avg_similarity")


@query(f"""WITH {_runs_sql('track_id, label', f'lag(ms) OVER w IS NULL OR ms - lag(ms) OVER w >= {_GAP_MS}')}
SELECT track_id, label, min(ms) AS first_ms, max(ms) AS last_ms, round(avg(score), 6) AS avg_similarity, count(*) AS n FROM r GROUP BY track_id, label, run""")
def stream_label_sessions(spark, sf_dir):
    got = _ended(spark, _labels(spark, sf_dir), lambda s: twins.label_sessions(s, ["track_id"], "12 hours", _LATENESS))
    return rounded(got.where("track_id >= 0").select("track_id", "label", F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_ts").alias("last_ms"), "avg_similarity", "n"), 6, "avg_similarity")


@query(f"""WITH {_runs_sql('track_id', f'lag(ms) OVER w IS NULL OR ms - lag(ms) OVER w > {2 * _GAP_MS}')} SELECT track_id, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n FROM r GROUP BY track_id, run""")
def stream_live_tracks(spark, sf_dir):
    return _ended(spark, _labels(spark, sf_dir), lambda s: twins.live_tracks(s, 2 * _GAP_MS, _LATENESS, _BUCKETS)).where("track_id >= 0")


@query(f"WITH {_SEEN} SELECT ms // 1000 AS second, label, count(*) AS n FROM e GROUP BY ALL")
def stream_presence(spark, sf_dir):
    got = _ended(spark, _labels(spark, sf_dir), lambda s: twins.presence_by_second(s.where("label IS NOT NULL OR track_id < 0"), _LATENESS))
    return got.where("label IS NOT NULL").select(F.unix_seconds("second").alias("second"), "label", "n")


# runs of doubtful samples are cut where they waited too long; every third of a run is decided, the rest is taken along
# by the sample after it or given back
@query(f"""WITH {_SEEN}, q AS (SELECT track_id, ms, tie, score > 0.4 AS doubtful FROM e),
l AS (SELECT *, sum(CASE WHEN gap > {_FORGET_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY ms, tie ROWS UNBOUNDED PRECEDING) AS life FROM (SELECT *, ms - lag(ms) OVER (PARTITION BY track_id ORDER BY ms, tie) AS gap FROM q)),
m AS (SELECT *, CASE WHEN lag(doubtful) OVER w IS DISTINCT FROM doubtful OR doubtful AND gap > {2 * _GAP_MS} THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY track_id, life ORDER BY ms, tie)),
r AS (SELECT *, sum(new) OVER (PARTITION BY track_id, life ORDER BY ms, tie ROWS UNBOUNDED PRECEDING) AS run FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY track_id, life, run ORDER BY ms, tie) AS pos, count(*) OVER (PARTITION BY track_id, life, run) AS len, max(ms) OVER (PARTITION BY track_id, life, run) AS run_end FROM r),
g AS (SELECT track_id, life, run, any_value(doubtful) AS doubtful, max(len) AS len, min(ms) AS begins FROM p GROUP BY track_id, life, run),
b AS (SELECT *, coalesce(sum(CASE WHEN doubtful THEN len // 3 ELSE 0 END) OVER (PARTITION BY track_id, life ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
  lead(doubtful) OVER (PARTITION BY track_id, life ORDER BY run) AS next_doubtful, lead(begins) OVER (PARTITION BY track_id, life ORDER BY run) AS next_ms FROM g)
SELECT p.track_id, p.ms AS ts_ms, CAST(base + CASE WHEN NOT p.doubtful THEN 0 ELSE least((pos + 2) // 3, p.len // 3) END AS INT) AS identity,
  p.doubtful AND (pos + 2) // 3 > p.len // 3 AND NOT coalesce(next_doubtful = false AND next_ms - run_end <= {2 * _GAP_MS}, false) AS flushed FROM p JOIN b USING (track_id, life, run)""")
def stream_quarantine(spark, sf_dir):
    rows = _labels(spark, sf_dir).withColumn("doubtful", F.col("score") > 0.4)
    return _ended(spark, rows, lambda s: twins.quarantine(s, 2 * _GAP_MS, 3, _LATENESS, _FORGET_MS, _BUCKETS)).where("track_id >= 0")


@query("SELECT count(*) + 2 AS n FROM events")
def stream_heartbeat(spark, sf_dir):
    """The rows of all triggers of a stream, as its heartbeat tells them."""
    told: list[int] = []
    over = threading.Event()
    listener = twins.Heartbeat(lambda x: over.set() if "ended" in x else told.append(x.get("rows", 0)))
    spark.streams.addListener(listener)
    try:
        _ended(spark, _labels(spark, sf_dir), lambda s: s.select("track_id"))
        over.wait(60)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([(sum(told),)], "n long")
