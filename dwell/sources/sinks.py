"""Writers. Every sink is a Spark write, committed as a whole and partitioned by its tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwell import schemas
from dwell.operators import review
from dwell.operators import segments as S
from dwell.operators.graph import cut
from dwell.operators.sampling import debug_rows


def facebank(bank: DataFrame, samples: DataFrame, path: str) -> None:
    bank.select("label", F.col("count").cast("bigint").alias("count"), F.transform("embedding", lambda x: x.cast("float")).alias("embedding")).write.mode("overwrite").parquet(f"{path}/facebank.parquet")
    samples.select("label", "path").write.mode("overwrite").option("header", True).csv(f"{path}/samples.csv")
    entries = F.array_sort(F.collect_list(F.struct("label", F.col("count").cast("bigint").alias("count"))))
    meta = bank.agg(entries.alias("e")).select(F.transform("e", lambda x: x.label).alias("labels"), F.map_from_entries("e").alias("counts"), F.size("e").alias("num_labels"))
    meta.write.mode("overwrite").json(f"{path}/facebank_meta.json")


def manifest(tracks: DataFrame, samples: DataFrame, keys: list[str], path: str) -> None:
    """Tracks with their samples nested, in order of frame."""
    own = [c for c in samples.columns if c not in keys]
    nested = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame_idx", *(c for c in own if c != "frame_idx")))).alias("samples"))
    tracks.join(nested, keys, "left").write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _typed(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, cast; null where they are missing."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)))


def scenes(df: DataFrame, path: str) -> None:
    """scene_idx, start_frame and end_frame."""
    csv(_typed(df, schemas.SCENES), path)


def candidates(faces: DataFrame, path: str, width: float, height: float, least_area: float = 0.0) -> None:
    """Candidates of scenes (scene_idx, below 0 for none, frame_idx, det_idx, bbox, score): corners rounded half to even,
    the score as ``conf`` and the crop's path below the harvest. Left out are frames below 0, boxes that are empty, off
    the frame or below ``least_area`` of it."""
    box = {c: F.bround(F.col(f"bbox.{c}"), 0).cast("int") for c in ("x1", "y1", "x2", "y2")}
    rows = faces.where("frame_idx >= 0").withColumns(box)
    share = (F.col("x2") - F.col("x1")).cast("double") * (F.col("y2") - F.col("y1")) / (width * height)
    inside = (F.least("x2", F.lit(width)) > F.greatest("x1", F.lit(0))) & (F.least("y2", F.lit(height)) > F.greatest("y1", F.lit(0)))
    kept = rows.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (share >= least_area) & inside)
    place = F.when(F.col("scene_idx") >= 0, F.format_string("scene_%04d", F.col("scene_idx").cast("int"))).otherwise("noscenes")
    name = F.format_string("F%06d_C%02d.jpg", F.col("frame_idx").cast("int"), F.col("det_idx").cast("int"))
    csv(_typed(kept.withColumn("conf", F.coalesce("score", F.lit(1.0))).withColumn("rel_path", F.concat_ws("/", F.lit("candidates"), place, name)), schemas.CANDIDATES), path)


def preview(members: DataFrame, root: str, path: str) -> None:
    """Parquet of the members of preview clusters (cluster_id, below 0 for noise, scene_idx, frame_idx, rel_path): a
    cluster is a track, a noise sample one of its own, numbered after the clusters."""
    from dwell.operators.numbering import numbered_within

    top = members.agg(F.coalesce(F.max("cluster_id"), F.lit(-1)).alias("top"))
    noise = numbered_within(members.where("cluster_id < 0"), [], ["scene_idx", "frame_idx", "rel_path"], "nth").join(F.broadcast(top), F.lit(True))
    placed = members.where("cluster_id >= 0").withColumn("track_id", F.col("cluster_id").cast("long")).unionByName(noise.withColumn("track_id", F.col("nth") + F.greatest("top", F.lit(-1)) + 1).select(*members.columns, "track_id"))
    folder = F.when(F.col("cluster_id") >= 0, F.format_string("cluster_%04d", F.col("cluster_id").cast("int"))).otherwise("noise")
    relative = F.concat_ws("/", F.lit("clusters"), folder, F.substring_index("rel_path", "/", -1))
    named = placed.withColumn("cluster_rel_path", relative).withColumn("cluster_path", F.concat(F.lit(root.rstrip("/") + "/"), relative)).withColumn("label", F.lit(""))
    _typed(named, schemas.PREVIEW).write.mode("overwrite").parquet(path)


def append_assignments(log: DataFrame, path: str) -> DataFrame:
    """Appends entries, and returns them. Those with an ``entry_id`` are appended once: one that the log has, or that
    comes twice, isn't written again, so a run that is repeated after a failure changes nothing. Those without are
    appended as they are."""
    spark = log.sparkSession
    written = log.withColumn("when", F.date_format("when", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    if "entry_id" in written.columns:
        named = written.where("entry_id IS NOT NULL").dropDuplicates(["entry_id"])
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            known = spark.read.schema("entry_id string").option("mode", "DROPMALFORMED").json(path).where("entry_id IS NOT NULL")
            named = named.join(known, "entry_id", "left_anti").select(written.columns)
        written = cut(named.unionByName(written.where("entry_id IS NULL")))
    written.write.mode("append").json(path)
    return written


#: Parts that a samples table is kept in: a track is in one.
BUCKETS = 64


def samples_table(samples: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Samples as a Parquet table by buckets of tracks, so that an edit rewrites those of its tracks alone."""
    of = F.pmod(F.xxhash64("track_id"), F.lit(buckets)).cast("int")
    samples.withColumn("bucket", of).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def edit_table(spark: SparkSession, path: str, edits: DataFrame) -> list[int]:
    """Applies edits (``review.edit_samples``) to a samples table in place, and returns the buckets that it rewrote: those
    that hold a sample that an edit met. Others aren't touched; a second run finds nothing to change."""
    rows = spark.read.parquet(path)
    met = review.met_samples(rows, edits)
    changed = [r.bucket for r in met.where(F.size("edits") > 0).select("bucket").distinct().collect()]  # a number a bucket
    if not changed:
        return []
    done = cut(review.apply_edits(met.where(F.col("bucket").isin(changed)), rows.columns))
    done.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    full = {r.bucket for r in done.select("bucket").distinct().collect()}
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket in sorted(set(changed) - full):  # nothing is left of these
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"bucket={bucket}"), True)
    return sorted(changed)


def clusters(members: DataFrame, path: str) -> None:
    """Sorted tracks of each cluster; bucket 0 is always there. The file is one document, so all clusters meet in one task:
    it is for reviews of up to some million tracks; ``members`` itself is the table for more."""
    lists = members.groupBy("cluster_id").agg(F.array_sort(F.collect_set("track_id")).alias("tracks"))
    empty = members.sparkSession.range(1).select(F.lit(0).alias("cluster_id"))
    both = empty.join(lists, "cluster_id", "full_outer").withColumn("tracks", F.coalesce("tracks", F.array().cast(lists.schema["tracks"].dataType)))
    both.agg(F.array_sort(F.collect_list(F.struct(F.col("cluster_id").alias("id"), "tracks"))).alias("clusters")).write.mode("overwrite").json(path)


def tracker_outputs(segments: DataFrame, keys: list[str], total_seconds: int, labels: list[str], path: str) -> None:
    """Totals (CSV and JSON), segments, their copy by track, and both timelines, off one cached table."""
    own = segments.persist()
    try:
        sums = S.totals(own).orderBy(F.desc("total_ms"), "label")
        csv(sums, f"{path}/totals.csv")
        sums.write.mode("overwrite").json(f"{path}/totals.json")
        csv(own, f"{path}/segments.csv")
        csv(own, f"{path}/tracks.csv")
        csv(S.timeline_wide(own, total_seconds, labels), f"{path}/timeline.csv")
        csv(S.timeline_long(own, keys, total_seconds), f"{path}/track_timeline.csv")
    finally:
        own.unpersist()


#: Logs of all boxes name each field again for each box: packed they take a fraction, and readers unpack them by their suffix.
_LOG = {"compression": "gzip"}


def annotations(frames: DataFrame, path: str, segments: DataFrame | None = None, fps: float = 0.0) -> None:
    """One JSON row a frame with its boxes, (frame_idx, track_id, bbox as four numbers, label, score), packed; and beside
    them one a segment, with its frames, where segments are given."""
    frames.groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("track_id", "bbox", "label", "score"))).alias("tracks")).write.mode("overwrite").options(**_LOG).json(f"{path}/frames")
    if segments is not None:
        S.frame_window(segments, fps).write.mode("overwrite").json(f"{path}/segments")


def frame_events(events: DataFrame, path: str) -> None:
    """One JSON row a frame with its events: (frame_idx, track_id, bbox as four numbers, label, reason, score), packed."""
    of = F.struct("track_id", "bbox", "label", "reason", "score")
    events.groupBy("frame_idx").agg(F.array_sort(F.collect_list(of)).alias("events")).write.mode("overwrite").options(**_LOG).json(path)


def selected_samples(samples: DataFrame, keys: list[str], path: str, most: int = 20, ties: tuple[str, ...] | list[str] = ()) -> None:
    """CSV of the best ``most`` samples of each track by quality, in the fixed columns; a missing one stays empty."""
    best = debug_rows(samples, keys, most, list(ties)).withColumn("frame", F.col("frame_idx"))
    csv(best.select(*(F.col(c) if c in best.columns else F.lit(None).cast("string").alias(c) for c in schemas.SELECTED_COLUMNS)), path)


def reports(per_track: DataFrame, totals: DataFrame, path: str) -> None:
    """A validation's table as CSV, and its (metric, value) rows as one JSON object."""
    csv(per_track.orderBy("track_id"), f"{path}/tracks.csv")
    totals.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics")).select("metrics").write.mode("overwrite").json(f"{path}/metrics.json")


def totals_json_to_csv(totals: DataFrame, path: str) -> None:
    csv(totals, path)
