"""Readers: explicit schemas, lenient casts, missing fields as null or their documented default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwell import schemas
from dwell.config import DEFAULT as C
from dwell.functions.text import frame_of, relative_to_track, track_of, truthy
from dwell.operators.graph import cut


def box_of(xyxy: Column) -> Column:
    """An array of four numbers as a box; null for any other array."""
    part = lambda k, n: F.get(xyxy, F.lit(k)).alias(n)
    return F.when(F.size(xyxy) == 4, F.struct(part(0, "x1"), part(1, "y1"), part(2, "x2"), part(3, "y2")))


def whole(x: Column) -> Column:
    """A number given in any way as a long, what follows its point dropped; exact at any size, null for no number."""
    return F.trim(x.cast("string")).try_cast("decimal(38,6)").try_cast("long")


def real(x: Column) -> Column:
    """A number as a double; null for none, and for NaN."""
    out = F.trim(x.cast("string")).try_cast("double")
    return F.when(~F.isnan(out), out)


def _json(spark: SparkSession, schema: T.StructType | str, path: str) -> DataFrame:
    """A file is one document; a folder, as Spark writes it, has a JSON row a line."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return spark.read.schema(schema).option("multiLine", not folder).json(path)


def detections(spark: SparkSession, path: str, stride: int = C.stride) -> DataFrame:
    """Parquet detections of every ``stride``-th frame, a filter on the rows that the scan gives."""
    rows = spark.read.schema(schemas.DETECTIONS).parquet(path)
    return rows.where(F.col("frame_idx") % stride == 0) if stride > 1 else rows


def facebank_images(spark: SparkSession, path: str) -> DataFrame:
    """Images below a label directory each: path and label, no content."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    images = listed.where(F.lower(F.col("path")).rlike(r"\.(jpg|jpeg|png)$"))
    return images.select("path", F.element_at(F.split("path", "/"), -2).alias("label"))


def facebank(spark: SparkSession, path: str) -> DataFrame:
    return normalize_embeddings(spark.read.schema(schemas.FACEBANK).parquet(path))


def facebank_meta(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, schemas.FACEBANK_META, path)


def normalize_embeddings(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Nested arrays flattened; elements as float."""
    kind = df.schema[column].dataType
    flat = F.flatten(column) if kind.elementType.typeName() == "array" else F.col(column)
    return df.withColumn(column, F.transform(flat, lambda x: x.cast("float")))


#: Numbers of a manifest that may be given as text.
_LENIENT = ("track_id", "byte_track_id", "total_frames", "avg_conf", "avg_area", "first_ts_ms", "last_ts_ms")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Numbers given as text are numbers, and null where they are none."""
    schema = T.StructType.fromDDL(schemas.MANIFEST)
    lenient = T.StructType([T.StructField(f.name, T.StringType() if f.name in _LENIENT else f.dataType) for f in schema])
    rows = _json(spark, lenient, path)
    number = lambda f: real(F.col(f.name)) if isinstance(f.dataType, T.DoubleType) else whole(F.col(f.name)).try_cast(f.dataType)
    return rows.select(*(number(f).alias(f.name) if f.name in _LENIENT else f.name for f in schema))


def manifest_or_fallback(spark: SparkSession, path: str, fallback: bool) -> DataFrame:
    """The manifest, or one row of track 1 where it is missing or empty and the caller asks for it."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    rows = manifest(spark, path) if there else spark.createDataFrame([], schemas.MANIFEST)
    if fallback and rows.isEmpty():
        return spark.createDataFrame([(1, 1, 0, None, None, None, None, [])], schemas.MANIFEST)
    return rows


def samples_of_manifest(rows: DataFrame) -> DataFrame:
    return rows.select("track_id", "byte_track_id", F.explode_outer("samples").alias("s")).select("track_id", "byte_track_id", "s.*")


#: Columns of a samples file by how they are read; others are text.
_LONGS, _DOUBLES = ("track_id", "byte_track_id"), ("quality", "sharpness", "frontalness", "area_frac", "association_iou", "identity_cosine", "similarity_to_centroid")


def selected_samples(spark: SparkSession, path: str) -> DataFrame:
    """CSV of samples, with all columns of the file: those of ``schemas.SELECTED_COLUMNS``, ``frame`` as ``frame_idx``, and
    ``orientation`` and ``is_debug``.

    Numbers are read leniently. A missing tracker id is that of the track, which is -1 where it is none; without a column
    for the frame it is taken from the file's name. ``picked`` is true and ``reason`` is "picked" where their columns are
    missing, and ``picked`` also where it is empty. Other missing columns are null.
    """
    rows = spark.read.option("header", True).csv(path)
    have = {c.lower() for c in rows.columns}
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    track = F.coalesce(whole(text("track_id")), F.lit(-1))
    frame = next((whole(text(c)) for c in ("frame", "frame_idx") if c in have), None)
    named = frame_of(F.substring_index("path", "/", -1))
    out = {
        "track_id": track, "byte_track_id": F.coalesce(whole(text("byte_track_id")), track), "frame_idx": (F.when(named >= 0, named) if frame is None else frame).try_cast("int"),
        **{c: real(text(c)) for c in _DOUBLES}, "picked": F.coalesce(truthy(text("picked")), F.lit(True)), "reason": text("reason") if "reason" in have else F.lit("picked"),
        "path": text("path"), "match_mode": text("match_mode"), "frame_offset": whole(text("frame_offset")).try_cast("int"), "provider": text("provider"),
        "recall_only": truthy(text("recall_only")), "orientation": text("orientation"), "is_debug": F.lit(False),
    }
    order = ["frame_idx" if c == "frame" else c for c in schemas.SELECTED_COLUMNS]
    return rows.select(*(out[c].alias(c) for c in [*order, "orientation", "is_debug"]))


def scanned_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Fallback without a CSV: files below ``track_<n>`` directories; debug ones aren't picked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    images = files.where(F.lower("path").rlike(r"\.(jpg|jpeg|png)$") & F.col("path").rlike(r"track_\d+"))
    debug = F.col("path").rlike(r"/debug/")
    return images.select(track_of(F.col("path")).cast("long").alias("track_id"), frame_of(F.element_at(F.split("path", "/"), -1)).alias("frame_idx"), (~debug).alias("picked"), debug.alias("is_debug"), "path")


def all_samples(selected: DataFrame, debug: DataFrame) -> DataFrame:
    """Samples and debug samples with the columns of either."""
    return selected.withColumn("is_debug", F.lit(False)).unionByName(debug.withColumn("is_debug", F.lit(True)), allowMissingColumns=True)


def resolve_paths(samples: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Adds ``resolved``, the first that exists of: the path itself where it is absolute, the path below ``root``, its part
    from ``track_`` on below root; and, for samples with a track and a frame, the candidate crop of that frame with the
    path's suffix, the same as .jpg, and the track's debug crop of the path's name. Null where none does.

    A sample's tries are rows of one join with the listing, of which the first that is there counts.
    """
    base = root.rstrip("/") + "/"
    listed = files.select(F.regexp_replace("path", r"^file:/+", "/").alias("file")).distinct()
    path, name = F.col("path"), F.substring_index("path", "/", -1)
    suffix = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    tries = [F.when(path.startswith("/"), path), F.when(~path.startswith("/"), F.concat(F.lit(base), path)), F.concat(F.lit(base), F.nullif(F.regexp_extract("path", r"(?:^|/)(track_.*)$", 1), F.lit("")))]
    if {"track_id", "frame_idx"} <= set(samples.columns):
        crop = F.concat(F.lit(base), F.format_string("candidates/track_%04d/F%06d", "track_id", "frame_idx"))
        there = F.col("track_id").isNotNull() & F.col("frame_idx").isNotNull()
        debug = F.concat(F.lit(base), F.format_string("track_%04d/debug/", "track_id"), name)
        tries += [F.when(there, F.concat(crop, F.when(suffix == "", ".jpg").otherwise(suffix))), F.when(there, F.concat(crop, F.lit(".jpg"))), F.when(there, debug)]
    rows = cut(samples.withColumn("__id", F.monotonically_increasing_id()))
    each = rows.select("__id", F.posexplode(F.array(*tries)).alias("nth", "file")).where("file IS NOT NULL")
    found = each.join(listed, "file").groupBy("__id").agg(F.min_by("file", "nth").alias("resolved"))
    return rows.join(found, "__id", "left").drop("__id")


def relative_paths(manifest: DataFrame) -> DataFrame:
    """A manifest whose samples' paths begin at their track's directory, or are their file names without one; empty paths
    stay as they are."""
    short = lambda p: F.when(relative_to_track(p) == p, F.when(p.startswith("track_"), p).otherwise(F.substring_index(p, "/", -1))).otherwise(relative_to_track(p))
    return manifest.withColumn("samples", F.transform("samples", lambda x: x.withField("path", F.when(F.coalesce(x.path, F.lit("")) == "", x.path).otherwise(short(x.path)))))


def _file(entry: Column) -> Column:
    """(source, dest) of a file of the log: an object by any of its names, or a plain destination."""
    of = lambda *names: F.coalesce(*(F.nullif(F.get_json_object(entry, f"$.{n}"), F.lit("")) for n in names))
    plain = F.struct(F.lit(None).cast("string").alias("source"), F.nullif(entry, F.lit("")).alias("dest"))
    return F.when(entry.startswith("{"), F.struct(of("source", "src", "path").alias("source"), of("dest", "destination", "target").alias("dest"))).otherwise(plain)


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the log that are whole; blank and malformed ones are skipped. Ids may be text, and are -1 where they are no
    numbers; a missing stem is empty, missing files are none."""
    rows = spark.read.schema(schemas.ASSIGNMENTS).option("mode", "DROPMALFORMED").json(path)
    number = lambda c: F.coalesce(whole(F.col(c)).try_cast("int"), F.lit(-1))
    return rows.select(
        F.coalesce("stem", F.lit("")).alias("stem"), number("harvest_id").alias("harvest_id"), number("byte_track_id").alias("byte_track_id"), "person",
        F.coalesce(F.transform("files", _file), F.array().cast("array<struct<source:string,dest:string>>")).alias("files"), F.try_to_timestamp("when").alias("when"), "app_version", "entry_id",
    )


def cluster_lists(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, tracks in order): ids below 0 and empty clusters are left out, bucket 0 is always there."""
    rows = _json(spark, schemas.CLUSTERS, path)
    each = rows.select(F.explode("clusters").alias("c")).where("c.id >= 0 AND size(c.tracks) > 0").select(F.col("c.id").alias("cluster_id"), F.explode("c.tracks").alias("track_id"))
    empty = spark.range(1).select(F.lit(0).alias("cluster_id"), F.lit(None).cast("int").alias("track_id"))
    return each.unionByName(empty).groupBy("cluster_id").agg(F.array_sort(F.collect_set("track_id")).alias("tracks"))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, track_id) of the tracks that are in a cluster."""
    return cluster_lists(spark, path).select("cluster_id", F.explode("tracks").alias("track_id"))


def progress(spark: SparkSession, path: str) -> DataFrame:
    """frames_total, frames_done and tracks, 0 where they are missing, percent, null where it is missing or no number, and
    the document itself as ``raw``. Documents that are no JSON object are left out, and so is a missing file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        texts = spark.createDataFrame([], "value string")
    else:
        texts = spark.read.text(path, wholetext=not fs.getFileStatus(at).isDirectory())
    parsed = texts.select(F.col("value").alias("raw"), F.from_json("value", schemas.PROGRESS + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("p"))
    number = lambda c: F.coalesce(whole(F.col(f"p.{c}")).try_cast("int"), F.lit(0)).alias(c)
    good = F.col("p").isNotNull() & F.col("p._corrupt_record").isNull() & F.trim("raw").startswith("{")
    return parsed.where(good).select(number("frames_total"), number("frames_done"), real(F.col("p.percent")).alias("percent"), number("tracks"), "raw")


def low_confidence(spark: SparkSession, path: str, wanted: list[str], min_score: float) -> DataFrame:
    rows = spark.read.schema(schemas.LOWCONF).option("header", True).csv(path).withColumn("label", F.upper("label"))
    return rows.where(F.col("label").isin(wanted) & (F.col("score") >= min_score))


def annotation_index(spark: SparkSession, path: str) -> DataFrame:
    """(frame_idx, track_id, bbox, label, score) of an annotation file, the last entry of a key."""
    rows = _json(spark, schemas.ANNOTATIONS, path)
    each = rows.select(F.explode("frame_annotations").alias("frame", "list")).select(F.col("frame").try_cast("int").alias("frame_idx"), F.posexplode("list").alias("pos", "a"))
    last = each.groupBy("frame_idx", F.col("a.track_id").alias("track_id")).agg(F.max_by("a", "pos").alias("a"))
    return last.select("frame_idx", "track_id", box_of(F.col("a.bbox")).alias("bbox"), F.col("a.label").alias("label"), F.col("a.score").alias("score"))


def frame_events(spark: SparkSession, path: str) -> DataFrame:
    """(frame_idx, track_id, bbox, label, reason, score) of a debug log: one document by frame, or a row a frame."""
    rows = _json(spark, schemas.EVENTS, path)
    of_map = rows.select(F.explode("frame_events").alias("frame", "list")).select(F.col("frame").try_cast("int").alias("frame_idx"), F.explode("list").alias("e"))
    own = rows.where(F.col("events").isNotNull()).select("frame_idx", F.explode("events").alias("e"))
    return of_map.unionByName(own).select("frame_idx", "e.track_id", box_of(F.col("e.bbox")).alias("bbox"), "e.label", "e.reason", "e.score")


def annotated_events(spark: SparkSession, path: str) -> DataFrame:
    """The same of a tracker run's annotations: boxes as events whose reason is ``track``."""
    rows = _json(spark, schemas.RUN, path)
    frames = rows.select(F.explode("frame_annotations").alias("f")).select("f.frame_idx", "f.tracks").unionByName(rows.where(F.col("tracks").isNotNull()).select("frame_idx", "tracks"))
    each = frames.where("frame_idx >= 0").select("frame_idx", F.explode("tracks").alias("e")).where(F.size("e.bbox") > 0)
    return each.select("frame_idx", "e.track_id", box_of(F.col("e.bbox")).alias("bbox"), "e.label", F.lit("track").alias("reason"), "e.score")


def events_or_annotations(spark: SparkSession, path: str, annotations: str, use_annotations: bool = False) -> DataFrame:
    """The debug log's events, or those of the annotations where it is missing or they are asked for."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not use_annotations and at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return frame_events(spark, path)
    return annotated_events(spark, annotations)


def scenes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCENES).option("header", True).csv(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CANDIDATES).option("header", True).csv(path)


def preview(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PREVIEW).parquet(path)


def totals(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, schemas.TOTALS, path)
