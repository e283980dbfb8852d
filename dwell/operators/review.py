"""Track summaries, assignment bookkeeping, clusters under review and validation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dwell.functions.text import assignment_status, canonical_path
from dwell.operators.graph import cut
from dwell.operators.numbering import numbered
from dwell.operators.quantiles import quantiles


def mode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value, the smallest on a tie."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(column))


def with_median(summary: DataFrame, rows: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """Adds the median of a column of each group's rows (``quantiles``)."""
    medians = quantiles(rows, keys, column, {out: 0.5})
    if not keys:
        return summary.join(F.broadcast(medians), F.lit(True), "left")  # a row each
    of = lambda df: df.withColumn("__of", F.struct(*keys))
    return of(summary).join(of(medians).drop(*keys), "__of", "left").drop("__of")


def sample_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    own = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if("picked").alias("picked"),
        F.count_if(~F.col("picked")).alias("rejected"),
        F.avg("quality").alias("avg_quality"),
        F.max("quality").alias("max_quality"),
    )
    both = with_median(own, samples, keys, "quality", "median_quality")
    return both.select(*keys, "n_samples", "picked", "rejected", "avg_quality", "median_quality", "max_quality")


def track_stats(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Span, mean score and mean area of each track, and its first and last time."""
    return observations.groupBy(*keys).agg(
        F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), (F.max("frame_idx") - F.min("frame_idx") + 1).alias("duration_frames"),
        F.avg("score").alias("avg_score"), F.avg("area").alias("avg_area"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"),
    )


def _moment(each: DataFrame) -> Column:
    """The order of rows by ``when`` and ``pos``, nulls first: a number where ``when`` is one or a time, as hash aggregates
    take the least of those; a struct of both where it is of another kind."""
    when, kind = F.col("when"), each.schema["when"].dataType
    if not isinstance(kind, T.TimestampType | T.IntegralType):
        return F.struct("when", "pos")
    units = F.unix_micros(when) if isinstance(kind, T.TimestampType) else when
    # times lie 2^32 apart and places between them; a missing time is before all others
    placed = F.coalesce(units.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(11,0)"), F.lit("-1e30").cast("decimal(32,0)"))
    return placed + F.coalesce("pos", F.lit(-1)).cast("decimal(11,0)")


def assignment_index(log: DataFrame, keys: list[str]) -> DataFrame:
    """Per track of an assignment log (person, when, files array of source, dest): persons, sources and destinations in
    order of first appearance, and the first person of each source and of each destination. Empty names are none.

    An entry is a row for each person, source and destination it names: values are first reduced by track, kind, value and
    person, then by track, kind and value, then gathered by track. Times and places are one number (``_moment``), so that
    the first step, the only one over all rows, is a hash map of distinct values, not a sort of the rows.
    """
    each = log.select(*keys, F.nullif("person", F.lit("")).alias("person"), "when", F.posexplode_outer("files").alias("pos", "file"))
    said = F.array(*(F.struct(F.lit(k).alias("kind"), F.nullif(c, F.lit("")).alias("v")) for k, c in (("person", F.col("person")), ("source", F.col("file.source")), ("dest", F.col("file.dest")))))
    rows = each.select(*keys, "person", _moment(each).alias("k"), F.explode(said).alias("x")).select(*keys, "x.kind", "x.v", "k", "person")
    own = rows.groupBy(*keys, "kind", "v", "person").agg(F.min("k").alias("k"))
    first = own.groupBy(*keys, "kind", "v").agg(F.min("k").alias("k"), F.min_by("person", F.when(F.col("person").isNotNull(), F.col("k"))).alias("p"))
    one = lambda kind: (F.col("kind") == kind) & F.col("v").isNotNull()
    ordered = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(one(kind), F.struct("k", "v")))), lambda x: x.v)
    owned = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(one(kind) & F.col("p").isNotNull(), F.struct("v", "p")))))
    lists = first.groupBy(*keys).agg(ordered("person").alias("persons"), ordered("source").alias("sources"), ordered("dest").alias("destinations"), owned("source").alias("source_person"), owned("dest").alias("destination_person"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return lists.select(*keys, *map(some, ("persons", "sources", "destinations", "source_person", "destination_person")))


def track_summary(manifest: DataFrame, summary: DataFrame, assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Manifest and samples by track, whichever has it, with the number of assigned sources and the status."""
    both = manifest.join(summary, keys, "full_outer").join(assigned, keys, "left")
    both = both.fillna(0, [c for c in ("n_samples", "picked", "rejected", "assigned") if c in both.columns])
    return both.withColumn("status", assignment_status(F.col("assigned"), F.col("picked")))


def filter_tracks(summary: DataFrame, min_picked: int = 0, min_frames: int = 0, min_quality: float = 0.0, search: str | None = None, columns: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """``search`` is a regular expression over ids and persons."""
    out = summary.where((F.coalesce("picked", F.lit(0)) >= min_picked) & (F.coalesce("duration_frames", F.lit(0)) >= min_frames) & (F.coalesce("max_quality", F.lit(0.0)) >= min_quality))
    if search:
        out = out.where(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))).rlike(search.lower()))
    return out


def samples_of(samples: DataFrame, keys: list[str], track: dict) -> DataFrame:
    """A track's samples without debug ones, picked first, then by frame."""
    out = samples.where(~F.coalesce("is_debug", F.lit(False)))
    for k in keys:
        out = out.where(F.col(k) == track[k])
    return out.orderBy(F.desc("picked"), "frame_idx")


def review_order(summary: DataFrame) -> DataFrame:
    rank = F.when(F.col("status") == "Unassigned", 0).when(F.col("status") == "Partially", 1).otherwise(2)
    return summary.orderBy(F.asc_nulls_last("cluster_id"), rank, F.desc_nulls_last("picked"), F.desc_nulls_last("max_quality"), F.asc_nulls_last("track_id"))


def table_order(summary: DataFrame, by: str) -> DataFrame:
    keys = {"samples": [F.desc("n_samples")], "quality": [F.desc(F.coalesce("avg_quality", F.lit(-1.0)))], "id": []}[by]
    return summary.orderBy(*keys, "track_id")


def new_assignments(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests with the reason they are skipped for, null for those to carry out: a source that is already assigned,
    or a destination that an earlier request takes."""
    known = done.select("source").distinct().withColumn("was", F.lit(True))
    first = Window.partitionBy("dest").orderBy("source")
    marked = requests.join(known, "source", "left").withColumn("nth", F.row_number().over(first))
    return marked.withColumn("skipped", F.when(F.col("was"), "already_assigned").when(F.col("nth") > 1, "duplicate_destination")).drop("was", "nth")


def met_samples(samples: DataFrame, edits: DataFrame) -> DataFrame:
    """Samples with ``edits``, those that meet them, in order of edit_id.

    An edit meets the samples of its track and frame (of its track where it has no frame); where there are none, those
    of its path, written in one way; where there are none either, those whose path ends in its file name. Samples and
    edits are rows for each key they go by, joined once; of an edit the matches of its first way count.
    """
    rows = cut(samples.withColumn("__id", F.monotonically_increasing_id()))
    long, text = lambda c: F.col(c).cast("long"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = lambda way, value: F.struct(F.lit(way).alias("way"), value.cast("string").alias("key"))
    name = F.substring_index("original_path", "/", -1)
    asked = edits.withColumn("__edit", F.struct("edit_id", "action", "new_path"))
    at = F.when(F.col("frame_idx").isNull(), key(1, long("track_id"))).otherwise(key(0, F.concat_ws("/", long("track_id"), long("frame_idx"))))
    wanted = cut(asked.select("__edit", F.explode(F.array(at, key(2, canonical_path(F.col("original_path"))), key(3, name))).alias("k")).where("k.key IS NOT NULL").select("__edit", "k.*"))
    # a length of a file name: some hundred at most
    lengths = sorted(r.n for r in wanted.where("way = 3 AND key <> ''").select(F.length("key").alias("n")).distinct().collect())
    ends = [F.when(F.length("path") >= n, key(3, F.right(F.col("path"), F.lit(n)))) for n in lengths]
    own = [F.when(long("track_id").isNotNull() & long("frame_idx").isNotNull(), key(0, F.concat_ws("/", long("track_id"), long("frame_idx")))), key(1, long("track_id")), key(2, canonical_path(F.col("path"))), *ends]
    have = rows.select("__id", F.explode(F.array(*own)).alias("k")).where("k.key IS NOT NULL").select("__id", "k.*")
    # by exchanges: what Spark takes for the size of these rows is that of the file behind them, so it would collect and send them
    matches = cut(have.join(wanted.hint("merge"), ["way", "key"]).select("__id", "__edit", "way"))
    first = matches.groupBy("__edit").agg(F.min("way").alias("way"))
    met = matches.join(first.hint("merge"), ["__edit", "way"]).groupBy("__id").agg(F.array_sort(F.collect_set("__edit")).alias("edits"))
    none = F.array().cast(met.schema["edits"].dataType)
    return rows.join(met.hint("merge"), "__id", "left").withColumn("edits", F.coalesce("edits", none)).drop("__id")


def apply_edits(met: DataFrame, columns: list[str]) -> DataFrame:
    """``met_samples`` after their edits: deleted ones go, unassigned ones are not picked and say so, and the last new path
    counts."""
    some = lambda action: F.exists("edits", lambda e: e.action == action)
    paths = F.filter("edits", lambda e: e.action.isin("unassign", "path_update") & e.new_path.isNotNull())
    changed = {"path": F.coalesce(F.get(paths, F.size(paths) - 1)["new_path"], F.col("path")), "picked": F.when(some("unassign"), False).otherwise(F.col("picked") if "picked" in columns else F.lit(True))}
    if "reason" in columns:
        changed["reason"] = F.when(some("unassign"), "manual_unassigned").otherwise(F.col("reason"))
    return met.where(~F.coalesce(some("delete"), F.lit(False))).withColumns(changed).select(*columns)


def edit_samples(samples: DataFrame, edits: DataFrame) -> DataFrame:
    """Samples after edits (edit_id, track_id, frame_idx or null, original_path, action delete | unassign | path_update,
    new_path): all that meet a sample act on it, in order of edit_id. What an edit meets is found in the table as given."""
    return apply_edits(met_samples(samples, edits), samples.columns)


def move_track(clusters: DataFrame, track_id: int, cluster_id: int) -> DataFrame:
    """(cluster_id, track_id) with the track in that cluster alone; cluster 0 holds the unassigned."""
    new = clusters.sparkSession.createDataFrame([(cluster_id, track_id)], "cluster_id int, track_id long")
    return clusters.where(F.col("track_id") != track_id).select(F.col("cluster_id").cast("int").alias("cluster_id"), F.col("track_id").cast("long").alias("track_id")).unionByName(new).distinct()


def reindex_clusters(members: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Clusters of at least ``min_size`` numbered from 0 in their order, and the members of the others."""
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    kept = numbered(sizes.where(F.col("size") >= min_size), "cluster_id", "new_id")
    return members.join(kept, "cluster_id").drop("size"), members.join(kept, "cluster_id", "left_anti")


def cluster_inputs(samples: DataFrame, min_sharpness: float, min_area: float, min_samples: int) -> DataFrame:
    """Picked samples above the floors, of tracks that keep enough of them."""
    good = samples.where(F.col("picked") & ~F.coalesce("is_debug", F.lit(False)) & (F.col("sharpness") >= min_sharpness) & (F.col("area_frac") >= min_area))
    enough = good.groupBy("track_id").agg(F.count(F.lit(1)).alias("kept")).where(F.col("kept") >= min_samples)
    return good.join(enough, "track_id")


def validation(samples: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """Per track: samples, picked, qualities, and samples without an image and images without a sample."""
    own = sample_summary(samples, keys)
    missing = samples.join(images.select("path").distinct(), "path", "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("missing"))
    extra = images.join(samples.select("path").distinct(), "path", "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("extra"))
    return own.join(missing, keys, "left").join(extra, keys, "full_outer").fillna(0, ["n_samples", "picked", "rejected", "missing", "extra"])


def validation_report(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Per track of a manifest (samples nested): samples, those without an image or a path, images of its directory,
    duration, and means of the samples that have a path."""
    images = images.select("track_id", "path").distinct()
    each = cut(_checked(manifest, images))
    mean = lambda c: F.avg(F.when(F.col("path").isNotNull(), F.col(c)))
    per = each.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(~F.col("there")).alias("missing_samples"), mean("quality").alias("avg_quality"),
        *(mean(c).alias(f"avg_{c}") for c in ("sharpness", "frontalness", "score")),
    )
    per = with_median(per, each.where(F.col("path").isNotNull()), ["track_id"], "quality", "median_quality")
    listed = images.groupBy("track_id").agg(F.count(F.lit(1)).alias("directory_images"))
    seconds = ((F.col("last_ts_ms") - F.col("first_ts_ms")) / 1000).alias("duration_seconds")
    label = F.col("label") if "label" in manifest.columns else F.lit(None).cast("string")
    own = manifest.select("track_id", "byte_track_id", label.alias("label"), seconds, "total_frames")
    return own.join(per, "track_id", "left").join(listed, "track_id", "left").fillna(0, ["sample_count", "missing_samples", "directory_images"])


def _checked(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """A manifest's samples, each with whether its image is there."""
    each = manifest.select("track_id", F.explode("samples").alias("s")).select("track_id", "s.path", "s.quality", "s.sharpness", "s.frontalness", "s.score")
    return each.join(images.select("path").distinct().withColumn("there", F.lit(True)).hint("merge"), "path", "left").fillna(False, ["there"])


def validation_totals(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """(metric, value) of a whole manifest: counts, means and medians over all samples, files, and directories that
    only one side has. Paths meet by exchanges: what Spark takes for the size of checkpointed rows is that of the files
    they came from, so it would send all paths to each executor."""
    images = images.select("track_id", "path").distinct()
    images = cut(images)
    each = cut(_checked(manifest, images).where(F.col("path").isNotNull()))

    def metrics(df: DataFrame, **aggregates) -> DataFrame:
        return told(df.agg(*(c.cast("double").alias(n) for n, c in aggregates.items())))

    def told(one: DataFrame) -> DataFrame:
        return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in one.columns))).alias("m")).select("m.*")

    sizes = manifest.select("track_id", F.coalesce(F.size("samples"), F.lit(0)).alias("n")).withColumn("n", F.greatest("n", F.lit(0)))
    dirs, tracks = images.select("track_id").distinct(), manifest.select("track_id").distinct()
    count = F.count(F.lit(1))
    parts = [
        metrics(sizes, total_tracks=count, total_samples=F.coalesce(F.sum("n"), F.lit(0)), samples_per_track_mean=F.avg("n")),
        told(quantiles(sizes, [], "n", {"samples_per_track_median": 0.5})),
        told(quantiles(each, [], "quality", {"quality_median": 0.5})),
        metrics(
            each, quality_mean=F.avg("quality"), sharpness_mean=F.avg("sharpness"), frontalness_mean=F.avg("frontalness"), score_mean=F.avg("score"), referenced_files=count,
            existing_files=F.count_if("there"),
        ),
        metrics(images.join(each.select("path").hint("merge"), "path", "left_anti"), extra_images=count),
        metrics(dirs.join(tracks.hint("merge"), "track_id", "left_anti"), extra_track_dirs=count),
        metrics(tracks.join(dirs.hint("merge"), "track_id", "left_anti"), missing_track_dirs=count),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def track_clusters(tracks: DataFrame, members: DataFrame, cluster_id: int | None = None) -> DataFrame:
    """Tracks with the cluster they are in, the least of several, null for none; or those of one cluster."""
    of = members.groupBy("track_id").agg(F.min("cluster_id").alias("cluster_id"))
    both = tracks.drop("cluster_id").join(of, "track_id", "left")
    return both if cluster_id is None else both.where(F.col("cluster_id") == cluster_id)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def mixed_tracks(similarities: DataFrame, keys: list[str], threshold: float, least: int) -> DataFrame:
    """Tracks with several samples near their centre and several far from it."""
    far = F.count_if(F.col("similarity") < 1 - threshold)
    near = F.count_if(F.col("similarity") >= 1 - threshold)
    return similarities.groupBy(*keys).agg(near.alias("near"), far.alias("far")).withColumn("mixed", (F.col("near") >= least) & (F.col("far") >= least))


def seed_candidates(lowconf: DataFrame, annotations: DataFrame, wanted: list[str], min_score: float) -> DataFrame:
    """Low-confidence rows of wanted labels with their box, once for each (frame, track, label)."""
    rows = lowconf.where(F.upper("label").isin(wanted) & (F.col("score") >= min_score)).groupBy("frame_idx", "track_id", "label").agg(F.max("score").alias("score"))
    boxes = annotations.where(F.col("bbox").isNotNull() & (F.col("bbox.x2") > F.col("bbox.x1")) & (F.col("bbox.y2") > F.col("bbox.y1")))
    return rows.join(boxes, ["frame_idx", "track_id"])


def exit_status(per_track: DataFrame, fail_on_missing: bool = False, allow_extra: bool = False, allow_empty: bool = False, mixed: int = 0, allow_mixed: bool = False, max_tracks: int = 24) -> int:
    """1 when a validation rule is broken; one row comes to the driver."""
    t = per_track.agg(F.sum("missing"), F.sum("extra"), F.count_if(F.coalesce("n_samples", F.lit(0)) == 0), F.count(F.lit(1))).first()
    missing, extra, empty, tracks = (x or 0 for x in t)
    return int(fail_on_missing and missing > 0 or not allow_extra and extra > 0 or not allow_empty and empty > 0 or not allow_mixed and mixed > 0 or 0 < max_tracks < tracks)


def scene_counts(scenes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates in each scene, none included; a frame is in one scene at most."""
    frames = scenes.select("scene_idx", F.explode(F.sequence("start_frame", "end_frame")).alias("frame_idx"))
    n = candidates.groupBy("frame_idx").agg(F.count(F.lit(1)).alias("c"))
    counted = frames.join(n, "frame_idx").groupBy("scene_idx").agg(F.sum("c").alias("n"))
    return scenes.select("scene_idx").join(counted, "scene_idx", "left").fillna(0, ["n"])


def cluster_preview(members: DataFrame) -> DataFrame:
    """Per cluster: number, distinct scenes in order, first and last frame."""
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("scene_idx")).alias("scenes"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))
