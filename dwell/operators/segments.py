"""From labels by frame to segments, totals and timelines.

Inputs have one row for each (track, frame); ``keys`` name the columns of a track, so several videos go together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwell.config import DEFAULT as C
from dwell.functions.text import known_label
from dwell.operators.graph import cut


def half_even(x: float) -> int:
    return round(x)


def last_per_frame(events: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """The last write of each (track, frame) that carries a label."""
    best = events.where(known_label(F.col("label"))).groupBy(*keys, "frame_idx").agg(F.max_by(F.struct("label", "score"), F.col(tie)).alias("v"))
    return best.select(*keys, "frame_idx", "v.label", "v.score")


def fragments(obs: DataFrame, keys: list[str], stride: int = 1, frames: DataFrame | None = None, video: list[str] | None = None) -> DataFrame:
    """A track ends when one processed frame passes without it; its next appearance is a new fragment.

    Processed frames are the multiples of ``stride``; or else those listed in ``frames`` (columns ``video`` and
    frame_idx), which are ranked within each video.
    """
    if frames is None:
        ranked = obs.withColumn("frame_ord", F.floor(F.col("frame_idx") / stride))
    else:
        order = Window.partitionBy(*video).orderBy("frame_idx")
        ords = frames.select(*video, "frame_idx").distinct().withColumn("frame_ord", F.row_number().over(order))
        ranked = obs.join(ords, [*video, "frame_idx"])
    w = Window.partitionBy(*keys).orderBy("frame_ord")
    gap = F.coalesce(F.col("frame_ord") - F.lag("frame_ord").over(w) > 1, F.lit(False)).cast("int")
    return ranked.withColumn("gap", gap).withColumn("fragment_id", F.sum("gap").over(w)).drop("gap", "frame_ord")


def islands(labels: DataFrame, keys: list[str], gap_frames: int, by_label: bool = True, chunk_frames: int = 100_000) -> DataFrame:
    """Runs of equal labels without a gap of more than ``gap_frames`` (0 or less: any gap goes): first, last, mean
    score and number of labelled frames.

    Runs are first made within chunks of a track's frames and then joined where chunks meet, by the same rule: a
    track that holds much of the input is spread over its chunks, and only its runs come together.
    """

    def starts(w: Window, last: str, label: str) -> Column:
        new = F.lag(last).over(w).isNull()
        if by_label:
            new |= F.lag(label).over(w) != F.col(label)
        if gap_frames > 0:
            new |= F.col("first_frame") - F.lag(last).over(w) > gap_frames
        return new.cast("int")

    def merged(parts: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("first_frame")
        # by gaps alone the labels at a run's ends don't matter; its name is the first frame's
        runs = parts.withColumn("new", starts(w, "last_frame", "label")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return runs.groupBy(*by, "run").agg(
            F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.min_by("label", "first_frame").alias("label"), F.sum("total").alias("total"), F.sum("scored").alias("scored"), F.sum("n").alias("n")
        )

    each = labels.select(
        *keys, F.floor(F.col("frame_idx") / chunk_frames).alias("chunk"), F.col("frame_idx").alias("first_frame"), F.col("frame_idx").alias("last_frame"), "label", F.col("score").alias("total"), F.when(F.col("score").isNotNull(), 1).otherwise(0).alias("scored"), F.lit(1).cast("long").alias("n")
    )
    runs = merged(merged(each, [*keys, "chunk"]).drop("run", "chunk"), keys)
    return runs.withColumn("avg_similarity", F.when(F.col("scored") > 0, F.col("total") / F.col("scored"))).drop("total", "scored")


def _timed(runs: DataFrame, fps: float) -> DataFrame:
    ms = (lambda c: c / fps * 1000) if fps > 0 else lambda c: F.lit(0.0)
    out = runs.withColumn("frames", F.col("last_frame") - F.col("first_frame") + 1)
    out = out.withColumn("duration_ms", ms(F.col("frames"))).withColumn("start_ms", ms(F.col("first_frame")))
    return out.withColumn("end_ms", F.col("start_ms") + F.col("duration_ms"))


_SEGMENT = ["subtrack_id", "label", "start_ms", "end_ms", "duration_ms", "frames", "avg_similarity"]


def label_runs(labels: DataFrame, keys: list[str], fps: float, max_gap_ms: float = C.max_gap_ms, min_run_ms: float = C.min_run_ms) -> DataFrame:
    """Segments of label runs; a subtrack id counts the runs kept in its track."""
    gap, least = (half_even(x / 1000 * fps) if fps > 0 else 0 for x in (max_gap_ms, min_run_ms))
    runs = _timed(islands(labels.where(known_label(F.col("label"))), keys, gap), fps)
    kept = runs.where((F.col("duration_ms") >= min_run_ms) & (F.col("frames") >= max(1, least)))
    w = Window.partitionBy(*keys).orderBy("first_frame")
    return kept.withColumn("subtrack_id", F.row_number().over(w) - 1).withColumn("avg_similarity", F.coalesce("avg_similarity", F.lit(0.0))).select(*keys, *_SEGMENT)


def frame_runs(obs: DataFrame, keys: list[str], fps: float, max_gap_frames: int) -> DataFrame:
    """Runs of frames of single-label tracks, by gaps alone."""
    runs = _timed(islands(obs, keys, max_gap_frames, by_label=False), fps)
    w = Window.partitionBy(*keys).orderBy("first_frame")
    return runs.withColumn("subtrack_id", F.row_number().over(w) - 1).select(*keys, *_SEGMENT)


def subtracks_from_runs(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Subtracks where the label changes, whatever the gaps, with the mean of their scores."""
    runs = islands(labels, keys, 0)
    w = Window.partitionBy(*keys).orderBy("first_frame")
    return runs.select(*keys, (F.row_number().over(w) - 1).alias("subtrack_id"), "label", F.col("first_frame").alias("start_frame"), F.col("last_frame").alias("end_frame"), "avg_similarity", F.col("n").alias("n_scores"))


def subtrack_segments(subtracks: DataFrame, keys: list[str], fps: float, min_run_ms: float = C.min_run_ms) -> DataFrame:
    """Subtracks with a label, in order and long enough; ids are positions that count dropped ones."""
    named = subtracks.where(known_label(F.col("label")) & (F.col("end_frame") >= F.col("start_frame")))
    timed = _timed(named.withColumnsRenamed({"start_frame": "first_frame", "end_frame": "last_frame"}), fps)
    return timed.where(F.col("duration_ms") >= min_run_ms).withColumn("avg_similarity", F.coalesce("avg_similarity", F.lit(0.0))).select(*keys, *_SEGMENT)


def track_segments(subtracks: DataFrame, labels: DataFrame, keys: list[str], fps: float, max_gap_ms: float = C.max_gap_ms, min_run_ms: float = C.min_run_ms, use_subtracks: bool = True) -> DataFrame:
    """A track's subtracks where it has any, else its label runs; equal rounded segments once."""
    runs = label_runs(labels, keys, fps, max_gap_ms, min_run_ms)
    if not use_subtracks:
        return dedup_segments(runs, keys)
    own = subtrack_segments(subtracks, keys, fps, min_run_ms)
    return dedup_segments(own.unionByName(runs.join(subtracks.select(*keys).distinct(), keys, "left_anti")), keys)


def dedup_segments(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The first of segments equal in track, subtrack, label and half-even rounded ends."""
    same = [*keys, "subtrack_id", "label", F.bround("start_ms", 0), F.bround("end_ms", 0)]
    w = Window.partitionBy(*same).orderBy("start_ms", "end_ms", "avg_similarity")
    return segments.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def totals(segments: DataFrame, by: list[str] | None = None) -> DataFrame:
    return segments.groupBy(*(by or []), "label").agg(F.sum("duration_ms").alias("total_ms"))


def coverage(segments: DataFrame, video_ms: float) -> DataFrame:
    agg = segments.groupBy("label").agg(F.sum(F.greatest(F.col("duration_ms"), F.lit(0.0))).alias("total_ms"), F.count(F.lit(1)).alias("segments"))
    return agg.withColumn("percent", F.col("total_ms") / video_ms * 100 if video_ms > 0 else F.lit(0.0))


def _seconds(segments: DataFrame, total_seconds: int) -> DataFrame:
    lo = F.greatest(F.floor(F.col("start_ms") / 1000), F.lit(0))
    hi = F.least(F.ceil(F.col("end_ms") / 1000), F.lit(total_seconds)) - 1
    return segments.where(lo <= hi).withColumn("second", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))


def timeline_wide(segments: DataFrame, total_seconds: int, labels: list[str]) -> DataFrame:
    """0/1 by second and label; the labels are given, so the pivot needs no extra job and its columns are fixed."""
    present = _seconds(segments, total_seconds).groupBy("second").agg(*(F.max(F.when(F.col("label") == x, 1).otherwise(0)).alias(x) for x in labels))
    return segments.sparkSession.range(total_seconds).select(F.col("id").alias("second")).join(present, "second", "left").fillna(0, labels)


def timeline_long(segments: DataFrame, keys: list[str], total_seconds: int) -> DataFrame:
    return _seconds(segments, total_seconds).select("second", *keys, "subtrack_id", "label")


def missing_labels(observed: DataFrame, known: DataFrame, segments: DataFrame) -> DataFrame:
    """Known labels that were observed and have no segment."""
    seen = observed.where(known_label(F.col("label"))).select("label").distinct()
    return seen.join(known.select("label").distinct(), "label", "left_semi").join(segments.select("label").distinct(), "label", "left_anti")


def merge_with_fallback(base: DataFrame, fallback: DataFrame, eligible: DataFrame, keys: list[str]) -> DataFrame:
    """Base segments, and fallback segments of eligible labels that aren't there yet, numbered on in their track.

    Both are read once and dealt by track once; all that is asked of a track are windows over its segments.
    """
    more = fallback.where(known_label(F.col("label"))).join(F.broadcast(eligible.select("label").distinct()), "label", "left_semi")
    both = base.select(*keys, *_SEGMENT, F.lit(True).alias("old")).unionByName(more.select(*keys, *_SEGMENT, F.lit(False).alias("old"))).repartition(*keys)
    same = [*keys, "label", F.bround("start_ms", 3), F.bround("end_ms", 3)]
    there = F.max("old").over(Window.partitionBy(*same))
    nth = F.row_number().over(Window.partitionBy(*same, "old").orderBy("subtrack_id", "start_ms"))
    kept = both.withColumn("there", there).withColumn("nth", nth).where(F.col("old") | (~F.col("there") & (F.col("nth") == 1)))
    top = F.max(F.when(F.col("old"), F.col("subtrack_id"))).over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys, "old").orderBy("start_ms", "end_ms", "label"))
    numbered = kept.withColumn("top", top).withColumn("place", place)
    return numbered.withColumn("subtrack_id", F.when(F.col("old"), F.col("subtrack_id")).otherwise(F.coalesce("top", F.lit(-1)) + F.col("place")).cast("int")).select(*keys, *_SEGMENT)


def covered_segments(
    subtracks: DataFrame | None, labels: DataFrame, known: DataFrame, keys: list[str], fps: float, max_gap_ms: float, min_run_ms: float, fallback_run_ms: float = 0.0
) -> DataFrame:
    """Segments, and for known labels that were seen but have none those of shorter runs, without subtracks: runs of
    ``fallback_run_ms``, held between 0 and ``min_run_ms``."""
    if subtracks is None:
        base = dedup_segments(label_runs(labels, keys, fps, max_gap_ms, min_run_ms), keys)
    else:
        base = track_segments(subtracks, labels, keys, fps, max_gap_ms, min_run_ms)
    base = cut(base)
    relaxed = min(max(fallback_run_ms, 0.0), min_run_ms)
    shorter = track_segments(labels.limit(0), labels, keys, fps, max_gap_ms, relaxed, use_subtracks=False)
    return merge_with_fallback(base, shorter, missing_labels(labels, known, base), keys)


def track_lengths(tracks: DataFrame, by: list[str], frames: str = "duration_frames") -> DataFrame:
    """Mean and median length in frames of tracks that have any, and their number."""
    own = tracks.where(F.col(frames) > 0)
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("tracks"), F.avg(frames).alias("mean_frames"), F.median(frames).alias("median_frames"))


def reconcile(segments: DataFrame, claimed: DataFrame, tolerance_ms: float = 1.0) -> DataFrame:
    """Labels whose segments don't add up to the claimed totals."""
    own = segments.groupBy("label").agg(F.sum("duration_ms").alias("segments_ms"))
    both = own.join(claimed.select("label", F.col("total_ms").alias("claimed_ms")), "label", "full_outer").fillna(0.0, ["segments_ms", "claimed_ms"])
    return both.withColumn("diff_ms", F.col("segments_ms") - F.col("claimed_ms")).where(F.abs("diff_ms") > tolerance_ms)


def unsegmented(labels: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    return labels.where(known_label(F.col("label"))).select(*keys).distinct().join(segments.select(*keys).distinct(), keys, "left_anti")


def frame_window(segments: DataFrame, fps: float) -> DataFrame:
    at = lambda c: (F.col(c) / 1000 * fps).cast("long")
    return segments.withColumn("start_frame", at("start_ms")).withColumn("end_frame", at("end_ms"))


def scene_probes(scenes: DataFrame, probes: int) -> DataFrame:
    """Distinct frames at equal steps from 20 to 80 % of each scene (start_frame, end_frame, both inclusive)."""
    places = [0.5] if probes <= 1 else [0.2 + 0.6 * k / (probes - 1) for k in range(probes)]
    span = F.col("end_frame") - F.col("start_frame")
    at = lambda p: F.least(F.greatest(F.bround(F.col("start_frame") + span * p, 0).cast("long"), F.col("start_frame")), F.col("end_frame"))
    return scenes.withColumn("frame_idx", F.explode(F.array_distinct(F.array(*(at(F.lit(p)) for p in places)))))


def clip_frames(frames: DataFrame, fps: float, start_sec: float, end_sec: float, total_frames: int) -> DataFrame:
    lo, hi = max(0, int(start_sec * fps)), min(total_frames - 1, int(end_sec * fps))
    return frames.where(F.col("frame_idx").between(lo, hi))

