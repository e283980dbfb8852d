"""Which samples of a track are kept: gates, pools, spacing and quotas."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwell.config import DEFAULT
from dwell.operators.folds import in_order, kinds, runs
from dwell.operators.quantiles import quantiles

#: Rows of a label that are made Python values at a time.
_STEP = 64


def _order(ties: list[str]) -> list:
    return [F.desc("quality"), F.asc("frame_idx"), *(F.asc(t) for t in ties)]


def gate_reasons(candidates: DataFrame, min_area_frac: float = DEFAULT.min_area_frac, min_sharpness: float = DEFAULT.min_sharpness, min_frontalness: float = DEFAULT.min_frontalness) -> DataFrame:
    """The first gate a candidate fails, or null."""
    return candidates.withColumn(
        "reason",
        F.when(F.col("area_frac") < min_area_frac, "rejected_area").when(F.col("sharpness") < min_sharpness, "rejected_sharpness").when(F.col("frontalness") < min_frontalness, "rejected_frontalness"),
    )


def reject_counts(reasons: DataFrame) -> DataFrame:
    return reasons.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def candidate_pool(candidates: DataFrame, keys: list[str], limit: int, ties: list[str]) -> DataFrame:
    """The best ``limit`` of each track by quality, then frame; the rest is ``rejected_quality``."""
    w = Window.partitionBy(*keys).orderBy(*_order(ties))
    ranked = candidates.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("reason", F.when(F.col("rank") > limit, "rejected_quality"))


def debug_rows(candidates: DataFrame, keys: list[str], limit: int, ties: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*_order(ties))
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def montage_rows(samples: DataFrame, keys: list[str], tiles: int, ties: list[str]) -> DataFrame:
    """The best ``tiles`` picked samples of each track, and as many of those rejected; where a track has none with a
    reason of rejection, of all that aren't picked. Adds ``row`` and ``tile``, from 1."""
    picked = F.coalesce(F.col("picked"), F.lit(False))
    rejected = ~picked & F.coalesce(F.col("reason").startswith("rejected"), F.lit(False))
    any_ = F.max(rejected).over(Window.partitionBy(*keys))
    marked = samples.withColumn("row", F.when(picked, "picked").when(rejected | ~any_, "rejected")).where(F.col("row").isNotNull())
    place = F.row_number().over(Window.partitionBy(*keys, "row").orderBy(F.desc(F.coalesce("quality", F.lit(0.0))), *ties))
    return marked.withColumn("tile", place).where(F.col("tile") <= tiles)


def percentile_gate(candidates: DataFrame, keys: list[str], column: str, percent: float, floor: float | None = None) -> DataFrame:
    """Rows at or above the linearly interpolated percentile of their track, and the floor."""
    gates = quantiles(candidates, keys, column, {"gate": percent / 100})
    gates = gates.withColumn("gate", F.greatest("gate", F.lit(floor))) if floor is not None else gates
    return candidates.join(gates, keys).where(F.col(column) >= F.col("gate"))


def spaced(candidates: DataFrame, keys: list[str], most: int, min_gap: int, ties: list[str]) -> DataFrame:
    """In order of quality, frames at least ``min_gap`` from all taken before, up to ``most``."""
    rows = candidates.select(*keys, F.col("frame_idx").cast("bigint").alias("frame_idx"), (-F.col("quality")).alias("neg"), *ties)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: list[int] = []
        for new, part in runs(batches, len(keys)):
            taken = [] if new else taken
            picked: list[int] = []
            if len(taken) < most:
                for i, f in enumerate(part["frame_idx"].to_pylist()):
                    if len(taken) < most and all(abs(f - t) >= min_gap for t in taken):
                        taken.append(f)
                        picked.append(i)
            yield part.select([*keys, "frame_idx"]).take(pa.array(picked, pa.int64()))

    return in_order(rows, keys, "neg", "frame_idx", *ties).mapInArrow(run, kinds(rows, *keys, "frame_idx"))


@dataclass(frozen=True)
class Rules:
    """What a track's samples are chosen by; ``frontal_pct`` tells what counts as frontal in the track."""

    samples_per_track: int = DEFAULT.samples_per_track
    samples_min: int = DEFAULT.samples_min
    min_gap: int = DEFAULT.min_gap_frames
    min_frontalness: float = DEFAULT.min_frontalness
    sharpness_pct: float | None = None
    min_sharpness: float | None = None
    profile_quota: int = 0
    profile_floor: float = 0.0
    frontal_pct: float = 60.0
    min_frontal: int = 0


@dataclass
class _Pool:
    """A track's candidates in order of quality, by their places in it."""

    frames: list[int]
    quality: list[float]
    sharpness: list[float]
    frontalness: list[float]
    rules: Rules

    def gate(self) -> None:
        """Reasons of the gates, and who may be picked: frontal ones, and profiles as far as there is a quota for them.

        Sharpness counts from the first frontal candidate on: until then a blurred one may pass.
        """
        r = self.rules
        floors = [np.percentile(self.sharpness, r.sharpness_pct)] if r.sharpness_pct is not None and self.sharpness else []
        floor = max([*floors, *([r.min_sharpness] if r.min_sharpness is not None else [])], default=-np.inf)
        self.reason: list[str | None] = []
        self.frontal: list[int] = []
        self.profile: list[int] = []
        for i, (sharp, front) in enumerate(zip(self.sharpness, self.frontalness, strict=True)):
            blurred = sharp < floor
            if blurred and self.frontal:
                self.reason.append("rejected_sharpness")
            elif front >= r.min_frontalness:
                self.reason.append("picked_sharpness_floor" if blurred else None)
                self.frontal.append(i)
            elif r.profile_quota > 0 and front >= r.profile_floor:
                self.reason.append("profile_pool")
                self.profile.append(i)
            else:
                self.reason.append("rejected_frontalness")

    def take(self, places: list[int], until: int, gap: int, most: int, reason: str) -> None:
        """The next of ``places`` that keep the gap from all picks, up to ``most`` of them and ``until`` picks."""
        for i in places:
            if len(self.picks) >= until or most <= 0:
                return
            if i not in self.picks and all(abs(self.frames[i] - self.frames[j]) >= gap for j in self.picks):
                self.picks.append(i)
                self.reason[i] = reason
                most -= 1

    def fill(self) -> None:
        """Spaced frontal picks, then as many of any spacing as must be; then profiles likewise, within their quota."""
        r = self.rules
        quota, gap, n = min(r.profile_quota, len(self.profile)), max(r.min_gap, 0), len(self.frames)
        wanted = min(r.samples_per_track, len(self.frontal) + quota)
        least = min(r.samples_min, wanted)
        self.take(self.frontal, wanted, gap, n, "picked")
        self.take(self.frontal, least, 0, n, "picked")
        profiles = sorted(self.profile, key=lambda i: (-self.quality[i], -self.sharpness[i]))
        self.take(profiles, wanted, gap, quota, "picked_profile")
        self.take(profiles, least, 0, n, "picked_profile")

    def turn_frontal(self) -> None:
        """Until enough picks are frontal for this track, further frontal ones come in. In a full selection the best of
        the other picks makes room (of equal ones the later); it keeps its reason."""
        r = self.rules
        if r.min_frontal <= 0 or not self.frontal:
            return
        level = np.percentile([self.frontalness[i] for i in self.frontal], r.frontal_pct)
        facing = [f >= level for f in self.frontalness]
        self.picks.sort(key=lambda i: -self.quality[i])
        for i in self.frontal:
            if sum(facing[j] for j in self.picks) >= r.min_frontal:
                return
            if not facing[i] or i in self.picks:
                continue
            if len(self.picks) >= r.samples_per_track:
                others = [j for j in self.picks if not facing[j]]
                if not others:
                    continue
                self.picks.remove(max(reversed(others), key=lambda j: self.quality[j]))
            self.picks.append(i)
            self.reason[i] = "picked"

    def choose(self) -> tuple[list[bool], list[str]]:
        self.picks: list[int] = []
        self.gate()
        if self.frontal or self.profile:
            self.fill()
            self.turn_frontal()
        return [i in self.picks for i in range(len(self.frames))], [r or "not_selected" for r in self.reason]


def choose(frames: list[int], quality: list[float], sharpness: list[float], frontalness: list[float], rules: Rules) -> tuple[list[bool], list[str]]:
    """Picked and reason of each candidate of one track, given in order of quality."""
    return _Pool(frames, quality, sharpness, frontalness, rules).choose()


def select_samples(candidates: DataFrame, keys: list[str], limit: int, ties: list[str], **rules) -> DataFrame:
    """The full selection: the pool is cut first, so a track holds at most ``limit`` rows, then picked."""
    columns = [*keys, "rank", "frame_idx", "quality", "sharpness", "frontalness"]
    pool = candidate_pool(candidates, keys, limit, ties).where("reason is null").select(*columns)
    names = ["frame_idx", "quality", "sharpness", "frontalness"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chosen() -> pa.RecordBatch:
            track = pa.concat_batches(held)
            picked, reason = choose(*(track[c].to_pylist() for c in names), Rules(**rules))
            return pa.RecordBatch.from_arrays([*track.columns, pa.array(picked, pa.bool_()), pa.array(reason, pa.string())], names=[*columns, "picked", "reason"])

        for new, part in runs(batches, len(keys)):
            if new and held:
                yield chosen()
                held.clear()
            held.append(part)
        if held:
            yield chosen()

    return in_order(pool, keys, "rank").mapInArrow(run, kinds(pool, *columns) + ", picked boolean, reason string")


def _far(a: list | None, b: list | None, apart: float) -> bool:
    """Whether two feature vectors lie at least ``apart`` from each other; vectors without a distance don't."""
    if not a or not b or len(a) != len(b) or None in a or None in b:
        return False
    return not sum(abs(x - y) for x, y in zip(a, b, strict=True)) / len(a) < apart


def top_distinct(candidates: DataFrame, keys: list[str], feature: str, most: int, apart: float, ties: list[str]) -> DataFrame:
    """Top ``most`` of each label in order of quality, leaving out what lies nearer than ``apart`` (mean absolute
    difference of feature vectors) to one taken before.

    A fold over sorted rows: all candidates are walked until the top is full, and only those taken are kept.
    """
    rows = candidates.select(*keys, (-F.col("quality")).alias("neg"), *ties, F.col(feature).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: list[list | None] = []
        for new, part in runs(batches, len(keys)):
            taken = [] if new else taken
            picked: list[int] = []
            before = len(taken)
            for lo in range(0, part.num_rows, _STEP):
                if len(taken) >= most:
                    break
                for i, v in enumerate(part["v"].slice(lo, _STEP).to_pylist(), lo):
                    if len(taken) < most and all(_far(t, v, apart) for t in taken):
                        taken.append(v)
                        picked.append(i)
            out = part.take(pa.array(picked, pa.int64()))
            ranks = pa.array(range(before + 1, before + 1 + len(picked)), pa.int32())
            yield pa.RecordBatch.from_arrays([ranks, *out.columns[:-1]], names=["rank", *out.schema.names[:-1]])

    kept = in_order(rows, keys, "neg", *ties, "v").mapInArrow(run, "rank int, " + kinds(rows, *keys, "neg", *ties))
    return kept.select(*keys, "rank", *ties, (-F.col("neg")).alias("quality"))
