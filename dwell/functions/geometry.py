"""Boxes (struct x1, y1, x2, y2, in pixels), landmarks and quality as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwell.config import DEFAULT as C

Number = Column | float


def lit(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def box(x1: Number, y1: Number, x2: Number, y2: Number) -> Column:
    return F.struct(lit(x1).alias("x1"), lit(y1).alias("y1"), lit(x2).alias("x2"), lit(y2).alias("y2"))


def xywh(b: Column) -> Column:
    return F.struct(b.x1.alias("x"), b.y1.alias("y"), (b.x2 - b.x1).alias("w"), (b.y2 - b.y1).alias("h"))


def area(b: Column) -> Column:
    """Sides that run backwards count as zero."""
    return F.greatest(F.lit(0.0), b.x2 - b.x1) * F.greatest(F.lit(0.0), b.y2 - b.y1)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without an intersection or with a union that isn't positive."""
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    inter = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    union = (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def meet(a: Column, b: Column) -> Column:
    """Whether boxes share more than an edge; cheap to ask before ``iou``."""
    return (F.least(a.x2, b.x2) > F.greatest(a.x1, b.x1)) & (F.least(a.y2, b.y2) > F.greatest(a.y1, b.y1))


def dilate(b: Column, fraction: float, width: Number, height: Number) -> Column:
    """Grown by a fraction of its sides on each side and clipped to the frame; as it is for a fraction of 0 or less."""
    if fraction <= 0:
        return b
    dx, dy = (b.x2 - b.x1) * fraction, (b.y2 - b.y1) * fraction
    return box(F.greatest(F.lit(0.0), b.x1 - dx), F.greatest(F.lit(0.0), b.y1 - dy), F.least(lit(width), b.x2 + dx), F.least(lit(height), b.y2 + dy))


def center_in(inner: Column, outer: Column) -> Column:
    return ((inner.x1 + inner.x2) / 2).between(outer.x1, outer.x2) & ((inner.y1 + inner.y2) / 2).between(outer.y1, outer.y2)


def area_closeness(fraction: Column, target: float) -> Column:
    t = max(target, 1e-6)
    return clamp(1 - F.abs(fraction - t) / t)


def quality(sharpness: Column, frontalness: Column, area_fraction: Column, floor: float = C.min_sharpness, target: float = C.target_area_frac, weights: tuple[float, float, float] = C.quality_weights) -> Column:
    ws, wf, wa = weights
    sharp = clamp((sharpness - floor) / max(3 * floor, 1.0))
    return clamp(ws * sharp + wf * clamp(frontalness) + wa * area_closeness(area_fraction, target))


def passes_area(b: Column, frame_area: Number, min_px: float = C.min_area_px, min_side: float = C.min_side_px, min_fraction: float = C.min_area_frac) -> Column:
    side = F.least(b.x2 - b.x1, b.y2 - b.y1)
    return (lit(frame_area) > 0) & (area(b) >= min_px) & (side >= min_side) & (area(b) / lit(frame_area) >= min_fraction)


def orientation(landmarks: Column) -> Column:
    """struct(orientation, frontalness) from five points: eyes, nose, mouth corners; ("unknown", 0.4) without them.

    The nose's distances from the eyes are compared: the more alike, the more frontal; a face seen from the side
    counts half. The skew is compared rounded to 9 digits, so that a face on the threshold is frontal whatever its last bit.
    """
    left, right, nose = (F.get(landmarks, F.lit(k)) for k in range(3))
    span = F.greatest(F.abs(right.x - left.x), F.lit(1e-6))
    skew = F.abs((nose.x - left.x) - (right.x - nose.x)) / span
    front = clamp(1 - skew)
    side = F.round(skew, 9) > 0.5
    found = F.struct(F.when(side, "profile").otherwise("frontal").alias("orientation"), F.when(side, front * 0.5).otherwise(front).alias("frontalness"))
    return F.when(F.coalesce(F.size(landmarks) >= 5, F.lit(False)), found).otherwise(F.struct(F.lit("unknown").alias("orientation"), F.lit(0.4).alias("frontalness")))


def frontalness(landmarks: Column) -> Column:
    """1 - (.5 symmetry + .3 eye tilt + .2 mouth tilt), each against the eyes' distance; null for under five points."""
    le, re, nose, lm, rm = (F.get(landmarks, F.lit(k)) for k in range(5))
    eye = F.greatest(F.sqrt((re.x - le.x) ** 2 + (re.y - le.y) ** 2), F.lit(1e-6))
    symmetry = F.abs(F.abs(nose.x - le.x) - F.abs(re.x - nose.x)) / eye
    off = 0.5 * symmetry + 0.3 * F.abs(le.y - re.y) / eye + 0.2 * F.abs(lm.y - rm.y) / eye
    return F.when(F.size(landmarks) >= 5, clamp(1 - off))


def seed_quality(laplacian: Column, area_fraction: Column, score: Column, other: Column, front: Column) -> Column:
    return (
        0.55 * F.least(laplacian / 200, F.lit(1.0))
        + 0.20 * F.least(area_fraction / 0.25, F.lit(1.0))
        + 0.15 * F.least(F.greatest(score, other), F.lit(1.0))
        + 0.10 * F.coalesce(front, F.lit(0.5))
    )
