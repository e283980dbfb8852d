"""Every threshold of the engine, with the defaults of a production run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    stride: int = 1
    min_area_frac: float = 0.003
    min_area_px: float = 0.0
    min_side_px: float = 0.0
    min_sharpness: float = 20.0
    min_frontalness: float = 0.10
    target_area_frac: float = 0.03
    quality_weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
    guard_stride: int = 6
    guard_consecutive: int = 3
    guard_reject: float = 0.35
    guard_margin: float = 0.05
    guard_recover: int = 2
    guard_min_picks: int = 3
    split_below: float = 0.62
    stitch_distance: float = 0.45
    stitch_gap_ms: float = 8000.0
    stitch_iou: float = 0.10
    max_gap_ms: float = 300.0
    min_run_ms: float = 600.0
    similarity: float = 0.78
    min_margin: float = 0.0
    vote_decay: float = 0.99
    dominance: float = 2.0
    flip: float = 0.30
    split_frames: int = 5
    split_margin: float = 0.05
    embed_every: int = 2
    samples_min: int = 4
    samples_per_track: int = 8
    min_gap_frames: int = 8


DEFAULT = Config()
