"""Labels, names and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_label(raw: Column) -> Column:
    """Trimmed, upper case, white space and other characters as ``_``; null when nothing valid is left."""
    out = F.regexp_replace(F.upper(F.trim(raw)), r"\s+", "_")
    out = F.regexp_replace(F.regexp_replace(out, r"[^A-Z0-9_-]", "_"), r"^_+|_+$", "")
    return F.when(out.rlike(r"^[A-Z0-9_-]+$"), out)


def frame_of(name: Column) -> Column:
    """The number after the last ``_f`` of a file name without its suffix; -1 without one."""
    return F.coalesce(F.regexp_extract(name, r"_f(\d+)(?:\.[^.]*)?$", 1).try_cast("int"), F.lit(-1))


def track_of(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, r"track_(\d+)", 1).try_cast("int"), F.lit(-1))


def destination_name(stem: Column, harvest_id: Column, byte_id: Column, frame: Column, path: Column, suffix: Column) -> Column:
    """Deterministic: the same source always goes to the same name."""
    return F.format_string("%s_H%04d_B%04d_F%s_%s%s", stem, harvest_id, byte_id, frame, F.substring(F.sha1(path.cast("binary")), 1, 8), suffix)


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes", "y")


def assignment_status(assigned: Column, picked: Column) -> Column:
    a, p = F.coalesce(assigned, F.lit(0)), F.coalesce(picked, F.lit(0))
    return F.when(a == 0, "Unassigned").when((p > 0) & (a >= p), "Assigned").otherwise("Partially")


def label_colour(label: Column) -> Column:
    """struct(b, g, r): the first three bytes of the label's md5."""
    part = lambda k: F.conv(F.substring(F.md5(label.cast("binary")), k, 2), 16, 10).cast("int")
    return F.struct(part(1).alias("b"), part(3).alias("g"), part(5).alias("r"))


#: Fixed: the colours (blue, green, red) that reasons are drawn in; others are white.
REASON_COLOURS = {
    "picked": (0, 200, 0),
    "candidate": (0, 255, 255),
    "not_selected": (180, 180, 180),
    "rejected_low_iou": (0, 0, 255),
    "rejected_sharpness": (0, 140, 255),
    "rejected_frontalness": (211, 0, 148),
    "rejected_area": (255, 0, 0),
    "track": (255, 140, 0),
}


def reason_colour(reason: Column) -> Column:
    """struct(b, g, r)."""
    colour = lambda bgr: F.struct(*(F.lit(x).alias(n) for x, n in zip(bgr, "bgr", strict=True)))
    out = colour((255, 255, 255))
    for name, bgr in REASON_COLOURS.items():
        out = F.when(reason == name, colour(bgr)).otherwise(out)
    return out


def canonical_path(path: Column) -> Column:
    """Without a scheme, doubled slashes and steps that stay or go back."""
    plain = F.regexp_replace(F.regexp_replace(path, r"^file:/*(?=/)", ""), r"/(\./)*/*", "/")
    return F.regexp_replace(plain, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")


def relative_to_track(path: Column) -> Column:
    """From the directory ``track_...`` on; the path itself without one."""
    found = F.regexp_extract(path, r"(?:^|/)(track_.*)$", 1)
    return F.when(found == "", path).otherwise(found)


def cache_key(path: Column, stem: Column) -> Column:
    return F.concat_ws("_", stem, F.substring(F.sha1(path.cast("binary")), 1, 12))


def known_label(label: Column) -> Column:
    return F.coalesce((label != "") & (label != "UNKNOWN"), F.lit(False))
