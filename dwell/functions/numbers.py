"""Numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest(x: Column, digits: int) -> Column:
    """A double at some digits, as SQL engines round: x times a power of ten to the nearest whole number, halves away from
    zero. ``F.round`` rounds the shortest decimals of x instead, which at halves may give the other neighbour."""
    scale = float(10**digits)
    out = F.round(x * scale, 0) / scale
    return F.when(F.abs(x * scale) < float(2**52), out).otherwise(x)  # beyond, all doubles are whole; so are not a number's
