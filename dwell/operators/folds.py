"""Folds over the rows of each key in an order: sorted partitions pass by in Arrow batches, so what is held is a key's
state and a batch, however many rows a key has."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame


def in_order(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """Rows of a key together in one partition, in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The rows of ``in_order`` in slices of one key each (its first ``n_keys`` columns), and whether it is the key's
    first."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in range(n_keys):
            code = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        for lo, hi in pairwise([*np.flatnonzero(new).tolist(), batch.num_rows]):
            key = tuple(batch.column(k)[lo].as_py() for k in range(n_keys))
            yield key != last, batch.slice(lo, hi - lo)
            last = key


def kinds(df: DataFrame, *columns: str) -> str:
    """Columns of ``df`` as a schema."""
    of = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{c}` {of[c]}" for c in columns)
