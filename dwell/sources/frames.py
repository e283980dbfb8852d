"""Detections of a video by frames, as a data source of Spark's: ``spark.read.format("frames")`` and ``readStream``.

    frames.register(spark)
    spark.read.format("frames").options(path=uri, stride=3, to=9000, classes="0,2").load()

The folder, a qualified URI, holds Parquet files of detections (``schemas.DETECTIONS``), in any order. Options: ``stride``
(every so many-th frame, by default all), ``from`` and ``to`` (frames, the last left out), ``classes`` (of class_id),
``range`` (frames of a partition, 10,000), and for streams ``frames_per_trigger`` (100,000).

A partition is a range of frames. Files say in their footers which frames they hold, so ranges without any are no
partitions, and row groups without any aren't read. With the option ``push_filters``, comparisons of ``frame_idx`` and
``class_id`` with numbers do what the options do. This is off unless asked for: Spark 4.1 keeps what it pushed into a loaded frame with that
frame, so one that was filtered must not be used again without filters; load it anew for each use. A stream's offset is a frame: each trigger takes the next frames up to the last that the files have, so a
frame must be written as a whole, and frames in their order.

Rows with a null frame are none of any range and aren't read. A path that isn't there, or an empty folder, has no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from dwell import schemas
from dwell.sources import folders

NAME = "frames"
RANGE = 10_000
FRAMES_PER_TRIGGER = 100_000


@dataclass
class FrameRange(InputPartition):
    """Frames from lo up to hi, without it, and the files that may hold some of them (all, where none are named)."""

    lo: int
    hi: int
    files: tuple[str, ...] | None = None


@dataclass
class _Wanted:
    """What of the folder is asked for."""

    uri: str
    stride: int
    lo: int | None = None
    hi: int | None = None
    classes: frozenset[int] | None = None

    def _files(self) -> tuple[pafs.FileSystem, list[str]]:
        fs, root = folders.opened(self.uri)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return fs, sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))

    def held(self) -> list[tuple[int, int, str]]:
        """First and last frame and file of each row group of the files that has any; of groups without statistics, all
        frames."""
        fs, files = self._files()
        out = []
        for path in files:
            with fs.open_input_file(path) as f:
                footer = pq.read_metadata(f)
            at = [k for k in range(footer.num_columns) if footer.schema.column(k).path == "frame_idx"]
            for g in range(footer.num_row_groups if at else 0):
                stats = footer.row_group(g).column(at[0]).statistics
                if stats is not None and stats.has_min_max:
                    out.append((stats.min, stats.max, path))
                elif footer.row_group(g).num_rows and (stats is None or stats.null_count != footer.row_group(g).num_rows):
                    with fs.open_input_file(path) as f:
                        frames = pq.ParquetFile(f).read_row_group(g, columns=["frame_idx"])["frame_idx"].drop_null()
                    if len(frames):
                        out.append((min(frames.to_pylist()), max(frames.to_pylist()), path))
        return out

    def ranges(self, size: int) -> list[FrameRange]:
        """Ranges of ``size`` frames that some file has frames in, cut to those asked for. A range knows its files, so its
        task opens no others: where files hold their frames together, what is opened grows with the files alone."""
        found: dict[int, set[str]] = {}
        for lo, hi, path in self.held():
            lo, hi = max(lo, lo if self.lo is None else self.lo), min(hi + 1, hi + 1 if self.hi is None else self.hi)
            for k in range(lo // size, -(-hi // size)) if lo < hi else ():
                found.setdefault(k, set()).add(path)
        return [FrameRange(max(k * size, k * size if self.lo is None else self.lo), min((k + 1) * size, (k + 1) * size if self.hi is None else self.hi), tuple(sorted(found[k]))) for k in sorted(found)]

    def rows(self, part: FrameRange, schema: T.StructType) -> Iterator[pa.RecordBatch]:
        """The wanted rows of a range, as batches; footers tell which row groups are read."""
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, files = self._files() if part.files is None else (folders.opened(self.uri)[0], part.files)
        kind = to_arrow_schema(schema)
        own = (ds.field("frame_idx") >= part.lo) & (ds.field("frame_idx") < part.hi)
        if self.classes is not None:
            own = own & ds.field("class_id").isin(sorted(self.classes))
        for path in files:
            table = ds.dataset(path, filesystem=fs, format="parquet", schema=kind)
            for batch in table.to_batches(filter=own):
                if self.stride > 1:
                    frames = batch["frame_idx"].to_numpy()
                    batch = batch.filter(pa.array(frames % self.stride == 0))
                if batch.num_rows:
                    yield batch.cast(kind) if batch.schema != kind else batch


def _number(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


class _Reader(DataSourceReader):
    def __init__(self, wanted: _Wanted, size: int, schema: T.StructType) -> None:
        self._wanted, self._size, self._schema = wanted, size, schema

    def partitions(self) -> list[FrameRange]:
        return self._wanted.ranges(self._size)

    def read(self, partition: FrameRange | None) -> Iterator[pa.RecordBatch]:
        """Where there are no partitions, Spark asks for one that is None."""
        return iter(()) if partition is None else self._wanted.rows(partition, self._schema)


class _Pushing(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes comparisons of frames and classes with whole numbers; gives back the others."""
        w = self._wanted
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("frame_idx",) and _number(value) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                lo = value + isinstance(f, GreaterThan) if not isinstance(f, LessThan | LessThanOrEqual) else None
                hi = value + (not isinstance(f, LessThan)) if not isinstance(f, GreaterThan | GreaterThanOrEqual) else None
                w.lo = lo if w.lo is None else w.lo if lo is None else max(w.lo, lo)
                w.hi = hi if w.hi is None else w.hi if hi is None else min(w.hi, hi)
            elif column == ("class_id",) and (isinstance(f, EqualTo) and _number(value) or isinstance(f, In) and all(map(_number, value))):
                own = frozenset(value if isinstance(f, In) else [value])
                w.classes = own if w.classes is None else w.classes & own
            else:
                yield f


class _Stream(DataSourceStreamReader):
    def __init__(self, wanted: _Wanted, size: int, per_trigger: int, schema: T.StructType) -> None:
        self._wanted, self._size, self._per_trigger, self._schema = wanted, size, per_trigger, schema
        self._at: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": min((lo for lo, _, _ in self._wanted.held()), default=0)}

    def latestOffset(self) -> dict:  # noqa: N802
        """The frame after the last of the files, or as many frames on as a trigger may take."""
        if self._at is None:
            self._at = self.initialOffset()["frame"]
        end = max((hi + 1 for _, hi, _ in self._wanted.held()), default=self._at)
        self._at = min(max(end, self._at), self._at + self._per_trigger)
        return {"frame": self._at}

    def partitions(self, start: dict, end: dict) -> list[FrameRange]:
        self._at = max(self._at or 0, end["frame"])  # after a restart, on from what was taken before
        w = self._wanted
        lo, hi = max(start["frame"], start["frame"] if w.lo is None else w.lo), min(end["frame"], end["frame"] if w.hi is None else w.hi)
        return replace(w, lo=lo, hi=hi).ranges(self._size)

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        return self._wanted.rows(partition, self._schema)

    def commit(self, end: dict) -> None:
        pass


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return schemas.DETECTIONS

    def _wanted(self) -> _Wanted:
        stride = int(self.options.get("stride", 1))
        if stride < 1:
            raise ValueError("stride must be 1 or more")
        lo, hi, classes = (self.options.get(k) for k in ("from", "to", "classes"))
        return _Wanted(self.options["path"], stride, None if lo is None else int(lo), None if hi is None else int(hi), None if classes is None else frozenset(int(c) for c in classes.split(",") if c.strip()))

    def reader(self, schema: T.StructType) -> _Reader:
        kind = _Pushing if self.options.get("push_filters", "false").lower() == "true" else _Reader
        return kind(self._wanted(), int(self.options.get("range", RANGE)), schema)

    def streamReader(self, schema: T.StructType) -> _Stream:  # noqa: N802
        return _Stream(self._wanted(), int(self.options.get("range", RANGE)), int(self.options.get("frames_per_trigger", FRAMES_PER_TRIGGER)), schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, which may push filters down to Python sources that take them.

    The modules go along with the class: the workers that plan a stream's triggers have no packages sent to executors.
    """
    for module in (sys.modules[__name__], folders, schemas):
        cloudpickle.register_pickle_by_value(module)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Frames)
