"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length one, so that cosine >= t means a distance of at most eps = sqrt(2 - 2t), and turned to
their principal axes. They are sorted by the grid cells of width eps on the leading axes, dimension first, and the
order is cut into intervals: Spark's range partitions, each written once to the shared folder. A task takes one
interval and joins it with itself and with the half of the others that follow it in a circle, which it reads one at a
time by the folder's qualified URI (``folders.opened``); so rows are sent to no task twice, whatever the number of intervals. Intervals whose bounding boxes lie further
apart than eps aren't read. The others are joined recursively: both are halved again and again, and what is provably
distant is skipped. Boxes lie on the leading axes and one more coordinate, the length of what the leading axes leave
of a vector; by Cauchy and Schwarz the product on these coordinates is no less than the cosine. In leaves that product
is taken first, in blocks, and the cosine only where it reaches the threshold. Axes, found from a bounded sample, only
decide what is skipped, never what is linked.

Exact copies are one vector with a number, counted before the exchange. A task sends sums of links and a spanning
forest, never pairs. Products are compared in single precision; where one is nearer to the threshold than its error
bound, and only there, the cosine is computed in double precision.

Where vectors fill many dimensions evenly, boxes exclude nothing and the work stays quadratic, at a product of
AXES + 1 numbers a pair; README has figures.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing: no links, a component of
their own. Vectors of different dimensions don't link. component_id is the smallest non-null vec_id of a component;
rows of a null vec_id count as vectors, and are kept where their component has no id. Each row of a repeated id is a
vector. An empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwell.llm.components import components
from dwell.llm.shared import fresh_path, join_counted, settle, table
from dwell.operators.graph import forest
from dwell.sources.folders import opened, qualified

COSINE = 0.95
AXES = 16
#: Axes that cells are taken on.
CELL_AXES = 8
INTERVAL = 8192
SAMPLE = 8192
_LEAF = 512
#: Above this share of pairs that the leading coordinates let through, a block's cosines are taken all at once.
_MANY = 0.05


def clean(column: pa.Array) -> list[bytes | None]:
    """The components of each vector as bytes, None for those that link with nothing."""
    values = column.values.to_numpy(zero_copy_only=False)
    kind = values.dtype if values.dtype in (np.float32, np.float64) else np.float64
    out: list[bytes | None] = []
    offsets = column.offsets.to_numpy()
    for k, there in enumerate(column.is_valid().to_numpy(zero_copy_only=False)):
        v = values[offsets[k] : offsets[k + 1]].astype(kind)
        out.append(v.tobytes() if there and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of length one, in double precision; all of one dimension."""
    m = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@dataclass(frozen=True)
class Grid:
    eps: float
    axes: dict[int, np.ndarray]  # by dimension; vectors of others keep their own axes

    def leading(self, m: np.ndarray) -> np.ndarray:
        """Coordinates on the leading axes, and the length of the rest."""
        dim = m.shape[1]
        own = m @ self.axes[dim] if dim in self.axes else m[:, :AXES]
        out = np.zeros((len(m), AXES + 1))
        out[:, : own.shape[1]] = own
        out[:, AXES] = np.sqrt(np.maximum(0.0, 1.0 - (own**2).sum(axis=1)))
        return out

    def keys(self, m: np.ndarray) -> list[bytes]:
        """Dimension and cells, as bytes in the order of the grid."""
        cells = np.clip(np.floor(self.leading(m)[:, :CELL_AXES] / self.eps) + 128, 0, 255).astype(np.uint8)
        head = m.shape[1].to_bytes(4, "big")
        return [head + c.tobytes() for c in cells]


def _by_dim(raw: list[bytes], kind: str) -> Iterator[tuple[int, np.ndarray]]:
    size = np.array([len(r) for r in raw])
    for n in np.unique(size):
        yield int(n) // np.dtype(kind).itemsize, np.flatnonzero(size == n)


def plan_grid(sample: list[bytes], kind: str, eps: float) -> Grid:
    """The principal axes of each dimension in the sample, largest variance first."""
    axes, sample = {}, list(dict.fromkeys(sample))
    for dim, at in _by_dim(sample, kind):
        m = unit([sample[i] for i in at], kind)
        axes[dim] = np.linalg.eigh(np.cov(m, rowvar=False).reshape(dim, dim))[1][:, ::-1][:, :AXES] if len(m) > 1 else np.eye(dim)[:, :AXES]
    return Grid(eps, axes)


def _gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Square of the least distance between boxes, a little less than it is for rounding."""
    apart = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a) - 1e-9)
    return (apart**2).sum(axis=-1)


class _Side:
    """Vectors of one dimension in grid order, with the boxes of their leaves."""

    def __init__(self, nodes: np.ndarray, n: np.ndarray, m: np.ndarray, lead: np.ndarray) -> None:
        self.nodes, self.n, self.m, self.f, self.lead = nodes, n, m, m.astype(np.float32), lead.astype(np.float32)
        starts = np.arange(0, len(m), _LEAF)
        self.leaves = len(starts)
        self.lo, self.hi = np.minimum.reduceat(lead, starts), np.maximum.reduceat(lead, starts)
        self.links = np.zeros(len(m), np.int64)

    def rows(self, leaf: int) -> slice:
        return slice(leaf * _LEAF, min((leaf + 1) * _LEAF, len(self.m)))

    def box(self) -> tuple[np.ndarray, np.ndarray]:
        return self.lo.min(axis=0), self.hi.max(axis=0)


def join_sides(a: _Side, b: _Side, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Adds the links of both sides' vectors and gives a forest of them; a is b for an interval with itself."""
    eps2 = 2 - 2 * cosine
    error = 1e-6 + 2e-7 * a.m.shape[1]
    us, vs, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0

    def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether a's rows x and b's rows y are linked, in double precision."""
        out = np.empty(len(x), bool)
        for lo in range(0, len(x), 4096):
            out[lo : lo + 4096] = np.einsum("ij,ij->i", a.m[x[lo : lo + 4096]], b.m[y[lo : lo + 4096]]) >= cosine
        return out

    def linked(ra: slice, rb: slice, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows of linked pairs, each once."""
        near = a.lead[ra] @ b.lead[rb].T >= cosine - 1e-5
        if same:
            near &= ~np.tri(len(near), dtype=bool)
        count = np.count_nonzero(near)
        if not count:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if count <= _MANY * near.size:
            p, q = np.nonzero(near)
            p, q = p + ra.start, q + rb.start
            sure = exact(p, q)
            return p[sure], q[sure]
        dots = a.f[ra] @ b.f[rb].T
        known = near & (dots >= cosine + error)
        p, q = np.nonzero(near & (dots >= cosine - error) & ~known)
        sure = exact(p + ra.start, q + rb.start)
        known[p[sure], q[sure]] = True
        p, q = np.nonzero(known)
        return p + ra.start, q + rb.start

    def block(i: int, j: int) -> None:
        nonlocal us, vs, held
        p, q = linked(a.rows(i), b.rows(j), a is b and i == j)
        if not len(p):
            return
        np.add.at(a.links, p, b.n[q])
        np.add.at(b.links, q, a.n[p])
        us.append(a.nodes[p])
        vs.append(b.nodes[q])
        held += len(p)
        if held > 500_000:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], len(u)

    def descend(a0: int, a1: int, b0: int, b1: int) -> None:
        if a is b and b1 <= a0:
            return
        if _gap(a.lo[a0:a1].min(0), a.hi[a0:a1].max(0), b.lo[b0:b1].min(0), b.hi[b0:b1].max(0)) > eps2:
            return
        if a1 - a0 == 1 and b1 - b0 == 1:
            if a is not b or a0 <= b0:
                block(a0, b0)
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            descend(a0, mid, b0, b1)
            descend(mid, a1, b0, b1)
        else:
            mid = (b0 + b1) // 2
            descend(a0, a1, b0, mid)
            descend(a0, a1, mid, b1)

    descend(0, a.leaves, 0, b.leaves)
    u, v = np.concatenate(us), np.concatenate(vs)
    return forest(u, v) if len(u) else (u, v)


class _Intervals:
    """Reads what was written of the intervals, for tasks; a unit is a list of neighbouring intervals."""

    def __init__(self, folder: str, kind: str, grid: Grid) -> None:
        self._fs, self._root = opened(folder)
        self._kind, self._grid = kind, grid

    def sides(self, unit_: list[int]) -> dict[int, _Side]:
        """By dimension."""
        paths = [f.path for k in unit_ for f in self._fs.get_file_info(pafs.FileSelector(f"{self._root}/interval={k}")) if f.path.endswith(".parquet")]
        got = pa.concat_tables(pq.read_table(p, columns=["node", "n", "vec"], filesystem=self._fs, partitioning=None) for p in sorted(paths))
        nodes, n, raw = got["node"].to_numpy(), got["n"].to_numpy(), got["vec"].to_pylist()
        out = {}
        for dim, at in _by_dim(raw, self._kind):
            m = unit([raw[i] for i in at], self._kind)
            out[dim] = _Side(nodes[at], n[at], m, self._grid.leading(m))
        return out


def _units(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Neighbouring intervals, of (interval, rows) in order, together up to ``most`` rows."""
    out: list[list[int]] = []
    held = most
    for k, rows in sizes:
        if held + rows > most:
            out.append([])
            held = 0
        out[-1].append(k)
        held += rows
    return out


def _partners(i: int, n: int) -> list[int]:
    """Of n units in a circle, those i is joined with: itself and the half after it, so that each pair is met once."""
    return [(i + k) % n for k in range(n // 2 + 1) if not (n % 2 == 0 and k == n // 2 and k and i >= n // 2)]


def near_vectors(vectors: DataFrame, cosine: float = COSINE, interval: int = INTERVAL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    eps = math.sqrt(2 - 2 * cosine)
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    cast = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(clean(batch["v"]), pa.binary())], names=["vec_id", "vec"])

    whole = cast.mapInArrow(cleaned, "vec_id long, vec binary")
    rows = settle(whole.withColumn("digest", F.sha2("vec", 256)), "vectors")
    total = rows.count()
    chosen = [r.vec for r in rows.where("vec is not null").select("vec").orderBy(F.xxhash64("vec", "vec_id"), "vec").limit(SAMPLE).collect()]
    grid = spark.sparkContext.broadcast(plan_grid(chosen, kind, eps))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch["vec"].to_pylist()
            keys = np.empty(len(raw), object)
            for _, at in _by_dim(raw, kind):
                keys[at] = grid.value.keys(unit([raw[i] for i in at], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "key"])

    distinct = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    placed = distinct.mapInArrow(keyed, "vec binary, least long, n long, key binary").repartitionByRange(max(1, math.ceil(total / interval)), "key", "vec").sortWithinPartitions("key", "vec")
    folder = qualified(spark, fresh_path(spark, "intervals"))
    placed.select("vec", "least", "n", F.monotonically_increasing_id().alias("node"), F.spark_partition_id().alias("interval")).write.partitionBy("interval").parquet(folder)
    nodes = spark.read.schema("vec binary, least long, n long, node long, interval int").parquet(folder)
    # one row an interval comes to the driver
    units = _units([(r.interval, r.n) for r in nodes.groupBy("interval").agg(F.count(F.lit(1)).alias("n")).orderBy("interval").collect()], interval)
    listed = spark.sparkContext.broadcast(units)

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Intervals(folder, kind, grid.value)
        for batch in batches:
            for k in batch["id"].to_pylist():
                boxes = [(dim, side.box()) for dim, side in read.sides(listed.value[k]).items()]
                columns = [pa.array([k] * len(boxes), pa.int64()), pa.array([d for d, _ in boxes], pa.int64())]
                columns += [pa.array([x[1][e].tolist() for x in boxes], pa.list_(pa.float64())) for e in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "dim", "lo", "hi"])

    each = spark.range(0, len(units), 1, max(1, len(units)))  # a task a unit
    boxes = spark.sparkContext.broadcast({(r.unit, r.dim): (np.array(r.lo), np.array(r.hi)) for r in each.mapInArrow(boxed, "unit long, dim long, lo array<double>, hi array<double>").collect()})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, known, n = _Intervals(folder, kind, grid.value), boxes.value, len(listed.value)
        dims = {d for _, d in known}

        def out(a: np.ndarray, b: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, links)], names=["a", "b", "links"])

        def counts(side: _Side) -> pa.RecordBatch:
            has = side.links > 0
            return out(side.nodes[has], side.nodes[has], side.links[has])

        for batch in batches:
            for i in batch["id"].to_pylist():
                own = read.sides(listed.value[i])
                for j in _partners(i, n):
                    near = [d for d in dims if (i, d) in known and (j, d) in known and _gap(*known[i, d], *known[j, d]) <= 2 - 2 * cosine]
                    if not near:
                        continue
                    other = own if i == j else read.sides(listed.value[j])
                    for d in near:
                        u, v = join_sides(own[d], other[d], cosine)
                        yield out(u, v, np.zeros(len(u), np.int64))
                        if i != j:
                            yield counts(other[d])
                for side in own.values():
                    yield counts(side)

    found = settle(each.mapInArrow(joined, "a long, b long, links long"), "found")
    links = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("links = 0").select("a", "b"))
    named = nodes.select("node", F.sha2("vec", 256).alias("digest"), "least", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    named = settle(named, "named")
    least = settle(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    of = named.select("root", "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("n").alias("copies"))
    same = settle(join_counted(of, least, "root").select("digest", "n_links", "component_id", F.col("copies").alias("n")), "same")
    linked = join_counted(rows.where("vec is not null").select("vec_id", "digest"), same, "digest").select("vec_id", "n_links", "component_id")
    apart = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(apart).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
