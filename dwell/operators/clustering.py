"""Clusters of vectors by cosine: density-based over an epsilon graph, average linkage and moving leaders.

Vectors that are null, empty, not finite or not as wide as most take no part (``functions.vectors.usable``): such a sample
keeps its row and is in no cluster, with a null for its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwell.config import DEFAULT as C
from dwell.functions.vectors import doubles, unit, usable
from dwell.operators.folds import in_order, kinds, runs
from dwell.operators.graph import connected, cut, forest
from dwell.operators.numbering import numbered, numbered_within

#: Vectors that distances are indexed by, of a bounded sample.
PIVOTS, PIVOT_SAMPLE = 32, 2048
#: Parts of a group that are sent to one another, and the most numbers that one has beside a block's: a task holds two, of 32 MB
#: each. Larger groups have more parts.
TILES, TILE_NUMBERS = 16, 4_194_304


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal width, without nulls."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return one.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(one), -1) if len(one) else np.zeros((0, 0))


def pivots_of(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors far from one another: each next one is that farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def in_blocks(rows: DataFrame, by: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, u and others) with the number ``b`` of a block of at most ``block`` neighbours within each group, and the
    blocks (``by``, b, n, least and most distance to each pivot).

    Blocks are shells around pivots: rows of the same nearest pivot in order of the distance to it. Pivots, found
    from a bounded sample, decide what blocks are made of, not what is compared.
    """
    sample = matrix(rows.select("u").orderBy(F.xxhash64("u"), "u").limit(PIVOT_SAMPLE).toArrow()["u"])
    chosen = pivots_of(sample)
    # one more, which orders nothing: the distance to zero is the length
    shared = rows.sparkSession.sparkContext.broadcast(np.vstack([chosen, np.zeros((1, sample.shape[1]))]))
    k = len(shared.value)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = matrix(batch["u"])
            d = np.stack([np.sqrt(((u - p) ** 2).sum(axis=1)) for p in shared.value], axis=1) if len(u) else np.zeros((0, k))
            near = d[:, :-1].argmin(axis=1) if len(u) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.tolist(), pa.list_(pa.float64())), pa.array(near, pa.int64()), pa.array(d[np.arange(len(u)), near])], names=[*batch.schema.names, "d", "__near", "__far"])

    measured_rows = rows.mapInArrow(measured, kinds(rows, *rows.columns) + ", d array<double>, __near long, __far double")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))
    if by:
        of = lambda df: df.withColumn("__of", F.struct(*by))
        sized = of(measured_rows).join(of(sizes).drop(*by), "__of").drop("__of")
    else:
        sized = measured_rows.join(F.broadcast(sizes), F.lit(True))  # a row
    # a block is of one pivot's rows, but for a group that is no larger than a block
    celled = sized.withColumn("__cell", F.when(F.col("__size") <= block, 0).otherwise(F.col("__near")))
    order = numbered_within(celled.drop("__near", "__size"), [*by, "__cell"], ["__far", "id"], "__nth")
    placed = cut(order.withColumn("b", F.shiftleft("__cell", 32) + F.floor(F.col("__nth") / block)).drop("__nth", "__cell", "__far"))
    side = lambda f, n: F.array(*(f(F.col("d")[i]) for i in range(k))).alias(n)
    return placed.drop("d"), cut(placed.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("n"), side(F.min, "least"), side(F.max, "most")))


def block_pairs(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi, near, far, low, high) of the pairs of blocks of a group, each with itself too: bounds of the distances
    and of the dot products between them. By the triangle inequality, vectors are no nearer than their distances to any
    pivot differ, and no farther than these sum to."""
    a = blocks.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("b").alias("lo"), F.col("least").alias("a0"), F.col("most").alias("a1"))
    b = blocks.select(*by, F.col("b").alias("hi"), F.col("least").alias("b0"), F.col("most").alias("b1"))
    same = F.col("lo") <= F.col("hi")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    sides = F.arrays_zip("a0", "a1", "b0", "b1")
    near = F.array_max(F.transform(sides, lambda x: F.greatest(x.a0 - x.b1, x.b0 - x.a1, F.lit(0.0))))
    far = F.array_min(F.transform(sides, lambda x: x.a1 + x.b1))
    # of the lengths and the distance: 2 x.y = |x|² + |y|² - |x - y|²
    square = lambda side: F.element_at(side, -1) * F.element_at(side, -1)
    bounds = b.join(a, same).withColumn("near", near - 1e-9).withColumn("far", far + 1e-9)
    low, high = (square("a0") + square("b0") - F.col("far") * F.col("far")) / 2 - 1e-9, (square("a1") + square("b1") - F.greatest(F.col("near"), F.lit(0.0)) * F.greatest(F.col("near"), F.lit(0.0))) / 2 + 1e-9
    return bounds.select(*by, "lo", "hi", "near", "far", low.alias("low"), high.alias("high"))


def _tiles(placed: DataFrame, by: list[str]) -> DataFrame:
    """(by, b, tile): runs of a group's blocks, at most ``TILES`` of about equal size where that is not too large. A row a
    block is what meets in a task."""
    sizes = placed.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("__n"), F.max(F.size("u")).alias("__width"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("__n").over(Window.partitionBy(*by))
    most = F.least(F.ceil(whole / TILES), F.greatest(F.floor(TILE_NUMBERS / F.col("__width")), F.lit(1)))
    return sizes.select(*by, "b", F.floor(F.coalesce(before, F.lit(0)) / most).alias("tile"))


def in_pairs(placed: DataFrame, pairs: DataFrame, by: list[str], compare, schema: str, merge=None) -> DataFrame:
    """``compare(first, second, own)`` of the rows of each of some pairs of blocks (by, lo, hi); ``own`` where they are one.
    What a task finds goes through ``merge``, where it is given.

    Pairs of blocks are dealt by pairs of tiles, runs of blocks: a block's rows go once to each pair of tiles that has a
    pair of its, so a row is copied at most as often as there are tiles, not blocks.
    """
    tiles = cut(_tiles(placed, by))
    tile = lambda side, name: tiles.select(*by, F.col("b").alias(side), F.col("tile").alias(name))
    same = lambda df, side, name: df.withColumn("__of", F.struct(*by, side)).join(tile(side, name).select(F.struct(*by, side).alias("__of"), name), "__of").drop("__of")
    wanted = cut(same(same(pairs.select(*by, "lo", "hi"), "lo", "first"), "hi", "second"))
    sides = wanted.select(*by, "first", "second", F.explode(F.array("lo", "hi")).alias("b")).distinct()
    key = lambda df: df.withColumn("__of", F.struct(*by, "b"))
    dealt = key(placed).drop(*by, "b").join(key(sides), "__of").drop("__of")

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        at = rows["b"].to_numpy()
        order = np.argsort(at, kind="stable")
        rows, at = rows.take(pa.array(order)), at[order]

        def block(b: int) -> pa.Table:
            lo, hi = np.searchsorted(at, [b, b + 1])
            return rows.slice(lo, hi - lo)

        found = pa.concat_tables([compare(block(lo), block(hi), lo == hi) for lo, hi in zip(asked["__lo"].to_pylist(), asked["__hi"].to_pylist(), strict=True)])
        return found if merge is None else merge(found)

    of = [*by, "first", "second"]
    asked = wanted.toDF(*(f"__{c}" for c in wanted.columns))
    return dealt.groupBy(*of).cogroup(asked.groupBy(*(f"__{c}" for c in of))).applyInArrow(run, schema)


def _compared(rows: DataFrame, by: list[str], block: int, eps: float, compare, schema: str, merge) -> DataFrame:
    """``compare`` of the vectors (id, u, core) of each pair of blocks that may hold vectors within ``eps``."""
    placed, blocks = in_blocks(rows, by, block)
    return in_pairs(placed, cut(block_pairs(blocks, by).where(F.col("near") <= eps)), by, compare, schema, merge)


def _near(first: pa.Table, second: pa.Table, own: bool, at_least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near pairs in both, each pair once, some rows at a time."""
    if not len(first) or not len(second):
        return
    x, y = matrix(first["u"]), matrix(second["u"])
    for k in range(0, len(x), 512):
        i, j = np.nonzero(x[k : k + 512] @ y.T >= at_least)
        i = i + k
        yield (i[i < j], j[i < j]) if own else (i, j)


def _eps(at_least: float) -> float:
    """The distance of two vectors of length one (or less) with that cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * at_least)))


def neighbours(rows: DataFrame, at_least: float, block: int = 2048) -> DataFrame:
    """(id, n): how many others have a cosine of ``at_least`` with each vector that has any. Sums leave a task, no pairs."""

    def compare(first: pa.Table, second: pa.Table, own: bool) -> pa.Table:
        a, b = np.zeros(len(first), np.int64), np.zeros(len(second), np.int64)
        for i, j in _near(first, second, own, at_least):
            a += np.bincount(i, minlength=len(a))
            b += np.bincount(j, minlength=len(b))
        ids, n = np.concatenate([first["id"].to_numpy(), second["id"].to_numpy()]), np.concatenate([a, b])
        return pa.table({"id": ids[n > 0], "n": n[n > 0]})

    def summed(t: pa.Table) -> pa.Table:
        ids, at = np.unique(t["id"].to_numpy(), return_inverse=True)
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, at, t["n"].to_numpy())
        return pa.table({"id": ids, "n": n})

    return _compared(rows, [], block, _eps(at_least), compare, "id long, n long", summed).groupBy("id").agg(F.sum("n").alias("n"))


def density_links(rows: DataFrame, at_least: float, block: int = 2048) -> DataFrame:
    """(a, b, border) of vectors with a flag ``core``: links that connect the same core vectors as all near pairs do, as
    a forest for each task; and each near pair (a, b) of one that is not core with one that is. Of the latter a vector
    has few, or it would be core itself."""

    def compare(first: pa.Table, second: pa.Table, own: bool) -> pa.Table:
        links, border = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
        ids, core = [x["id"].to_numpy() for x in (first, second)], [x["core"].to_numpy() for x in (first, second)]
        for i, j in _near(first, second, own, at_least):
            a, b, ca, cb = ids[0][i], ids[1][j], core[0][i], core[1][j]
            links.append(np.stack(forest(a[ca & cb], b[ca & cb])))
            border += [np.stack([a[~ca & cb], b[~ca & cb]]), np.stack([b[ca & ~cb], a[ca & ~cb]])]
        found = [np.concatenate(links, axis=1), np.concatenate(border, axis=1)]
        found[0] = np.stack(forest(*found[0]))
        return pa.table({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found]), "border": np.repeat([False, True], [f.shape[1] for f in found])})

    def merged(t: pa.Table) -> pa.Table:
        links = t.filter(pc.invert(t["border"]))
        a, b = forest(links["a"].to_numpy(), links["b"].to_numpy())
        return pa.concat_tables([pa.table({"a": a, "b": b, "border": np.zeros(len(a), bool)}), t.filter(t["border"])])

    return _compared(rows, [], block, _eps(at_least), compare, "a long, b long, border boolean", merged)


def near_links(rows: DataFrame, by: list[str], at_least: float, block: int = 2048) -> DataFrame:
    """(a, b): links that connect the same vectors of each group as all pairs with a cosine of ``at_least`` do, as a
    forest for each task."""

    def compare(first: pa.Table, second: pa.Table, own: bool) -> pa.Table:
        ids, links = [x["id"].to_numpy() for x in (first, second)], [np.zeros((2, 0), np.int64)]
        for i, j in _near(first, second, own, at_least):
            links.append(np.stack(forest(ids[0][i], ids[1][j])))
        a, b = forest(*np.concatenate(links, axis=1))
        return pa.table({"a": a, "b": b})

    def merged(t: pa.Table) -> pa.Table:
        a, b = forest(t["a"].to_numpy(), t["b"].to_numpy())
        return pa.table({"a": a, "b": b})

    return _compared(rows, by, block, _eps(at_least), compare, "a long, b long", merged)


def dbscan(samples: DataFrame, sample: str, eps: float, min_samples: int, block: int = 2048) -> DataFrame:
    """(sample, cluster_id): core samples have ``min_samples`` neighbours within cosine distance eps, themselves
    included; border samples join their least core cluster; each noise sample gets an id of its own after the others.
    Samples without a usable vector have none.
    """
    known = samples.select(F.col(sample).cast("long").alias("id"), F.when(usable(samples), unit(doubles(F.col("embedding")))).alias("u"))
    whole = cut(known)
    rows, ids = whole.where("u IS NOT NULL"), whole.where("u IS NOT NULL").select("id")
    counts = neighbours(rows, 1 - eps, block)
    flagged = cut(rows.join(counts, "id", "left").withColumn("core", F.coalesce("n", F.lit(0)) + 1 >= min_samples).drop("n"))
    links = cut(density_links(flagged, 1 - eps, block))
    own = flagged.where("core").select("id").join(connected(links.where("NOT border").select("a", "b")).withColumnRenamed("node", "id"), "id", "left")
    own = cut(own.select("id", F.coalesce("root", "id").alias("root")))
    border = links.where("border").join(own.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("root")).withColumnRenamed("a", "id")
    placed = own.unionByName(border)
    # clusters are numbered by their least core sample
    numbers = numbered(own.select("root").distinct(), "root", "cluster_id")
    named = placed.join(numbers, "root").select("id", "cluster_id")
    noise = ids.join(named, "id", "left_anti")
    after = numbers.agg(F.coalesce(F.max("cluster_id"), F.lit(-1)).alias("top"))
    alone = numbered(noise, "id", "nth").join(F.broadcast(after), F.lit(True)).select("id", (F.col("nth") + 1 + F.col("top")).alias("cluster_id"))
    out = whole.where("u IS NULL").select("id", F.lit(None).cast("long").alias("cluster_id"))
    return named.unionByName(alone).unionByName(out).withColumnRenamed("id", sample)


def average_linkage(vectors: np.ndarray, distance: float) -> np.ndarray:
    """Labels 0..k-1 in order of first member: clusters nearest by mean cosine distance are merged up to a limit.

    Merges are found along chains of nearest neighbours, in n² steps on n² numbers. Their distances never fall, so those
    up to the limit are the ones that merging in order of distance makes.
    """
    n = len(vectors)
    if n == 0:
        return np.zeros(0, int)
    u = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    size, owner = np.ones(n), np.arange(n)
    alive = np.ones(n, bool)
    chain: list[int] = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.argmax(alive)))
        while True:
            i = chain[-1]
            j = int(np.argmin(d[i]))
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        i, j = min(i, j), max(i, j)
        if d[i, j] <= distance:
            owner[owner == owner[j]] = owner[i]
        merged = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        alive[j] = False
    first = np.full(n, n)
    np.minimum.at(first, owner, np.arange(n))
    return np.unique(first[owner], return_inverse=True)[1]


def agglomerative(tracks: DataFrame, keys: list[str], track: str, distance: float, block: int = 2048) -> DataFrame:
    """Average linkage of the track vectors of each group, such as an episode, numbered in order of their first tracks;
    tracks without a usable vector have no cluster.

    A mean distance of at most ``distance`` has a pair of at most it, so clusters lie within components of the graph of
    such pairs. Only a component is one task, with its distances as a matrix there; a group of any size is cut into
    blocks to find the components.
    """
    whole = cut(tracks.select(*keys, track, F.when(usable(tracks), unit(doubles(F.col("embedding")), 1e-12)).alias("u"), F.monotonically_increasing_id().alias("id")))
    rows = whole.where("u IS NOT NULL")
    roots = connected(near_links(rows.select(*keys, "id", "u"), keys, 1 - distance - 1e-9, block)).withColumnRenamed("node", "id")
    held = rows.select("id", track, "u").join(roots, "id")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(track, "ascending"), ("id", "ascending")])
        label = average_linkage(matrix(t["u"]), distance)
        ids = t["id"].to_numpy()
        # a cluster is named by its first track's id
        return pa.table({"id": ids, "head": ids[np.unique(label, return_index=True)[1][label]]})

    linked = held.groupBy("root").applyInArrow(run, "id long, head long")
    heads = cut(rows.select(*keys, track, "id").join(linked, "id", "left").withColumn("head", F.coalesce("head", "id")))
    numbers = numbered_within(heads.where("id = head").select(*keys, track, "head"), keys, [track, "head"], "cluster_id").select("head", F.col("cluster_id").cast("int").alias("cluster_id"))
    return whole.select(*keys, track, "id").join(heads.select("id", "head"), "id", "left").join(numbers, "head", "left").select(*keys, track, "cluster_id")


class Leaders:
    """Each vector joins the nearest leader at or above the similarity, whose mean moves, or starts one."""

    def __init__(self, similarity: float) -> None:
        self._similarity = similarity
        self._sums: list[np.ndarray] = []
        self.sizes: list[int] = []

    def add(self, v: np.ndarray) -> int:
        v = v / max(np.linalg.norm(v), 1e-12)
        sims = [float(s @ v) / max(np.linalg.norm(s), 1e-12) for s in self._sums]
        k = int(np.argmax(sims)) if sims else -1
        if k < 0 or sims[k] < self._similarity:
            k = len(self._sums)
            self._sums.append(np.zeros_like(v))
            self.sizes.append(0)
        self._sums[k] = self._sums[k] + v
        self.sizes[k] += 1
        return k


def leaders(vectors: np.ndarray, similarity: float) -> np.ndarray:
    fold = Leaders(similarity)
    return np.array([fold.add(v) for v in vectors], int)


def leader_clusters(samples: DataFrame, keys: list[str], sample: str, similarity: float, min_size: int) -> DataFrame:
    """Per track: leaders in order of samples, and how many have at least ``min_size`` samples (all, if none has); 0 of
    either for a track without usable vectors. A fold: leaders are what is held of a track."""
    rows = samples.select(*keys, sample, F.when(usable(samples), doubles(F.col("embedding"))).alias("v"))
    schema = kinds(rows, *keys) + ", leaders int, identities int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fold = None, Leaders(similarity)

        def told() -> pa.RecordBatch:
            big = sum(n >= min_size for n in fold.sizes)
            counts = [pa.array([n], pa.int32()) for n in (len(fold.sizes), big or len(fold.sizes))]
            return pa.RecordBatch.from_arrays([*last.columns, *counts], names=[*keys, "leaders", "identities"])

        for new, part in runs(batches, len(keys)):
            if new and last is not None:
                yield told()
                fold = Leaders(similarity)
            last = part.select(keys).slice(0, 1)
            there = part.filter(part["v"].is_valid())
            for v in matrix(there["v"]) if there.num_rows else ():
                fold.add(v)
        if last is not None:
            yield told()

    return in_order(rows, keys, sample).mapInArrow(run, schema)


def _units(vectors: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """Rows of length one, as ``functions.vectors.unit`` makes them: squares are summed in order of positions."""
    total = np.zeros(len(vectors))
    for x in vectors.T:
        total += x * x
    n = np.sqrt(total)
    return vectors / np.where(n < eps, 1.0, n)[:, None]


def _edges(
    name: np.ndarray, start: np.ndarray, end: np.ndarray, e: list[np.ndarray], s: list[np.ndarray], vectors: pa.ChunkedArray, gap_ms: float, least_iou: float, max_distance: float, ends: np.ndarray | None = None, starts: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ends and of starts that ``stitch_edges`` describes, with their IoU, similarity and gap, of tracks with
    names, times, the corners of their end and start boxes and vectors."""
    wide = pc.list_value_length(vectors).to_numpy()
    ends, starts = (np.ones(len(name), bool) if x is None else x for x in (ends, starts))
    pairs, values = [np.zeros((2, 0), np.int64)], [np.zeros((3, 0))]
    for w in np.unique(wide):
        u = np.zeros((int(w), len(name)))
        with np.errstate(invalid="ignore", over="ignore"):
            u[:, wide == w] = _units(matrix(vectors.filter(pa.array(wide == w)))).T
        first, second = np.flatnonzero(ends & (wide == w)), np.flatnonzero(starts & (wide == w))
        second = second[np.argsort(start[second], kind="stable")]
        # a little more than the gap is looked at, which is then asked for exactly
        lo = np.searchsorted(start[second], end[first], "left")
        n = np.maximum(np.searchsorted(start[second], end[first] + gap_ms + 1e-9 * (np.abs(end[first]) + abs(gap_ms)), "right") - lo, 0)
        upto = np.concatenate([[0], np.cumsum(n)])
        k = 0
        while k < len(first):
            to = max(k + 1, int(np.searchsorted(upto, upto[k] + 32768, "right")) - 1)
            i = np.repeat(first[k:to], n[k:to])
            j = second[np.arange(upto[to] - upto[k]) + np.repeat(lo[k:to] - (upto[k:to] - upto[k]), n[k:to])]
            k = to
            gap = start[j] - end[i]
            some = (gap >= 0) & (gap <= gap_ms) & (name[i] != name[j])
            i, j, gap = i[some], j[some], gap[some]
            inter = np.maximum(0.0, np.minimum(e[2][i], s[2][j]) - np.maximum(e[0][i], s[0][j])) * np.maximum(0.0, np.minimum(e[3][i], s[3][j]) - np.maximum(e[1][i], s[1][j]))
            union = (e[2][i] - e[0][i]) * (e[3][i] - e[1][i]) + (s[2][j] - s[0][j]) * (s[3][j] - s[1][j]) - inter
            some = (inter > 0) & (union > 0)
            iou = np.where(some, inter / np.where(some, union, 1.0), 0.0)
            some = iou >= least_iou
            i, j, gap, iou = i[some], j[some], gap[some], iou[some]
            sim = np.zeros(len(i))
            for x in u:  # in order of positions, so that equal vectors have equal sums
                sim += x[i] * x[j]
            good = 1 - sim <= max_distance
            pairs.append(np.stack([i, j])[:, good])
            values.append(np.stack([iou, sim, gap])[:, good])
    return *np.concatenate(pairs, axis=1), np.concatenate(values, axis=1)


def stitch_edges(tracks: DataFrame, keys: list[str], gap_ms: float = C.stitch_gap_ms, least_iou: float = C.stitch_iou, max_distance: float = C.stitch_distance, block: int = 2048) -> DataFrame:
    """Pairs (a, b): b starts within ``gap_ms`` of a's end, their end and start boxes overlap, and their
    representatives are near. A video's starts are searched in order for each end, so a vector is sent once, not once a
    pair. The ends and starts of a video of more than ``block`` tracks meet in buckets of the gap's width instead, which are
    dealt as pairs of ``block`` // 2 ends and starts each, so that it is spread over tasks, whatever its size.
    """
    width, cut_at = max(gap_ms, 1.0), max(block // 2, 1)
    sides = ("x1", "y1", "x2", "y2")
    here = F.lit(True)
    for k in keys:
        here = here & F.col(k).isNotNull()
    known = tracks.where(here & F.col("embedding").isNotNull() & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    parts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(*keys, F.ceil(F.col("n") / cut_at).alias("parts"))
    corners = [F.col(f"{e}_box.{c}").cast("double").alias(f"{e[0]}{c}") for e in ("start", "end") for c in sides]
    rows = known.select(*keys, F.col("track_id").alias("t"), *(F.col(c).cast("double").alias(c) for c in ("start_ms", "end_ms")), *corners, F.col("embedding").alias("u"))
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    own, others, none = F.pmod(F.xxhash64("t"), F.col("parts")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.lit(0).cast("long")
    place = lambda ends, starts, at, lo, hi: F.struct(F.lit(ends).alias("ends"), F.lit(starts).alias("starts"), at.alias("bucket"), lo.alias("lo"), hi.alias("hi"))
    from_ = lambda at: F.transform(others, lambda x: place(True, False, at, own, x))
    spread = F.concat(from_(bucket("end_ms")), from_(bucket("end_ms") + 1), F.transform(others, lambda x: place(False, True, bucket("start_ms"), x, own)))
    whole = F.array(place(True, True, none, none, none))
    dealt = rows.join(parts, keys, "left").withColumn("__at", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(spread))).drop("parts").select("*", "__at.*").drop("__at")
    track = tracks.schema["track_id"].dataType.simpleString()
    names = [*keys, "a", "b", "iou", "sim", "gap_ms"]

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        name = pc.dictionary_encode(t["t"].combine_chunks()).indices.to_numpy()
        boxes = [[t[f"{k}{c}"].to_numpy() for c in sides] for k in "es"]
        i, j, values = _edges(name, t["start_ms"].to_numpy(), t["end_ms"].to_numpy(), *boxes, t["u"], gap_ms, least_iou, max_distance, t["ends"].to_numpy(), t["starts"].to_numpy())
        i, j = pa.array(i), pa.array(j)
        return pa.table([*(t[k].take(i) for k in keys), t["t"].take(i), t["t"].take(j), *map(pa.array, values)], names=names)

    return dealt.groupBy(*keys, "bucket", "lo", "hi").applyInArrow(run, f"{kinds(tracks, *keys)}, a {track}, b {track}, iou double, sim double, gap_ms double")


def stitch_chains(tracks: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy chains: in order of start, from each unused track on to the unused successor of highest similarity; of
    equal ones to the first. Chains are numbered from 1 by their first tracks.

    A chain never leaves a component of the edges, so a component is a group, of tracks and lists of successors; tracks
    without edges are chains of their own. What is numbered is chains, by ranges.
    """
    rows = cut(tracks.select(*keys, "track_id", "start_ms", F.monotonically_increasing_id().alias("node")))
    of = rows.select(F.struct(*keys, F.col("track_id").cast("long").alias("t")).alias("__of"), F.col("node"), F.col("start_ms").alias("s"))
    end = lambda c: F.struct(*keys, F.col(c).cast("long").alias("t"))
    ends = edges.withColumn("__of", end("a")).join(of.select("__of", F.col("node").alias("na")), "__of").withColumn("__of", end("b"))
    links = cut(ends.join(of.withColumnsRenamed({"node": "nb", "s": "sb"}), "__of").select("na", "nb", "sb", "b", "sim"))
    roots = connected(links.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    near = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("neg"), "sb", "b", "nb"))), lambda x: x.nb)
    following = links.groupBy(F.col("na").alias("node")).agg(near.alias("next"))
    held = rows.select("node", "track_id", "start_ms").join(roots, "node").join(following, "node", "left")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("start_ms", "ascending"), ("track_id", "ascending"), ("node", "ascending")])
        nodes = t["node"].to_pylist()
        after = dict(zip(nodes, t["next"].to_pylist(), strict=True))
        chain: dict[int, tuple[int, int]] = {}
        for head in nodes:
            place, at = 0, head if head not in chain else None
            while at is not None:
                chain[at] = (head, place)
                place += 1
                at = next((x for x in after[at] or () if x not in chain), None)
        return pa.table({"node": nodes, "head": pa.array([chain[x][0] for x in nodes], pa.int64()), "position": pa.array([chain[x][1] for x in nodes], pa.int32())})

    found = held.groupBy("root").applyInArrow(run, "node long, head long, position int")
    placed = cut(rows.join(found, "node", "left").withColumns({"head": F.coalesce("head", "node"), "position": F.coalesce("position", F.lit(0))}))
    heads = numbered_within(placed.where("node = head").select(*keys, "start_ms", "track_id", "head"), keys, ["start_ms", "track_id", "head"], "nth")
    return placed.join(heads.select("head", (F.col("nth") + 1).cast("int").alias("chain_id")), "head").select(*keys, "track_id", "chain_id", "position")


def stitched(tracks: DataFrame, keys: list[str], gap_ms: float = C.stitch_gap_ms, least_iou: float = C.stitch_iou, max_distance: float = C.stitch_distance, block: int = 2048) -> DataFrame:
    """``stitch_chains`` over the edges of ``stitch_edges``, where the edges themselves are not asked for. A video of at most
    ``block`` tracks is a group: its edges are found and followed in its task, so what is exchanged is its tracks, and that
    once. Of larger videos, which are counted first, edges are written.
    """
    large = cut(tracks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(F.struct(*keys).alias("__of")))
    whole = tracks.select(*keys, "track_id", *(F.col(c).cast("double").alias(c) for c in ("start_ms", "end_ms")), "start_box", "end_box", "embedding")
    kind = {f.name: f.dataType.simpleString() for f in tracks.schema}
    sides = ("x1", "y1", "x2", "y2")

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        start, name = t["start_ms"].to_numpy(), pc.rank(t["track_id"], sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        known = t["embedding"].is_valid()
        for c in (*keys, "start_ms", "end_ms"):
            known = pc.and_(known, t[c].is_valid())
        own = np.flatnonzero(known.to_numpy())
        some = t.filter(known).combine_chunks()
        boxes = [[pc.struct_field(some[c], k).cast(pa.float64()).to_numpy() for k in sides] for c in ("end_box", "start_box")]
        i, j, (_, sim, _) = _edges(name[own], some["start_ms"].to_numpy(), some["end_ms"].to_numpy(), *boxes, some["embedding"], gap_ms, least_iou, max_distance)
        i, j = own[i], own[j]
        order = np.lexsort((name, start, t["start_ms"].is_valid().to_numpy()))
        by_name = order[np.argsort(name[order], kind="stable")]
        lo, hi = (np.searchsorted(name[by_name], name, side) for side in ("left", "right"))
        if len(name) and (hi - lo).max() > 1:  # an edge is one of names: rows of one name share it
            for _ in range(2):
                n = hi[j] - lo[j]
                j, i, sim = by_name[np.arange(n.sum()) + np.repeat(lo[j] - (np.cumsum(n) - n), n)], np.repeat(i, n), np.repeat(sim, n)
                i, j = j, i
        near = np.lexsort((j, name[j], start[j], -sim, i))
        i, j = i[near], j[near]
        upto = np.searchsorted(i, np.arange(len(name) + 1))
        chain, place, number = np.zeros(len(name), np.int32), np.zeros(len(name), np.int32), 0
        for at in order:
            if chain[at]:
                continue
            number, nth = number + 1, 0
            while True:
                chain[at], place[at] = number, nth
                after = j[upto[at] : upto[at + 1]]
                free = np.flatnonzero(chain[after] == 0)
                if not len(free):
                    break
                at, nth = after[free[0]], nth + 1
        return pa.table([*(t[k] for k in keys), t["track_id"], pa.array(chain), pa.array(place)], names=[*keys, "track_id", "chain_id", "position"])

    schema = f"{', '.join(f'`{k}` {kind[k]}' for k in [*keys, 'track_id'])}, chain_id int, position int"
    if not large.limit(1).count():
        return whole.groupBy(*keys).applyInArrow(run, schema)
    held = F.struct(*keys).eqNullSafe(F.col("__of"))
    small, rest = (whole.join(F.broadcast(large), held, how) for how in ("left_anti", "left_semi"))
    return small.groupBy(*keys).applyInArrow(run, schema).unionByName(stitch_chains(rest, stitch_edges(rest, keys, gap_ms, least_iou, max_distance, block), keys))


class Guard:
    """Identities of the samples of one tracker id, one after another: samples far from the running mean wait in
    quarantine; enough of them in a row make a new identity, a recovery gives them back.

    ``add`` and ``end`` give (sample, identity) for each sample as soon as it is decided; what is held is a mean for each
    identity and the samples that wait.
    """

    def __init__(
        self, min_picks: int = C.guard_min_picks, stride: int = C.guard_stride, consecutive: int = C.guard_consecutive, reject: float = C.guard_reject, margin: float = C.guard_margin, recover: int = C.guard_recover, split_below: float | None = C.split_below
    ) -> None:
        self._min_picks, self._stride, self._consecutive, self._reject, self._margin, self._recover, self._split_below = min_picks, stride, consecutive, reject, margin, recover, split_below
        self._sums: list[np.ndarray | float] = [0.0]
        self._counts, self._last = [0], [-float(stride)]
        self._now, self._streak, self._back = 0, 0, 0
        self._waiting: list[tuple[int, np.ndarray]] = []

    def _commit(self, samples: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
        for i, v in samples:
            self._sums[self._now] = self._sums[self._now] + v
            self._counts[self._now] += 1
            yield i, self._now

    def _release(self) -> Iterator[tuple[int, int]]:
        waiting, self._waiting = self._waiting, []
        yield from self._commit(waiting)

    def _similarity(self, v: np.ndarray) -> float | None:
        if self._counts[self._now] < self._min_picks:
            return None
        mean = self._sums[self._now] / self._counts[self._now]
        return float(mean @ v) / (float(np.linalg.norm(mean) * np.linalg.norm(v)) + 1e-9)

    def _new(self) -> None:
        self._now = len(self._sums)
        self._sums.append(0.0)
        self._counts.append(0)
        self._last.append(-float(self._stride))

    def add(self, i: int, frame: float, v: np.ndarray) -> Iterator[tuple[int, int]]:
        sim = None
        if self._counts[self._now] < self._min_picks or frame - self._last[self._now] >= self._stride:
            self._last[self._now] = float(frame)
            sim = self._similarity(v)
            if sim is not None and sim < self._reject:
                self._waiting.append((i, v))
                self._streak, self._back = self._streak + 1, 0
                if self._streak >= self._consecutive:
                    self._new()
                    self._last[self._now] = float(frame)
                    self._streak = 0
                    yield from self._release()
                return
            self._streak = 0
            if self._waiting:
                self._back = self._recover if sim is None else self._back + 1 if sim >= self._reject + self._margin else 0
                self._waiting.append((i, v))
                if self._back >= self._recover:
                    self._back = 0
                    yield from self._release()
                return
        else:
            self._streak, self._back = 0, 0
            yield from self._release()
        if self._split_below is not None:
            sim = self._similarity(v) if sim is None else sim
            if sim is not None and sim < self._split_below:
                self._new()
                self._sums[self._now] = self._sums[self._now] + v  # the seed counts twice
                self._counts[self._now] += 1
        yield from self._commit([(i, v)])

    def end(self) -> Iterator[tuple[int, int]]:
        yield from self._release()


def guard(frames: np.ndarray, vectors: np.ndarray, **rules) -> np.ndarray:
    """The identity number of each sample of one tracker id, in order."""
    fold, out = Guard(**rules), np.full(len(frames), -1)
    for i, (f, v) in enumerate(zip(frames, vectors, strict=True)):
        for j, n in fold.add(i, f, v):
            out[j] = n
    for j, n in fold.end():
        out[j] = n
    return out


def identity_guard(samples: DataFrame, keys: list[str], **rules) -> DataFrame:
    """``guard`` for each tracker id, as a fold over its samples in order of frames; samples without a usable vector have
    no identity."""
    rows = samples.select(*keys, "frame_idx", F.when(usable(samples), doubles(F.col("embedding"))).alias("v"))
    schema = kinds(rows, *keys, "frame_idx") + ", identity int"
    names = [*keys, "frame_idx", "identity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, key = Guard(**rules), None
        frames: dict[int, object] = {}  # of samples that wait
        count = 0

        def told(decided: list[tuple[int, int]]) -> pa.RecordBatch:
            out = pa.array([frames.pop(i) for i, _ in decided], key.schema.field("frame_idx").type)
            own = key.select(keys).take(pa.array(np.zeros(len(decided), int)))
            return pa.RecordBatch.from_arrays([*own.columns, out, pa.array([n for _, n in decided], pa.int32())], names=names)

        for new, part in runs(batches, len(keys)):
            if new and key is not None:
                yield told(list(fold.end()))
                fold, frames, count = Guard(**rules), {}, 0
            key = part.slice(0, 1)
            there = part["v"].is_valid()
            out = part.filter(pc.invert(there))
            yield pa.RecordBatch.from_arrays([*out.select([*keys, "frame_idx"]).columns, pa.nulls(out.num_rows, pa.int32())], names=names)
            part = part.filter(there)
            decided: list[tuple[int, int]] = []
            for f, v in zip(part["frame_idx"].to_pylist(), matrix(part["v"]) if part.num_rows else (), strict=True):
                frames[count] = f
                decided += fold.add(count, f, v)
                count += 1
            yield told(decided)
        if key is not None:
            yield told(list(fold.end()))

    return in_order(rows, keys, "frame_idx").mapInArrow(run, schema)
