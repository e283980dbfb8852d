"""Hard negatives by dual-tree search: for each anchor and each of its best positives, the best rows of other labels
whose score lies between a share of the positive's score and that score.

Components become integers, floor(scale * x); a score is an integer inner product, exact in 64 bits. Rows that are
equal in label and vector score alike, so of each such group only the few with the smallest ids can be among the first:
they are taken before the exchange (a limit on row numbers, which Spark applies within tasks first), and no copy group
fills a task.

A tree over a bounded sample, halved at the median of the widest principal direction, gives every row its path; rows in
order of label and path (anchors) or of path (candidates) lie in Spark's range partitions as the leaves of one tree.
Anchors are cut into groups of neighbours. Where candidates are sent to groups, nodes of neighbouring candidates are
met with whole groups first: an inner product lies within |rb|a| + ra|b| + ra rb| of that of the nodes' centres, and a
node is not sent where this interval leaves the group's range of wanted scores or its labels are all of the wrong kind.
A task then holds a group and streams its candidates in batches; both are halved again and again, and node pairs are
pruned by the same interval against what the node's anchors still want: the bounds of their ranges, and the score of
the last place once their places are taken. Pairs of leaves are scored exactly, by a matrix product in double
precision where sums stay below 2^53, in integers otherwise. The sample and the tree decide what is skipped, never
what is found. Where vectors fill many dimensions evenly, intervals exclude little and the work is that of all anchors
with all rows.

Rows with a null id, a null label, a null or empty vector, or a null or non-finite component take no part; nor do those
with a sum of squares of 2^55 or more after scaling, since a hundred times their scores would leave 64 bits. Rows of different dimensions don't
meet. Each row of a repeated id is a row: as an anchor it has results of its own, and the other rows of its id may be
its positives. Equal scores go by the smaller id. An empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwell.llm.shared import settle, table

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative's score is at least this share of its positive's, in hundredths, and no more than it.
LEAST_SHARE = 80
#: Rows of the sample that the tree is made of, and of its leaves.
SAMPLE, SAMPLE_LEAF = 8192, 8
#: Anchors of a group (more where there would be over MOST_GROUPS groups), and rows that a lane of candidates holds.
GROUP, MOST_GROUPS = 4096, 4096
LANE, MOST_LANES = 16384, 256
_LEAF_A, _LEAF_B = 64, 256
#: Found pairs that are kept before they are reduced to the best.
_HELD = 1 << 18
_FAR = 1 << 62


def scaled(column: pa.Array, scale: int = SCALE) -> list[bytes | None]:
    """The integer components of each vector as 32-bit integers, None for those that take no part."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy()
    out: list[bytes | None] = []
    for k, there in enumerate(column.is_valid().to_numpy(zero_copy_only=False)):
        with np.errstate(over="ignore"):
            q = np.floor(scale * values[offsets[k] : offsets[k + 1]])
            fits = there and len(q) and np.isfinite(q).all() and float(q @ q) < 2.0**55
        out.append(q.astype("<i4").tobytes() if fits else None)
    return out


class Tree:
    """A binary tree over a sample of vectors of one dimension; the path of a vector is its leaf's place from the left."""

    def __init__(self, sample: np.ndarray) -> None:
        self._nodes: list[tuple[np.ndarray, float] | None] = [None]
        self._depth = 0
        level = [sample]
        while level and max(map(len, level)) > SAMPLE_LEAF:
            below = []
            for k, rows in enumerate(level):
                at = (1 << self._depth) + k
                self._nodes += [None] * (at + 1 - len(self._nodes))
                cut = self._cut(rows)
                self._nodes[at] = cut
                right = rows @ cut[0] > cut[1]
                below += [rows[~right], rows[right]]
            level = below
            self._depth += 1

    @staticmethod
    def _cut(rows: np.ndarray) -> tuple[np.ndarray, float]:
        """Direction of the largest variance, by a few steps of the power method, and the median along it."""
        if len(rows) < 2:
            return np.zeros(rows.shape[1]), 0.0
        centred = rows - rows.mean(axis=0)
        way = centred[np.argmax((centred**2).sum(axis=1))].copy()
        for _ in range(4):
            length = np.linalg.norm(way)
            if not length:
                break
            way = centred.T @ (centred @ (way / length))
        length = np.linalg.norm(way)
        way = way / length if length else way
        return way, float(np.median(rows @ way))

    def paths(self, rows: np.ndarray) -> np.ndarray:
        at = np.ones(len(rows), np.int64)
        for _ in range(self._depth):
            new = np.empty_like(at)
            for node in np.unique(at):
                here = np.flatnonzero(at == node)
                way, cut = self._nodes[node]
                new[here] = 2 * node + (rows[here] @ way > cut)
            at = new
        return at - (1 << self._depth)


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), -1).astype(np.float64)


def plan_trees(sample: list[bytes]) -> dict[int, Tree]:
    by: dict[int, list[bytes]] = {}
    for raw in dict.fromkeys(sample):
        by.setdefault(len(raw) // 4, []).append(raw)
    return {dim: Tree(_matrix(raw)) for dim, raw in by.items()}


@dataclass
class Nodes:
    """Rows of one dimension in tree order, with the balls of their leaves."""

    q: np.ndarray
    leaf: int
    starts: np.ndarray = field(init=False)
    centre: np.ndarray = field(init=False)
    radius: np.ndarray = field(init=False)
    length: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.starts = np.arange(0, len(self.q), self.leaf)
        sizes = np.diff(np.append(self.starts, len(self.q)))
        self.centre = np.add.reduceat(self.q, self.starts, axis=0) / sizes[:, None]
        off = self.q - np.repeat(self.centre, sizes, axis=0)
        self.radius = np.sqrt(np.maximum.reduceat((off**2).sum(axis=1), self.starts))
        self.length = np.sqrt((self.centre**2).sum(axis=1))

    def rows(self, k: int) -> slice:
        return slice(k * self.leaf, min((k + 1) * self.leaf, len(self.q)))

    def ball(self, lo: int, hi: int) -> tuple[np.ndarray, float]:
        """A ball around the leaves lo to hi."""
        if hi - lo == 1:
            return self.centre[lo], float(self.radius[lo])
        centre = self.centre[lo:hi].mean(axis=0)
        return centre, float((np.sqrt(((self.centre[lo:hi] - centre) ** 2).sum(axis=1)) + self.radius[lo:hi]).max())


def interval(a: tuple[np.ndarray, float], b: tuple[np.ndarray, float]) -> tuple[float, float]:
    """Bounds of the inner products of two balls, a little wider than they are for rounding."""
    middle = float(a[0] @ b[0])
    la, lb = float(np.linalg.norm(a[0])), float(np.linalg.norm(b[0]))
    reach = a[1] * lb + b[1] * la + a[1] * b[1]
    reach += 1e-9 * (reach + la * lb) + 1e-6
    return middle - reach, middle + reach


@dataclass
class Asked:
    """A group of anchors: each with windows of wanted scores, as many for each, and the rows found for each window."""

    rows: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    lo: np.ndarray  # anchors by windows
    hi: np.ndarray
    same: bool  # rows of the anchor's label are wanted, or of others
    k: int

    def __post_init__(self) -> None:
        self.tree = Nodes(self.q, _LEAF_A)
        self.most = float(np.abs(self.q).max(initial=0))
        self.need = self.lo.copy()  # the least score that is still wanted
        self._found: list[tuple[np.ndarray, ...]] = []
        self._held = 0

    def meet(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        """Candidates of one batch, in tree order."""
        other = Nodes(q, _LEAF_B)
        small = self.most * float(np.abs(q).max(initial=0)) * q.shape[1] < 2.0**53
        own_labels = [set(self.labels[self.tree.rows(i)].tolist()) for i in range(len(self.tree.starts))]
        their_labels = [set(labels[other.rows(j)].tolist()) for j in range(len(other.starts))]

        def hopeless(a: slice, kinds_a: set, kinds_b: set, ball_a, ball_b) -> bool:
            if (not kinds_a & kinds_b) if self.same else (len(kinds_a) == 1 and kinds_a == kinds_b):
                return True
            low, high = interval(ball_a, ball_b)
            return high < self.need[a].min() or low > self.hi[a].max()

        def descend(a0: int, a1: int, b0: int, b1: int) -> None:
            kinds_a, kinds_b = set().union(*own_labels[a0:a1]), set().union(*their_labels[b0:b1])
            a = slice(a0 * _LEAF_A, min(a1 * _LEAF_A, len(self.q)))
            if hopeless(a, kinds_a, kinds_b, self.tree.ball(a0, a1), other.ball(b0, b1)):
                return
            if a1 - a0 == 1 and b1 - b0 == 1:
                self._score(a, ids, rows, labels, q, other.rows(b0), small)
            elif b1 - b0 > 1 and (a1 - a0 == 1 or (b1 - b0) * _LEAF_B >= (a1 - a0) * _LEAF_A):
                mid = (b0 + b1) // 2
                descend(a0, a1, b0, mid)
                descend(a0, a1, mid, b1)
            else:
                mid = (a0 + a1) // 2
                descend(a0, mid, b0, b1)
                descend(mid, a1, b0, b1)

        descend(0, len(self.tree.starts), 0, len(other.starts))

    def _score(self, a: slice, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, q: np.ndarray, b: slice, small: bool) -> None:
        score = (self.q[a] @ q[b].T).astype(np.int64) if small else self.q[a].astype(np.int64) @ q[b].astype(np.int64).T
        right = (self.labels[a][:, None] == labels[b]) == self.same
        if self.same:
            right &= self.rows[a][:, None] != rows[b]
        for w in range(self.lo.shape[1]):
            i, j = np.nonzero(right & (score >= self.need[a, w][:, None]) & (score <= self.hi[a, w][:, None]))
            if len(i):
                self._found.append(((i + a.start) * self.lo.shape[1] + w, score[i, j], ids[b][j]))
                self._held += len(i)
        if self._held > _HELD:
            self._reduce()

    def _reduce(self) -> None:
        if not self._found:
            return
        at, score, ids = (np.concatenate(x) for x in zip(*self._found, strict=True))
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < self.k
        at, score, ids = at[keep], score[keep], ids[keep]
        last = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) == self.k - 1)
        self.need.reshape(-1)[at[last]] = score[last]
        self._found, self._held = [(at, score, ids)], len(at)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors' rows, windows, scores and ids of what was found."""
        self._reduce()
        at, score, ids = self._found[0] if self._found else (np.empty(0, np.int64),) * 3
        return self.rows[at // self.lo.shape[1]], at % self.lo.shape[1], score, ids


@dataclass(frozen=True)
class _Summary:
    """What a group of anchors wants: its ball, its labels and its range of scores."""

    group: int
    dim: int
    centre: np.ndarray
    radius: float
    labels: frozenset
    lo: float
    hi: float


def _slices(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where one of the key columns (longs) changes."""
    for batch in batches:
        if batch.num_rows:
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in keys:
                own = batch[k].to_numpy()
                new[1:] |= own[1:] != own[:-1]
            cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                yield tuple(batch[k][lo].as_py() for k in keys), batch.slice(lo, hi - lo)


def _search(anchors: DataFrame, candidates: DataFrame, same: bool, k: int) -> DataFrame:
    """(row, window, rank, id, score) of the best ``k`` candidates for each window of each anchor.

    ``anchors``: (group, dim, place, row, label, q, lo, hi), settled; ``candidates``: (lane, dim, path, id, row, label,
    q), settled in tree order.
    """
    lanes = (candidates.agg(F.max("lane")).first()[0] or 0) + 1
    sc = anchors.sparkSession.sparkContext

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # balls of a group's slices; the group's own holds them all
        for (group, dim), b in _slices(batches, "group", "dim"):
            nodes = Nodes(_matrix(b["q"].to_pylist()), b.num_rows)
            lo, hi = (x for x in (b["lo"].flatten().to_numpy(), b["hi"].flatten().to_numpy()))
            if len(lo):
                yield pa.RecordBatch.from_pydict(
                    {"group": [group], "dim": [dim], "centre": [nodes.centre[0].tolist()], "radius": [float(nodes.radius[0])], "labels": [sorted(set(b["label"].to_pylist()))], "lo": [int(lo.min())], "hi": [int(hi.max())]},
                    schema=pa.schema([("group", pa.int64()), ("dim", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("labels", pa.list_(pa.int64())), ("lo", pa.int64()), ("hi", pa.int64())]),
                )

    # a row a group, or a few: groups are at most twice MOST_GROUPS
    got = anchors.select("group", "dim", "label", "q", "lo", "hi").mapInArrow(summed, "group long, dim long, centre array<double>, radius double, labels array<long>, lo long, hi long").collect()
    wanted = sc.broadcast([_Summary(r.group, r.dim, np.array(r.centre), r.radius, frozenset(r.labels), float(r.lo), float(r.hi)) for r in got])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim,), b in _slices(batches, "dim"):
            mine = [s for s in wanted.value if s.dim == dim]
            nodes = Nodes(_matrix(b["q"].to_pylist()), _LEAF_B) if mine else None
            labels = b["label"].to_numpy()
            for n in range(len(nodes.starts) if nodes else 0):
                at = nodes.rows(n)
                kinds, ball = set(labels[at].tolist()), nodes.ball(n, n + 1)
                groups = set()
                for s in mine:
                    if (not s.labels & kinds) if same else (len(s.labels) == 1 and s.labels == kinds):
                        continue
                    low, high = interval((s.centre, s.radius), ball)
                    if high >= s.lo and low <= s.hi:
                        groups.add(s.group)
                own = b.slice(at.start, at.stop - at.start)
                for g in sorted(groups):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(own.num_rows, g)), *own.columns], names=["group", *own.schema.names])

    copies = candidates.select("lane", "dim", "path", "id", "row", "label", "q").mapInArrow(sent, "group long, lane long, dim long, path long, id long, row long, label long, q binary")
    null = lambda t: F.lit(None).cast(t)
    theirs = copies.select("group", "lane", F.lit(1).cast("long").alias("side"), "dim", F.col("path").alias("place"), "id", "row", "label", "q", null("array<long>").alias("lo"), null("array<long>").alias("hi"))
    ours = anchors.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"), F.lit(0).cast("long").alias("side"), "dim", "place", null("long").alias("id"), "row", "label", "q", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: list[pa.RecordBatch] = []
        asked: Asked | None = None

        def done() -> Iterator[pa.RecordBatch]:
            if asked is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in asked.best()], names=["row", "window", "score", "id"])

        for (group, at, dim, side), b in _slices(batches, "group", "lane", "dim", "side"):
            if (group, at, dim) != now:
                yield from done()
                now, held, asked = (group, at, dim), [], None
            if side == 0:
                held.append(b)
                continue
            if asked is None:
                if not held:
                    continue
                t = pa.Table.from_batches(held)
                width = max(map(len, t["lo"].to_pylist()))
                fill = lambda c, x: np.array([[*v, *[x] * (width - len(v))] for v in t[c].to_pylist()], np.int64).reshape(-1, width)  # noqa: E731, B023
                asked = Asked(t["row"].to_numpy(), t["label"].to_numpy(), _matrix(t["q"].to_pylist()), fill("lo", _FAR), fill("hi", -_FAR), same, k)
                held = []
            asked.meet(b["id"].to_numpy(), b["row"].to_numpy(), b["label"].to_numpy(), _matrix(b["q"].to_pylist()))
        yield from done()

    both = ours.unionByName(theirs)
    tasks = max(1, min(len(wanted.value) * lanes, 4096))
    dealt = both.repartition(tasks, "group", "lane").sortWithinPartitions("group", "lane", "dim", "side", "place", "row")
    each = dealt.mapInArrow(run, "row long, window long, score long, id long")
    w = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _merged(parts: DataFrame, most: int, out: str) -> DataFrame:
    """Adds the number of a group of neighbouring partitions (column part, in their order), which ends with the one that
    brings it to ``most`` rows. A row a partition is compared and broadcast."""
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(sizes.select("part", F.floor(before / most).alias(out))), "part").drop("part")


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, least_share: int = LEAST_SHARE, group: int = GROUP, lane: int = LANE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchor`` (boolean) and ``label`` (integer) are expressions on the columns of ``vectors``.
    """
    spark = vectors.sparkSession
    cast = vectors.select(F.col("vec_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("v"))

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("id", "row", "label", "anchor")), pa.array(scaled(b["v"], scale), pa.binary())], names=["id", "row", "label", "anchor", "q"])

    whole = cast.where("id IS NOT NULL AND label IS NOT NULL").mapInArrow(integers, "id long, row long, label long, anchor boolean, q binary").where("q IS NOT NULL")
    rows = settle(whole.withColumn("dim", F.expr("length(q) DIV 4")), "rows")
    sample = [r.q for r in rows.select("q").orderBy(F.xxhash64("q"), "q").limit(SAMPLE).collect()]
    trees: Broadcast = spark.sparkContext.broadcast(plan_trees(sample))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b["q"].to_pylist()
            dims = b["dim"].to_numpy()
            path = np.zeros(len(raw), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim in trees.value:
                    path[at] = trees.value[dim].paths(_matrix([raw[i] for i in at]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(path)], names=[*b.schema.names, "path"])

    on_tree = lambda df: df.mapInArrow(placed, "id long, row long, label long, anchor boolean, q binary, dim long, path long")
    # an anchor may be one of those itself
    copies = Window.partitionBy("label", "q").orderBy("id", "row")
    few = rows.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= max(positives + 1, negatives)).drop("nth")
    few = settle(on_tree(few.select(rows.columns)), "few")
    n_anchors, n_candidates = rows.where("anchor").count(), few.count()
    lanes = min(MOST_LANES, max(1, math.ceil(n_candidates / lane)))
    lane = max(lane, math.ceil(n_candidates / MOST_LANES))
    in_tree = few.repartitionByRange(lanes, "dim", "path", "q", "row").sortWithinPartitions("dim", "path", "q", "row")
    candidates = _merged(settle(in_tree.withColumn("part", F.spark_partition_id()), "candidates"), lane, "lane")
    size = max(group, math.ceil(n_anchors / MOST_GROUPS))
    own = ["dim", "label", "path", "q", "row"]
    grouped = on_tree(rows.where("anchor")).repartitionByRange(max(1, math.ceil(n_anchors / size)), *own).sortWithinPartitions(*own)
    anchors = settle(grouped.select("dim", "label", F.col("path").alias("place"), "q", "row", "id", F.spark_partition_id().alias("part")), "anchors")
    anchors = _merged(anchors, size, "group")

    any_ = anchors.withColumn("lo", F.array(F.lit(-_FAR))).withColumn("hi", F.array(F.lit(_FAR)))
    best = settle(_search(any_, candidates, True, positives).select("row", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # the quotient, rounded up; DIV rounds towards zero
    least = F.expr(f"(positive_score * {least_share}L + IF(positive_score > 0, 99L, 0L)) DIV 100")
    windows = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", least.alias("lo"), F.col("positive_score").alias("hi")))).alias("w"))
    ranged = anchors.join(windows, "row").withColumn("lo", F.transform("w", lambda x: x.lo)).withColumn("hi", F.transform("w", lambda x: x.hi)).drop("w")
    found = _search(settle(ranged, "ranged"), candidates, False, negatives)
    told = found.select("row", (F.col("window") + 1).cast("int").alias("nth"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best.withColumnRenamed("rank", "nth").join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return told.join(named, ["row", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_dual_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
