"""Faces to tracks by boxes, and vectors to identities by cosine.

Boxes meet by an equi-join on their frame (and video), never by a cross join; ``order`` columns break ties.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dwell.config import DEFAULT as C
from dwell.functions import geometry as G
from dwell.functions.numbers import nearest
from dwell.functions.vectors import common_width, doubles, usable
from dwell.operators.folds import in_order, kinds, runs
from dwell.operators.graph import cut


def detected(detections: DataFrame, min_score: float, class_id: int | None = None) -> DataFrame:
    """Detections of at least a score, of one class where it is given."""
    sure = detections.where(F.col("score") >= min_score)
    return sure if class_id is None else sure.where(F.col("class_id") == class_id)


def pairs(faces: DataFrame, tracks: DataFrame, frame: list[str], dilate: float, width: float, height: float, least: float) -> DataFrame:
    """Faces (face_idx, face_box) with tracks (track_idx, track_id, track_box) of their frame, at ``least`` IoU with
    the dilated box or more. Boxes are dilated once a track, and only boxes that meet are divided, once each: an overlap
    that is exploded is a column, where Spark would otherwise put its formula into each filter, up to the join's condition,
    which then is too long for the JVM to compile."""
    grown = tracks.withColumn("grown", G.dilate(F.col("track_box"), dilate, width, height))
    return _overlapping(faces.join(grown, frame), least)


def pairs_within(detections: DataFrame, frame: list[str], face: Column, dilate: float, width: float, height: float, least: float) -> DataFrame:
    """The same for detections (det_idx, track_id, bbox, score) of one table, faces where ``face`` holds, else tracks: frame,
    face_idx, face_box, score, track_idx, track_id, track_box and iou. Each face gets its frame's tracks by a window, so that
    detections are made and sorted once, where both sides of a join would make them."""
    track = F.struct(F.col("det_idx").alias("track_idx"), "track_id", F.col("bbox").alias("track_box"), G.dilate(F.col("bbox"), dilate, width, height).alias("grown"))
    known = detections.where(" AND ".join(f"`{c}` IS NOT NULL" for c in frame)).withColumn("__face", F.coalesce(face, F.lit(False)))
    beside = known.withColumn("__tracks", F.collect_list(F.when(~F.col("__face"), track)).over(Window.partitionBy(*frame)))
    each = beside.where("__face").select(*frame, F.col("det_idx").alias("face_idx"), F.col("bbox").alias("face_box"), "score", F.inline("__tracks"))
    return _overlapping(each, least)


def _overlapping(pairs: DataFrame, least: float) -> DataFrame:
    near = pairs.where(G.meet(F.col("face_box"), F.col("grown")))
    return near.withColumn("iou", F.explode(F.array(G.iou(F.col("face_box"), F.col("grown"))))).drop("grown").where((F.col("iou") >= least) & (F.col("iou") > 0))


def greedy_faces(matches: DataFrame, frame: list[str]) -> DataFrame:
    """Each face's best track, the first on a tie; a track may take many faces."""
    best = F.min_by(F.struct("track_idx", "track_id", "iou"), F.struct(-F.col("iou"), F.col("track_idx")))
    return matches.groupBy(*frame, "face_idx").agg(best.alias("m")).select(*frame, "face_idx", "m.track_id", "m.iou")


def temporal_faces(
    faces: DataFrame, observations: DataFrame, frame: str, track: list[str], tolerance: int, dilate: float, width: float, height: float, least: float, digits: int | None = None, video: list[str] | None = None
) -> DataFrame:
    """Each face's best track among those observed in its frame, over the boxes that the track's live fragment had in
    the last ``tolerance`` frames: the larger overlap first (compared at ``digits`` digits), then the earlier track of
    the frame, then the later box.

    ``track`` names the columns of a fragment (``segments.fragments``), so that a track that was away brings no old
    boxes along. A window gives each observation the few boxes it has, and faces meet observations by frame.
    """
    w = Window.partitionBy(*track).orderBy(frame).rangeBetween(-tolerance, 0)
    seen = F.struct(F.col(frame).alias("seen_frame"), G.dilate(F.col("track_box"), dilate, width, height).alias("box"))
    recent = observations.withColumn("boxes", F.collect_list(seen).over(w)).drop("track_box")
    each = faces.join(recent, [*(video or []), frame]).withColumn("seen", F.explode("boxes")).drop("boxes")
    near = each.where(G.meet(F.col("face_box"), F.col("seen.box"))).withColumn("iou", G.iou(F.col("face_box"), F.col("seen.box")))
    if digits is not None:
        near = near.withColumn("iou", nearest(F.col("iou"), digits))
    key = F.struct(-F.col("iou"), F.col("track_idx"), -F.col("seen.seen_frame"))
    best = F.min_by(F.struct("track_id", "iou", F.col("seen.seen_frame").alias("seen_frame")), key)
    found = near.where((F.col("iou") >= least) & (F.col("iou") > 0)).groupBy(*(video or []), frame, "face_idx").agg(best.alias("m"))
    return found.select(*(video or []), frame, "face_idx", "m.track_id", "m.iou", "m.seen_frame")


def best_face_per_track(matches: DataFrame, frame: list[str]) -> DataFrame:
    """Of several faces of a track: the higher score (to 1e-6), then the larger overlap, then the first."""
    key = F.struct(-F.bround(F.col("score"), 6), -F.col("iou"), F.col("face_idx"))
    return matches.groupBy(*frame, "track_id").agg(F.min_by(F.struct("face_idx", "score", "iou"), key).alias("m")).select(*frame, "track_id", "m.face_idx", "m.score", "m.iou")


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row of a cost matrix with no more rows than columns, at the least total cost (shortest
    augmenting paths with potentials)."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0] = i
        j0 = 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = ~used[1:]
            reduced = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


#: Totals of a matching are compared at so many digits; overlaps nearer than a unit of the last (and what sums lose) may
#: decide nothing.
_DIGITS, _TIE = 8, 1.5e-8
#: Totals this near to a half of the last digit may round either way, as their overlaps are summed.
_NEAR = 1e-11
#: Choices of a frame's faces that are tried one by one.
_CHOICES = 2000


def _unit(total: float) -> int:
    """A total in units of the last digit, halves up."""
    x = total * 10.0**_DIGITS
    low = math.floor(x)
    return low + (x - low >= 0.5)


def _precedence(tracks: Iterable[float]) -> tuple:
    """Of matchings equal in all that counts the one with the largest goes first: that which ends with an earlier face, then
    that whose last face has no track or the later one (``inf`` is none), then the face before it, and so on. The SQL leaves
    this open; it is the order in which it mostly comes upon them."""
    back = list(tracks)
    while back and back[-1] == math.inf:
        back.pop()
    return -len(back), back[::-1]


def _tried(options: list[list[tuple[int, int, float]]]) -> list[int]:
    """Places of the best matching over (place, track, overlap) of each face in order: all are tried."""
    best, chosen, of = None, [], ()

    def go(k: int, used: tuple[float, ...], picked: tuple[int, ...], total: float, weight: int) -> None:
        nonlocal best, chosen, of
        if k == len(options):
            key = (len(picked), _unit(total), -weight)
            if best is None or key > best or key == best and _precedence(used) > _precedence(of):
                best, chosen, of = key, list(picked), used
            return
        if best is not None and len(picked) + len(options) - k < best[0]:
            return
        for place, track, iou in options[k]:
            if track not in used:
                go(k + 1, (*used, track), (*picked, place), total + iou, weight + (k + 1) * (track + 1) ** 2)
        go(k + 1, (*used, math.inf), picked, total, weight)

    go(0, (), (), 0.0, 0)
    return chosen


def _largest(options: list[list[tuple[int, float]]], count: int) -> float:
    """The largest total of ``count`` pairs over (track, overlap) of each face, as it is summed in order of faces: a larger
    sum stays no smaller whatever is added, so one is kept for the tracks taken. Tracks with the same overlaps count as one
    kind, and those that no later face may take are forgotten."""
    of: dict[int, tuple] = {}
    for i, o in enumerate(options):
        for t, iou in o:
            of[t] = (*of.get(t, ()), (i, iou))
    kind = {c: x for x, c in enumerate(dict.fromkeys(of.values()))}
    room, last = Counter(kind[c] for c in of.values()), [c[-1][0] for c in kind]
    reach = {((0,) * len(kind), 0): 0.0}  # tracks taken of each kind, and pairs
    for i, o in enumerate(options):
        after: dict[tuple, float] = {}
        moves = [(None, 0.0), *{kind[of[t]]: iou for t, iou in o}.items()]
        for (taken, k), total in reach.items():
            for c, iou in moves:
                n = k + (c is not None)
                if n + len(options) - i - 1 >= count and (c is None or taken[c] < room[c]):
                    key = (tuple(0 if last[x] <= i else a + (x == c) for x, a in enumerate(taken)), n)
                    after[key] = max(after.get(key, 0.0), total + iou)
        reach = after
    return max(total for (_, k), total in reach.items() if k == count)


def _searched(options: list[list[tuple[int, int, float]]]) -> list[int]:
    """The same for frames of many pairs: the matching of the largest total is solved, then matchings come in order of
    their weight, over pairs that such a total may hold, until one has that total at the digits that count."""
    n, m = len(options), max((t for o in options for _, t, _ in o), default=-1) + 1
    at = {(i, t): (place, iou) for i, o in enumerate(options) for place, t, iou in o}
    wide = m + n  # a face may stay without a track, at a column of its own

    def solved(cost_of, barred: frozenset, forced: frozenset) -> tuple[list[tuple[int, int]], float] | None:
        """Pairs of the least cost with the most pairs, with the forced ones and without the barred ones."""
        rows, columns = [i for i in range(n) if all(i != a for a, _ in forced)], [t for t in range(wide) if all(t != b for _, b in forced)]
        big = 4.0 * n * max((abs(cost_of(*k)) for k in at), default=1.0) + 1.0
        cost = np.full((len(rows), len(columns)), 1e3 * big)
        for x, i in enumerate(rows):
            for y, t in enumerate(columns):
                if (i, t) in at and (i, t) not in barred:
                    cost[x, y] = cost_of(i, t)
                elif t == m + i and (i, t) not in barred:
                    cost[x, y] = big
        took = assignment(cost) if rows else []
        pairs = [*forced, *((rows[x], columns[y]) for x, y in enumerate(took))]
        if any(cost[x, y] >= 1e3 * big for x, y in enumerate(took)):
            return None
        return sorted(pairs), sum(cost_of(i, t) if t < m else big for i, t in pairs)

    def score(pairs: list[tuple[int, int]]) -> tuple[int, int]:
        total = 0.0
        for p in pairs:
            total += at[p][1] if p in at else 0.0
        return sum(p in at for p in pairs), _unit(total)

    most, _ = solved(lambda i, t: -at[i, t][1], frozenset(), frozenset())
    goal = score(most)
    weight = lambda i, t: float((i + 1) * (t + 1) ** 2)
    # a pair that takes the best total down by more than a tie is in no matching sought
    best = sum(at[p][1] for p in most if p in at)

    def possible(p: tuple[int, int]) -> bool:
        one = solved(lambda i, t: -at[i, t][1], frozenset(), frozenset([p]))
        return one is not None and sum(q in at for q in one[0]) == goal[0] and sum(at[q][1] for q in one[0] if q in at) >= best - _TIE

    never = frozenset(p for p in at if not possible(p))
    if _unit(best - _NEAR) != _unit(best + _NEAR):  # the same overlaps in another order may round up
        goal = goal[0], _unit(_largest([[(t, iou) for _, t, iou in o if (i, t) not in never] for i, o in enumerate(options)], goal[0]))
    first = solved(weight, never, frozenset())
    queue, order = [(first[1], 0, first[0], never, frozenset())], 0
    found: list[tuple[float, list[tuple[int, int]]]] = []
    while queue and not (found and queue[0][0] > found[0][0]):
        cost, _, pairs, barred, forced = heapq.heappop(queue)
        if score(pairs) == goal:
            found.append((cost, pairs))
        for p in pairs:
            if p not in forced:
                order += 1
                one = solved(weight, barred | {p}, forced)
                if one is not None and sum(q in at for q in one[0]) == goal[0]:
                    heapq.heappush(queue, (one[1], order, one[0], barred | {p}, forced))
                forced = forced | {p}
    taken = max((pairs for _, pairs in found), key=lambda pairs: _precedence(t if t < m else math.inf for _, t in pairs), default=most)
    return [at[p][0] for p in taken if p in at]


def best_matching(faces: list, tracks: list, iou: list[float]) -> list[int]:
    """Places of the pairs of the matching that ``optimal_faces`` describes."""
    kept: dict[tuple, int] = {}  # of several overlaps of a pair the largest
    for k, pair in enumerate(zip(faces, tracks, strict=True)):
        if pair not in kept or iou[k] > iou[kept[pair]]:
            kept[pair] = k
    column = {t: j for j, t in enumerate(sorted(set(tracks)))}
    options: dict[object, list[tuple[int, int, float]]] = {f: [] for f in sorted(set(faces))}
    for (f, t), k in sorted(kept.items()):
        options[f].append((k, column[t], iou[k]))
    choices = math.prod(len(o) + 1 for o in options.values())
    return (_tried if choices <= _CHOICES else _searched)(list(options.values()))


def optimal_faces(matches: DataFrame, frame: list[str]) -> DataFrame:
    """The one-to-one matching of each frame with the most pairs, and of those the largest total overlap at 8 digits, over
    the given pairs; of equal ones that of the least sum of a face's place by its track's place squared, then ``_precedence``.

    Where the best tracks of a frame's faces differ, and each is better than the face's second by more than a tie, they
    are that matching. Only contested frames are solved, each when its rows have passed: its pairs are few.
    """
    rows = matches.select(*frame, "face_idx", "track_idx", "track_id", "iou").repartition(*frame)
    of_face, of_frame = Window.partitionBy(*frame, "face_idx"), Window.partitionBy(*frame)
    ranked = rows.withColumn("__nth", F.row_number().over(of_face.orderBy(F.desc("iou"), "track_idx")))
    best = F.max(F.when(F.col("__nth") == 1, F.col("track_idx"))).over(of_face)
    first = ranked.withColumn("__best", best).withColumn("__second", F.max(F.when(F.col("track_idx") != F.col("__best"), F.col("iou"))).over(of_face))
    sure = F.coalesce(F.col("iou") - F.col("__second") > _TIE, F.lit(True)) | (F.col("__nth") > 1)
    alike = F.count(F.when(F.col("__nth") == 1, 1)).over(of_frame) == F.size(F.collect_set(F.when(F.col("__nth") == 1, F.col("track_idx"))).over(of_frame))
    marked = first.withColumn("__open", ~(F.min(sure).over(of_frame) & alike))
    known = marked.where("__open OR __nth = 1").select(*frame, "face_idx", "track_idx", "track_id", "iou", "__open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last frame of what came before

        def matched(many: pa.RecordBatch) -> pa.RecordBatch:
            """The matchings of whole frames, one after another."""
            new = np.ones(many.num_rows, bool)
            new[1:] = False
            for c in frame:
                code = pc.dictionary_encode(many[c], null_encoding="encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            faces, tracks, iou = (many[c].to_pylist() for c in ("face_idx", "track_idx", "iou"))
            taken: list[int] = []
            for lo, hi in pairwise([*np.flatnonzero(new).tolist(), many.num_rows]):
                taken += [lo + k for k in best_matching(faces[lo:hi], tracks[lo:hi], iou[lo:hi])]
            return many.take(pa.array(taken, pa.int64())).drop_columns(["track_idx", "__open"])

        for batch in batches:
            yield batch.filter(pc.invert(batch["__open"])).drop_columns(["track_idx", "__open"])
            part = batch.filter(batch["__open"])
            if not part.num_rows:
                continue
            last = [part[c][part.num_rows - 1].as_py() for c in frame]
            start = part.num_rows - 1  # where the last frame begins
            while start and [part[c][start - 1].as_py() for c in frame] == last:
                start -= 1
            if start:
                yield matched(pa.concat_batches([*held, part.slice(0, start)]))
                held = [part.slice(start)]
            elif held and [held[0][c][0].as_py() for c in frame] != last:
                yield matched(pa.concat_batches(held))
                held = [part]
            else:
                held.append(part)
        if held:
            yield matched(pa.concat_batches(held))

    return known.sortWithinPartitions(*frame, "face_idx", "track_idx").mapInArrow(run, kinds(rows, *frame, "face_idx", "track_id", "iou"))


def center_fallback(faces: DataFrame, tracks: DataFrame, frame: list[str], unique_only: bool = True) -> DataFrame:
    """Unmatched tracks take the face whose centre lies in their box, if it is the only one; tracks claim in order,
    so what an earlier track took is no candidate of a later one. The order is folded within each frame."""
    inside = faces.join(tracks, frame).where(G.center_in(F.col("face_box"), F.col("track_box")))
    per_track = inside.groupBy(*frame, "track_idx", "track_id").agg(F.array_sort(F.collect_list("face_idx")).alias("faces"))
    ordered = per_track.groupBy(*frame).agg(F.array_sort(F.collect_list(F.struct("track_idx", "track_id", "faces"))).alias("tracks"))
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<track_id:bigint,face_idx:bigint>>").alias("out"))

    def claim(state, track):
        free = F.array_except(track.faces.cast("array<bigint>"), state.used)
        one = F.get(free, F.lit(0))
        ok = F.size(free) == 1 if unique_only else F.size(free) >= 1
        return F.when(
            ok,
            F.struct(
                F.array_append(state.used, one).alias("used"),
                F.array_append(state.out, F.struct(track.track_id.cast("bigint").alias("track_id"), one.alias("face_idx"))).alias("out"),
            ),
        ).otherwise(state)

    folded = ordered.select(*frame, F.explode(F.aggregate("tracks", start, claim).out).alias("m"))
    return folded.select(*frame, "m.track_id", "m.face_idx")


def recall_pass(faces: DataFrame, tracks: DataFrame, frame: list[str], taken: DataFrame, dilate: float, width: float, height: float, min_score: float = 0.2, relaxed: float = 0.30, plain: float = 0.15) -> DataFrame:
    """Leftover faces go to free tracks at relaxed thresholds, the first face of a track wins; others are rejected."""
    left = faces.join(taken.select(*frame, "face_idx"), [*frame, "face_idx"], "left_anti")
    free = tracks.join(taken.select(*frame, "track_id"), [*frame, "track_id"], "left_anti")
    near = pairs(left.where(F.col("score") >= min_score), free, frame, dilate, width, height, relaxed).where(G.iou(F.col("face_box"), F.col("track_box")) >= plain)
    best = greedy_faces(near, frame)
    first = best.groupBy(*frame, "track_id").agg(F.min_by(F.struct("face_idx", "iou"), "face_idx").alias("m")).select(*frame, "m.face_idx", "track_id", "m.iou")
    return left.select(*frame, "face_idx").join(first, [*frame, "face_idx"], "left").withColumn("reason", F.when(F.col("track_id").isNull(), "rejected_low_iou").otherwise("recall"))


#: Numbers that a bank may hold to be sent to every task: 8 bytes each.
BANK_NUMBERS = 8_000_000


def knn(samples: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """The ``k`` bank labels of highest cosine for each sample (column embedding); ties, at 12 digits, go to the smaller
    label.

    The bank has one row a label; a row without a label or a usable vector is none of it. A sample whose vector is null,
    empty, not finite or not as wide as the bank's has one row, of rank 1 with a null match and score; an empty bank gives no rows. The bank's size is
    counted, and it goes to every task in parts of a bounded number of vectors; a part keeps its best ``k`` for a sample,
    and only those are compared between parts.
    """
    columns = [c for c in samples.columns if c != "embedding"]
    known = bank.select("label", "embedding").where("label IS NOT NULL")
    width = common_width(known)
    known = cut(known.where(usable(known, width=width)))
    rows = samples.withColumn("__v", F.when(usable(samples, width=width), doubles(F.col("embedding")))).drop("embedding").withColumn("__id", F.monotonically_increasing_id())
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "__v"), T.StructField("rank", T.IntegerType()), T.StructField("match", bank.schema["label"].dataType), T.StructField("score", T.DoubleType())])
    parts = max(1, -(-known.count() * max(width, 1) // BANK_NUMBERS))
    found = []
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("label"), F.lit(parts)) == part).orderBy("label").toArrow()
        centres = np.array(own["embedding"].to_pylist(), float).reshape(len(own), width)
        shared = samples.sparkSession.sparkContext.broadcast((own["label"].combine_chunks(), centres))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, part=part) -> Iterator[pa.RecordBatch]:
            names, c = shared.value
            top = min(k, len(names))
            for batch in batches:
                there = batch["__v"].is_valid()
                if part == 0 and c.shape[1]:
                    # without the bank's ways, and told once
                    out = batch.drop_columns(["__v"]).filter(pc.invert(there))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.ones(out.num_rows, np.int32)), pa.nulls(out.num_rows, names.type), pa.nulls(out.num_rows, pa.float64())], names=schema.names)
                batch = batch.filter(there)
                if not batch.num_rows:
                    continue
                v = batch["__v"].flatten().to_numpy().reshape(batch.num_rows, -1)
                length = np.linalg.norm(v, axis=1, keepdims=True)
                score = np.round(np.where(length < 1e-6, v, v / np.maximum(length, 1e-300)) @ c.T, 12) if top else np.zeros((len(v), 0))
                best = np.argsort(-score, axis=1, kind="stable")[:, :top]
                again = batch.drop_columns(["__v"]).take(pa.array(np.repeat(np.arange(len(v)), top)))
                rank = pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), len(v)))
                yield pa.RecordBatch.from_arrays([*again.columns, rank, names.take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, 1).ravel())], names=schema.names)

        found.append(rows.mapInArrow(run, schema))
    scored = found[0]
    for more in found[1:]:
        scored = scored.unionByName(more)
    if parts > 1:
        w = Window.partitionBy("__id").orderBy(F.desc("score"), "match")
        scored = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return scored.select(*columns, "rank", "match", "score")


def best_match(ranked: DataFrame, keys: list[str], threshold: float = C.similarity, min_margin: float = C.min_margin, overrides: dict[str, float] | None = None) -> DataFrame:
    """The first match where it reaches its label's threshold and leads the second by the margin, else null. A score that
    is null or no number reaches no threshold, and leaves no lead."""
    ranked = ranked.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    th = F.lit(threshold)
    for label, own in (overrides or {}).items():
        th = F.when(F.col("top.match") == label, own).otherwise(th)
    two = ranked.where("rank <= 2").groupBy(*keys).agg(F.min_by(F.struct("match", "score"), "rank").alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    ok = F.col("top.score").isNotNull() & (F.col("top.score") >= th) & (F.coalesce(F.col("top.score") - F.col("second"), F.lit(float("inf"))) >= min_margin)
    return two.select(*keys, F.when(ok, F.col("top.match")).alias("match"), F.col("top.score").alias("score"))


def watched(ranked: DataFrame, keys: list[str], labels: list, top: int = 3) -> DataFrame:
    """The first of a sample's ``top`` matches that is on the watch list."""
    near = ranked.where((F.col("rank") <= top) & F.col("match").isin(labels))
    return near.groupBy(*keys).agg(F.min_by(F.struct("match", "score", "rank"), "rank").alias("m")).select(*keys, "m.match", "m.score", "m.rank")


def _spells(detections: DataFrame, video: list[str], buffer: int) -> DataFrame:
    """Detections with the number of their spell: the spells of a video are more than ``buffer`` frames apart.

    Frames are taken in blocks of ``buffer`` + 1, so a gap between spells always ends in another block than it began: a
    video's blocks, with their first and last frames, show all of them, and only blocks meet in a task.
    """
    width = buffer + 1
    at = F.floor(F.col("frame_idx") / width)
    blocks = detections.groupBy(*video, at.alias("__block")).agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"))
    w = Window.partitionBy(*video).orderBy("__block")
    begins = F.coalesce((F.col("first") - F.lag("last").over(w) > buffer).cast("long"), F.lit(0))
    spells = blocks.withColumn("__new", begins).withColumn("spell", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of = lambda *c: F.struct(*video, *c)
    return detections.withColumn("__of", of(at.alias("__block"))).join(spells.select(of("__block").alias("__of"), "spell"), "__of").drop("__of")


def iou_tracks(detections: DataFrame, video: list[str], least: float = 0.3, buffer: int = 30) -> DataFrame:
    """Detections (frame_idx, det_idx, x1, y1, x2, y2) to the first live track with IoU over ``least``, else a new
    one; a track ages out after ``buffer`` frames unseen. Tracks of a video are numbered from 1 as they begin.

    Where a video has no detection for more than ``buffer`` frames, no track is live: it is cut there into spells, which
    are folded apart, each in order of its rows with its live tracks as all that is held; then numbers are shifted by
    those of the spells before. Detections without a frame or with an unknown corner have no track.
    """
    corners = ["x1", "y1", "x2", "y2"]
    known = F.col("frame_idx").isNotNull()
    for c in corners:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = detections.select(*video, "frame_idx", "det_idx", *(F.col(c).cast("double").alias(c) for c in corners), known.alias("__known"))
    whole = _spells(rows.where("__known").drop("__known"), video, buffer).select(*video, "spell", "frame_idx", "det_idx", *corners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live: list[list] = []  # number, box, last frame
        following, frame = 1, None
        used: set[int] = set()
        for new, part in runs(batches, len(video) + 1):
            if new:
                live, following, frame = [], 1, None
            numbers = []
            for f, *box in zip(*(part[c].to_pylist() for c in ("frame_idx", *corners)), strict=True):
                if f != frame:
                    frame, used = f, set()
                    live = [t for t in live if f - t[2] <= buffer]
                for t in live:
                    if t[0] not in used and _iou(t[1], box) > least:
                        break
                else:
                    t = [following, box, f]
                    following += 1
                    live.append(t)
                t[1], t[2] = box, f
                used.add(t[0])
                numbers.append(t[0])
            yield pa.RecordBatch.from_arrays([*part.drop_columns(corners).columns, pa.array(numbers, pa.int64())], names=[*video, "spell", "frame_idx", "det_idx", "track_id"])

    folded = cut(in_order(whole, [*video, "spell"], "frame_idx", "det_idx", *corners).mapInArrow(run, kinds(whole, *video, "spell", "frame_idx", "det_idx") + ", track_id long"))
    before = Window.partitionBy(*video).orderBy("spell").rowsBetween(Window.unboundedPreceding, -1)
    of = F.struct(*video, "spell").alias("__of")
    shifts = folded.groupBy(*video, "spell").agg(F.max("track_id").alias("n")).select(of, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    out = folded.select("*", of).join(shifts, "__of").select(*video, "frame_idx", "det_idx", (F.col("track_id") + F.col("shift")).alias("track_id"))
    return out.unionByName(rows.where("NOT __known").select(*video, "frame_idx", "det_idx", F.lit(None).cast("long").alias("track_id")))


def _iou(a: list[float], b: list[float]) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if inter > 0 and union > 0 else 0.0


def embed(samples: DataFrame, make_embedder, column: str, out: str = "embedding") -> DataFrame:
    """Adds a vector made by a user's embedder: ``make_embedder()`` gives, once a task, a function of a list of
    values to a list of vectors."""
    schema = samples.withColumn(out, F.array().cast("array<float>")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_embedder()
        for pdf in frames:
            yield pdf.assign(**{out: [list(map(float, v)) for v in model(pdf[column].tolist())]})

    return samples.mapInPandas(run, schema)
