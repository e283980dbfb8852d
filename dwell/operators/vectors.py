"""Centroids, medoids, representatives and what is measured against them.

A vector that is null, empty, not finite or not as wide as most takes no part (``functions.vectors.usable``): it adds to no
mean, is no medoid or representative and has a null similarity. A group without any other has none of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.functions.vectors import cosine, doubles, dot, mean_by, safe_cosine, unit, usable
from dwell.operators.clustering import block_pairs, in_blocks, in_pairs, matrix
from dwell.operators.folds import in_order, kinds, runs
from dwell.operators.graph import cut


def facebank(samples: DataFrame, label: str = "label") -> DataFrame:
    """The normalised mean vector of each label, and its number of samples."""
    plain = samples.where(usable(samples)).select(label, doubles(F.col("embedding")).alias("v"))
    return mean_by(plain, [label], "v", "mean").select(label, F.col("n").alias("count"), unit(F.col("mean")).alias("embedding"))


def running_centroid(samples: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The mean of a track's vectors up to and including each sample, null before the first; a fold that holds a sum."""
    rows = samples.select(*keys, order, F.when(usable(samples), doubles(F.col("embedding"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for new, part in runs(batches, len(keys)):
            if new:
                total, n = 0.0, 0
            there = part["v"].is_valid().to_numpy(zero_copy_only=False)
            own = part["v"].flatten().to_numpy().reshape(int(there.sum()), -1) if there.any() else np.zeros((0, 0))
            sums, counts = total + np.cumsum(own, axis=0) if len(own) else own, n + np.cumsum(there)
            at = np.cumsum(there) - 1
            means = [None if c == 0 else ((sums[k] if k >= 0 else total) / c).tolist() for k, c in zip(at.tolist(), counts.tolist(), strict=True)]
            if len(sums):
                total, n = sums[-1], int(counts[-1])
            yield pa.RecordBatch.from_arrays([*part.drop_columns(["v"]).columns, pa.array(means, pa.list_(pa.float64()))], names=[*keys, order, "centroid"])

    return in_order(rows, keys, order).mapInArrow(run, kinds(rows, *keys, order) + ", centroid array<double>")


def centroid_similarity(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Each sample's cosine with the mean of its track."""
    plain = samples.withColumn("v", F.when(usable(samples), doubles(F.col("embedding"))))
    means = mean_by(plain, keys, "v", "mean").drop("n")
    return plain.join(means, keys, "left").withColumn("similarity", safe_cosine(F.col("v"), F.col("mean"))).drop("v", "mean", "embedding")


def medoids(samples: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """The sample of the least summed cosine distance, the first on a tie. As the distances to a group sum to
    n minus the dot product with the sum of its unit vectors, no pairs are made."""
    scaled = samples.where(usable(samples)).withColumn("u", unit(doubles(F.col("embedding"))))
    means = mean_by(scaled, keys, "u", "mean")
    cost = F.round(F.col("n") - dot(F.col("u"), F.col("mean")) * F.col("n"), 9)
    return scaled.join(means, keys).groupBy(*keys).agg(F.min_by(F.struct(F.col(sample), cost.alias("cost")), F.struct(cost, F.col(sample))).alias("m")).select(*keys, f"m.{sample}", "m.cost")


def representatives(samples: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """The sample nearest to the mean direction of its track."""
    scaled = samples.where(usable(samples)).withColumn("u", unit(doubles(F.col("embedding"))))
    sim = F.round(cosine(F.col("u"), F.col("mean")), 9)
    best = F.min_by(F.struct(F.col(sample), sim.alias("sim")), F.struct(-sim, F.col(sample)))
    return scaled.join(mean_by(scaled, keys, "u", "mean").drop("n"), keys).groupBy(*keys).agg(best.alias("m")).select(*keys, f"m.{sample}", "m.sim")


def purity(similarities: DataFrame, track: str, byte_id: str) -> DataFrame:
    """Least, median and mean similarity of each track, and how many tracks its tracker id was split into."""
    per = similarities.groupBy(track).agg(
        F.first(byte_id, ignorenulls=True).alias(byte_id), F.min("similarity").alias("min_sim"), F.median("similarity").alias("median_sim"), F.avg("similarity").alias("mean_sim"), F.count("similarity").alias("n")
    )
    splits = per.groupBy(byte_id).agg(F.count(F.lit(1)).alias("splits")).withColumnRenamed(byte_id, "b")
    return per.join(splits, F.col(byte_id).eqNullSafe(F.col("b"))).drop("b")


#: Blocks whose sums one task adds up, of 8 (d² + d) bytes each.
_MERGED = 128


def _moments(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(__cluster, total, squares, least, most) over the pairs of a cluster, the last two of those within its blocks.

    The sums need no pairs across blocks: with the sum S of a cluster's vectors and that G of their outer products, the
    products of all pairs sum to (|S|² - Σ|x|²) / 2 and their squares to (|G|² - Σ|x|⁴) / 2. Each block gives its sums,
    which are added up ``_MERGED`` at a time.
    """
    many = blocks.groupBy(F.col("__cluster").alias("__of")).agg(F.count(F.lit(1)).alias("blocks"))
    rows = placed.join(many, F.col("__cluster").eqNullSafe(F.col("__of"))).drop("__of")
    kind = placed.schema["__cluster"].dataType.simpleString()
    schema = f"__cluster {kind}, b long, ones double, fours double, total double, squares double, least double, most double, s binary, g binary"

    def own(t: pa.Table) -> pa.Table:
        x = matrix(t["u"])
        length = (x**2).sum(axis=1)
        least, most = np.inf, -np.inf
        for k in range(0, len(x), 512):
            dots = x[k : k + 512] @ x.T
            dots = dots[np.triu_indices(len(dots), k + 1, len(x))]
            if len(dots):
                least, most = min(least, dots.min()), max(most, dots.max())
        s, g = x.sum(axis=0), x.T @ x
        total, squares = ((s @ s) - length.sum()) / 2, ((g**2).sum() - (length**2).sum()) / 2
        alone = t["blocks"][0].as_py() == 1
        row = {"b": [t["b"][0].as_py()], "ones": [length.sum()], "fours": [(length**2).sum()], "total": [total], "squares": [squares], "least": [least], "most": [most], "s": [None if alone else s.tobytes()], "g": [None if alone else g.tobytes()]}
        return pa.table({"__cluster": t["__cluster"].slice(0, 1)} | {c: pa.array(v, pa.binary() if c in "sg" else pa.int64() if c == "b" else pa.float64()) for c, v in row.items()})

    def merged(t: pa.Table) -> pa.Table:
        s, g = (sum(np.frombuffer(x) for x in t[c].to_pylist()) for c in ("s", "g"))
        ones, fours = (t[c].to_numpy().sum() for c in ("ones", "fours"))
        row = {"b": [t["to"][0].as_py()], "ones": [ones], "fours": [fours], "total": [((s @ s) - ones) / 2], "squares": [((g**2).sum() - fours) / 2], "least": [t["least"].to_numpy().min()], "most": [t["most"].to_numpy().max()], "s": [s.tobytes()], "g": [g.tobytes()]}
        return pa.table({"__cluster": t["__cluster"].slice(0, 1)} | {c: pa.array(v, pa.binary() if c in "sg" else pa.int64() if c == "b" else pa.float64()) for c, v in row.items()})

    sums = cut(rows.select("__cluster", "b", "blocks", "u").groupBy("__cluster", "b").applyInArrow(own, schema))
    single, large = sums.where("s IS NULL"), sums.where("s IS NOT NULL")
    most = many.agg(F.max("blocks")).first()[0] or 0
    while most > 1:
        most = -(-most // _MERGED)
        large = large.withColumn("to", F.pmod(F.xxhash64("b"), F.lit(most))).groupBy("__cluster", "to").applyInArrow(merged, schema)
    return single.unionByName(large).drop("b", "ones", "fours", "s", "g")


def cluster_quality(samples: DataFrame, cluster: str, sample: str, block: int = 2048) -> DataFrame:
    """Pairwise similarity within clusters: number, mean, least, most, population variance; 1, 1, 1 and 0 for a
    single sample. ``size`` counts all samples, the rest is of those with a usable vector, null where there are none.

    A cluster is cut into blocks of neighbours. Mean and variance come from sums over its vectors; for the least and the
    most, pairs of blocks are compared only where the bounds of their similarities pass what is known from within blocks.
    """
    whole = cut(samples.select(F.col(cluster).alias("__cluster"), F.when(usable(samples), unit(doubles(F.col("embedding")))).alias("u"), F.monotonically_increasing_id().alias("id")))
    placed, blocks = in_blocks(whole.where("u IS NOT NULL"), ["__cluster"], block)
    sums = cut(_moments(placed, blocks))

    def extremes(first: pa.Table, second: pa.Table, own: bool) -> pa.Table:
        x, y = matrix(first["u"]), matrix(second["u"])
        dots = [(s.min(), s.max()) for k in range(0, len(x), 512) if len(s := x[k : k + 512] @ y.T)]
        return pa.table({"__cluster": first["__cluster"].slice(0, 1), "l": [min(d[0] for d in dots)], "m": [max(d[1] for d in dots)]})

    known = sums.select(F.col("__cluster").alias("__of"), "least", "most")
    apart = block_pairs(blocks, ["__cluster"]).where("lo < hi").join(known, F.col("__cluster").eqNullSafe(F.col("__of")))
    open_ = cut(apart.where((F.col("low") < F.col("least")) | (F.col("high") > F.col("most"))).select("__cluster", "lo", "hi"))
    kind = whole.schema["__cluster"].dataType.simpleString()
    across = in_pairs(placed, open_, ["__cluster"], extremes, f"__cluster {kind}, l double, m double").groupBy(F.col("__cluster").alias("__of")).agg(F.min("l").alias("l"), F.max("m").alias("m"))
    both = sums.join(across, F.col("__cluster").eqNullSafe(F.col("__of")), "left").drop("__of").withColumns({"min_sim": F.least("least", "l"), "max_sim": F.greatest("most", "m")})
    sizes = whole.groupBy(F.col("__cluster").alias(cluster)).agg(F.count(F.lit(1)).alias("size"), F.count("u").alias("n"))
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    mean = F.col("total") / pairs
    stats = {"mean_sim": (mean, 1.0), "min_sim": (F.col("min_sim"), 1.0), "max_sim": (F.col("max_sim"), 1.0), "var_sim": (F.greatest(F.col("squares") / pairs - mean * mean, F.lit(0.0)), 0.0)}
    out = sizes.join(both, F.col(cluster).eqNullSafe(F.col("__cluster")), "left")
    of = [F.when(F.col("n") > 1, x).when(F.col("n") == 1, F.lit(alone)).alias(c) for c, (x, alone) in stats.items()]
    return out.select(cluster, "size", pairs.alias("pairs"), *of)
