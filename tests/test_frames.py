import os

import pytest
from pyspark.sql import functions as F

from dwell import schemas
from dwell.sources import folders, frames


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("frames") / "in")
    rows = [("v", f, d, "face", (1.0 * f, 0.0, 2.0, 3.0), 0.5, d % 3, [(1.0, 2.0)] if d else None) for f in [*range(400), *range(5000, 5100)] for d in range(3)] + [("v", None, 0, "face", None, None, None, None)]
    d = spark.createDataFrame(rows, schemas.DETECTIONS)
    for part in (d.where("frame_idx < 1000").repartitionByRange(3, "frame_idx"), d.where("frame_idx > 1000 OR frame_idx IS NULL").coalesce(1)):
        part.write.mode("append").parquet(at)
    return at


def load(spark, folder, **options):
    return spark.read.format(frames.NAME).options(path=folders.qualified(spark, folder), range=100, **options).load()


def test_rows_and_partitions_of_ranges(spark, folder):
    frames.register(spark)
    plain = spark.read.schema(schemas.DETECTIONS).parquet(folder).where("frame_idx IS NOT NULL")
    whole = load(spark, folder)
    assert whole.dtypes == plain.dtypes and sorted(map(str, whole.collect())) == sorted(map(str, plain.collect()))
    # frames 400 to 4999 are no partitions
    assert whole.rdd.getNumPartitions() == 5
    part = load(spark, folder, stride=3, **{"from": 150, "to": 5003, "classes": "0,2"})
    assert part.rdd.getNumPartitions() == 4
    assert sorted(map(str, part.collect())) == sorted(map(str, plain.where("frame_idx % 3 = 0 AND frame_idx >= 150 AND frame_idx < 5003 AND class_id IN (0, 2)").collect()))
    assert load(spark, folder, **{"from": 900, "to": 4000}).count() == 0 == load(spark, folder + "-none").count() == load(spark, folder, classes="").count()
    with pytest.raises(Exception, match="stride"):
        load(spark, folder, stride=0).count()


@pytest.mark.parametrize(
    ("where", "partitions"),
    [("frame_idx >= 350", 2), ("frame_idx > 5000 AND frame_idx <= 5050 AND class_id = 1", 1), ("frame_idx = 7", 1), ("frame_idx < 100 OR frame_idx > 5000", 5), ("frame_idx < 0", 1), ("class_id IN (0, 1) AND score > 0.1 AND frame_idx < 200", 2), ("frame_idx >= 10 AND frame_idx >= 120 AND frame_idx < 210", 2)],
)
def test_filters_are_pushed_down(spark, folder, where, partitions):
    frames.register(spark)
    got = load(spark, folder, push_filters=True).where(where)
    plain = spark.read.schema(schemas.DETECTIONS).parquet(folder).where("frame_idx IS NOT NULL").where(where)
    assert got.rdd.getNumPartitions() == partitions
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    # without the option a frame can be used again
    base = load(spark, folder)
    assert base.where(where).count() == plain.count() and base.count() == 1500


def test_streams_take_frames_in_order(spark, folder, tmp_path):
    frames.register(spark)
    stream = spark.readStream.format(frames.NAME).options(path=folders.qualified(spark, folder), range=100, frames_per_trigger=150, stride=2).load()
    taken = []

    def tell(df, k):
        r = df.agg(F.min("frame_idx"), F.max("frame_idx"), F.count(F.lit(1))).first()
        taken.append((k, *r))

    def run():
        q = stream.writeStream.foreachBatch(tell).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        q.processAllAvailable()
        q.stop()

    run()
    seen = [t for t in taken if t[3]]
    assert sum(t[3] for t in seen) == 250 * 3 and all(a[2] < b[1] for a, b in zip(seen, seen[1:], strict=False)) and all(t[2] - t[1] < 150 for t in seen)
    # what is written later is taken by the next run, from where the last one ended
    taken.clear()
    spark.createDataFrame([("v", f, 0, "face", None, 0.5, 0, None) for f in range(5100, 5120)], schemas.DETECTIONS).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert [t[1:] for t in taken if t[3]] == [(5100, 5118, 10)]


@pytest.mark.parametrize(
    ("uri", "want"),
    [
        ("file:///a/b", "file:///a/b"), ("file:/a/b", "file:///a/b"), ("hdfs://name:8020/a", "hdfs://name:8020/a"), ("viewfs://store/a", "viewfs://store/a"), ("s3a://bucket/a b/c", "s3://bucket/a b/c"), ("gs://bucket/a", "gs://bucket/a"),
        ("abfs://c@acc.dfs.core.windows.net/a", "abfss://c@acc.dfs.core.windows.net/a"), ("wasbs://c@acc.blob.core.windows.net/a", "abfss://c@acc.dfs.core.windows.net/a"), ("dbfs:/tmp/a", "file:///dbfs/tmp/a"),
    ],
)
def test_schemes(spark, uri, want):
    assert folders.worker_uri(uri) == want
    assert folders.qualified(spark, "/a/b") == "file:/a/b" and os.path.isabs(folders.opened(folders.qualified(spark, "/a/b"))[1])
    with pytest.raises(ValueError, match="no scheme"):
        folders.worker_uri("/a/b")


def test_a_range_opens_its_own_files_alone(spark, folder):
    ranges = frames._Wanted(folders.qualified(spark, folder), 1).ranges(100)
    held = {p: (lo, hi) for lo, hi, p in frames._Wanted(folders.qualified(spark, folder), 1).held()}
    assert len(held) > 1 and all(r.files and len(r.files) < len(held) for r in ranges)
    assert all(lo < r.hi and hi >= r.lo for r in ranges for lo, hi in (held[p] for p in r.files))
