import os
from urllib.parse import urlsplit

import pytest

from dwell.llm import shared
from dwell.llm.grid_join import near_vectors


def here(spark):
    root = urlsplit(shared.shared_dir(spark)).path + f"/dwell-{spark.sparkContext.applicationId}"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_what_is_made_within_scratch_goes_with_it(spark):
    d = spark.createDataFrame([(k, [1.0, float(k % 3)]) for k in range(30)], "vec_id long, embedding array<double>")
    outer = shared.settle(spark.range(3), "kept")
    before = here(spark)
    with shared.scratch(spark):
        found = near_vectors(d)
        assert here(spark) > before
        rows = {tuple(r) for r in found.collect()}
        with shared.scratch(spark):
            shared.settle(spark.range(2), "inner")
            inside = here(spark)
        assert {x for x in inside - here(spark)} and all(x.startswith("inner") for x in inside - here(spark))
    assert here(spark) == before and outer.count() == 3
    assert len(rows) == 30
    with pytest.raises(ZeroDivisionError), shared.scratch(spark):
        shared.settle(spark.range(2), "lost")
        raise ZeroDivisionError
    assert here(spark) == before


def test_a_pipeline_leaves_its_last_table(spark):
    import corpus_pipeline

    before = here(spark)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    left = here(spark) - before
    assert len(left) == 1 and next(iter(left)).startswith("simhash_near_dedup")
