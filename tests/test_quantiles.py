import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.operators import review as R
from dwell.operators import sampling as P
from dwell.operators.quantiles import quantiles

SHARES = {"q0": 0.0, "q25": 0.25, "median": 0.5, "q90": 0.9, "q100": 1.0}


def plain(rows):
    by = {}
    for k, x in rows:
        by.setdefault(k, [])
        if x is not None and not np.isnan(x):
            by[k].append(x)
    return {k: tuple(float(np.quantile(v, q)) if v else None for q in SHARES.values()) for k, v in by.items()}


@pytest.mark.parametrize("few", [1, 40, 10_000])
def test_quantiles_of_groups_of_all_sizes(spark, few):
    rng = np.random.default_rng(few)
    rows = [("even", float(x)) for x in rng.random(500)] + [("skewed", float(10.0**x)) for x in rng.integers(-200, 200, 400)] + [("ties", float(x)) for x in rng.integers(0, 3, 600)] + [("equal", 7.0)] * 300
    rows += [(None, float(x)) for x in rng.normal(size=200)] + [("one", 3.0), ("none", None), ("nan", float("nan")), ("nan", 1.0), ("two", 1.0), ("two", 2.0), ("wide", -1.7e308), ("wide", 1.7e308), ("wide", 0.0), ("zero", 0.0), ("zero", -0.0), ("zero", -1.0)] + [("even", None)] * 5
    d = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: tuple(r)[1:] for r in quantiles(d, ["k"], "x", SHARES, few).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for k, v in want.items():
        if k != "wide":  # numpy's own interpolation overflows there
            assert got[k] == pytest.approx(v, rel=1e-12) if v[0] is not None else got[k] == v, k
    assert got["wide"][0] == -1.7e308 and got["wide"][2] == 0.0


def test_quantile_of_a_whole_table(spark):
    d = spark.range(1001).select((F.col("id") % 500).cast("double").alias("x"))
    assert tuple(quantiles(d, [], "x", SHARES, 10).first()) == tuple(np.quantile(np.arange(1001) % 500, list(SHARES.values())))
    assert tuple(quantiles(d.limit(0), [], "x", SHARES, 10).first()) == (None,) * 5


def test_operators_by_histograms(spark, monkeypatch):
    from dwell.operators import quantiles as Q

    rng = np.random.default_rng(5)
    rows = [(int(t), int(k), bool(k % 2), float(q)) for t in range(3) for k, q in enumerate(rng.random(60).round(2))]
    d = spark.createDataFrame(rows, "track_id long, frame_idx long, picked boolean, quality double")
    want = [sorted(map(tuple, f(d).collect())) for f in (lambda x: R.sample_summary(x, ["track_id"]), lambda x: P.percentile_gate(x, ["track_id"], "quality", 75.0, 0.2))]
    monkeypatch.setattr(Q, "FEW", 10)
    for f in (lambda x: R.sample_summary(x, ["track_id"]), lambda x: P.percentile_gate(x, ["track_id"], "quality", 75.0, 0.2)):
        assert [pytest.approx(r) for r in want.pop(0)] == sorted(map(tuple, f(d).collect()))


def test_rows_of_a_large_group_stay_where_they_are(spark, monkeypatch):
    """Ranks go to the rows: an exchange by group would put all rows of a table, or of a hot track, in one task."""
    from dwell.operators import quantiles as Q

    plans = []
    own = Q.cut
    monkeypatch.setattr(Q, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), own(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = spark.range(1000).select((F.col("id") % 3).alias("k"), F.sqrt("id").alias("x"))
        for keys in ([], ["k"]):
            plans.clear()
            quantiles(d, keys, "x", {"median": 0.5}, 10).collect()
            refined = [p for p in plans if "shiftright" in p]
            assert len(refined) > 1 and all("BroadcastHashJoin" in p for p in refined)
            assert all("SortMergeJoin" not in p for p in plans if "MapInArrow" in p)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
